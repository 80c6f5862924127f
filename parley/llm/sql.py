"""The results of the operators stated in DuckDB's SQL."""

from parley.llm.licenses import FLOOR, TEMPLATES

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUALITY = r"""
WITH w AS (
    SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
win AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
        SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))),
rep AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
    SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
           length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS n_symbols,
           len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id)),
b AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
            + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 4 ELSE 0 END + CASE WHEN 4 * n_symbols > n_words THEN 8 ELSE 0 END
            + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)::BIGINT AS fail_bits
    FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
           + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|[A-Za-z_]+\|>)', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_APPORTION = """
{name}_n AS (SELECT *, {n} - count(*) OVER g / 2 AS few, {n} + count(*) OVER g / 2 AS many, sum({v}) OVER g AS total
             FROM {src} WINDOW g AS (PARTITION BY {within})),
{name}_s AS (SELECT *, (CASE WHEN few > 0 THEN floor({v} * few / total + 0.5) ELSE 0 END)::BIGINT AS low,
                    floor({v} * many / total + 0.5)::BIGINT + 1 AS high FROM {name}_n),
{name}_o AS (SELECT *, {n} - sum(low) OVER (PARTITION BY {within}) AS open FROM {name}_s),
{name}_b AS (SELECT {within} AS w, {party} AS p, open, {v} / (2 * s + 1) AS q
             FROM (SELECT *, unnest(range(low, high + 1)) AS s FROM {name}_o)),
{name}_w AS (SELECT w, p, count(*) AS won FROM (
                 SELECT *, row_number() OVER (PARTITION BY w ORDER BY q DESC, p) AS r FROM {name}_b) WHERE r <= open GROUP BY w, p),
{name} AS (SELECT o.* EXCLUDE (few, many, total, low, high, open), (low + coalesce(won, 0))::BIGINT AS {out}
           FROM {name}_o o LEFT JOIN {name}_w ON w = {within} AND p = {party})
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / 4000.0)::BIGINT AS shards,
           row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS room FROM totals),
levels AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(room) OVER b, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM ranked WINDOW b AS (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT level AS l FROM levels WHERE room >= weight * level ORDER BY room / weight, rank LIMIT 1),
aimed AS (SELECT source, source_size, shards, rank, least(room, weight * (SELECT l FROM settled))::DOUBLE AS target FROM levels),
seats AS (SELECT *, 0 AS one, floor(sum(target) OVER () / 64)::BIGINT AS seats FROM aimed WHERE source_size > 0),
""" + _APPORTION.format(name="seated", src="seats", within="one", party="rank", v="target", n="seats", out="blocks") + r""",
placed AS (
    SELECT s.doc_id, s.size, a.rank, a.source_size, a.target, coalesce(t.blocks, 0) AS blocks, md5('mix:' || s.doc_id) AS mark,
           ('0x' || substr(md5('mix:' || s.doc_id), 1, 12))::BIGINT % a.shards AS shard
    FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN seated t ON t.rank = a.rank),
shardly AS (SELECT rank, shard, blocks, sum(size)::BIGINT AS words FROM placed GROUP BY ALL HAVING sum(size) > 0),
""" + _APPORTION.format(name="quotas", src="shardly", within="rank", party="shard", v="words", n="blocks", out="quota") + r""",
plan AS (
    SELECT rank, shard, words, least(quota * 64, words * 2) AS quota,
           ('0x' || substr(md5('mix:' || rank || ':' || shard), 1, 12))::BIGINT % ceil(words / 64)::BIGINT * 64 AS start
    FROM quotas),
laid AS (
    SELECT p.*, sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY mark, doc_id, size)::BIGINT AS "end" FROM placed p),
cut AS (
    SELECT l.*, l."end" - l.size AS pos, words, start, quota // words AS rounds, quota % words AS rest
    FROM laid l LEFT JOIN plan USING (rank, shard)),
got AS (
    SELECT *, greatest(0, least("end", start + rest) - greatest(pos, start)) AS one,
           greatest(0, least("end", start + rest - words) - pos) AS two FROM cut)
SELECT doc_id, size, source_size, target, coalesce(CASE WHEN two > 0 THEN 0 ELSE greatest(0, start - pos) END, 0)::BIGINT AS skip,
       coalesce(rounds * size + one + two, 0)::BIGINT AS taken
FROM got
"""


def licenses() -> str:
    """Licence passages, over the same fixed list of wordings."""
    quoted = ", ".join(f"('{n}', {k}, '{t.replace(chr(39), chr(39) * 2)}')" for n, ts in TEMPLATES.items() for k, t in enumerate(ts))
    return rf"""
WITH lists AS (
    SELECT doc_id, list_concat(string_split(text, chr(10)),
        list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n\s*'), lambda p: contains(p, chr(10))), [text]) AS p
    FROM documents WHERE text IS NOT NULL),
passages AS (
    SELECT doc_id, unnest(list_distinct(p)) AS t, p FROM lists),
grams AS (
    SELECT doc_id, t, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
    FROM (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM passages)),
templates AS (
    SELECT license, template, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
    FROM (SELECT license, template, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w
          FROM (VALUES {quoted}) AS v(license, template, t))),
scored AS (
    SELECT doc_id, t, license, template, 2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice
    FROM grams a JOIN templates b ON len(a.g) BETWEEN len(b.g) / 4 AND len(b.g) * 4)
SELECT s.doc_id, (SELECT list_position(list_distinct_ordered, s.t) - 1 FROM (
           SELECT list_filter(p, lambda x, i: list_position(p, x) = i) AS list_distinct_ordered FROM lists l WHERE l.doc_id = s.doc_id))::INTEGER AS passage,
       license, template, dice
FROM scored s WHERE dice >= {FLOOR}
"""


DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    lt AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
    gt AS (SELECT lang, source, coalesce(sum(n), 0) AS gn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT gt.lang, gt.source, kept.term, coalesce(c.n, 0) AS n,
            CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (gn + 5 * v) AS BIGINT) AS p,
            CAST(1 + CAST(1000000000 AS HUGEINT) * (lc + 5) // (ln + 5 * v) AS BIGINT) AS q
        FROM gt JOIN lt ON lt.lang = gt.lang JOIN kept ON kept.lang = gt.lang
        LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = kept.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pr AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM pr
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', term, p - q,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS r FROM p WHERE n > 0 AND p > q) WHERE r <= 50
"""

HARD_NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS other_id, a.label = b.label AS same,
            CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
    pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5)
SELECT pos.anchor_id, pos.other_id AS positive_id,
    CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY neg.score DESC, neg.other_id) AS INTEGER) AS "rank",
    neg.other_id AS negative_id, pos.score AS positive_score, neg.score AS negative_score
FROM pos JOIN s neg ON neg.a = pos.a AND NOT neg.same AND 30 * pos.score <= 100 * neg.score AND 100 * neg.score <= 90 * pos.score
QUALIFY "rank" <= 10
"""
