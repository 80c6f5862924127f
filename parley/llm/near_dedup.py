"""MinHash near-dedup: circulant signatures, banding, and exact Jaccard on whole shingle sets."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.hashing import Words, chunks, mix64
from parley.llm.words import whole_rows
from parley.session import staged

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 30, 6
BLOCK, BLOCK_SHINGLES, POSTINGS = 512, 500_000, 4_000_000
HASH_BYTES = 6
NO_ID = -(2**63)
SIGMA, STEP = np.uint64(0x5851F42D4C957F2D), 256


def shingle_sets(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    at, text = words.windows(size)
    spans = words.spans(at, at + size)
    bounds = np.searchsorted(text, np.arange(len(words.first)))
    lengths = np.diff(words.first)
    out = []
    for i, n in enumerate(lengths):
        if n >= size:
            out.append(np.unique(spans[bounds[i]:bounds[i + 1]]))
        elif n:
            out.append(words.spans(words.first[i:i + 1], words.first[i + 1:i + 2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """Coordinate k is the least pi(sigma(x) + k) over the set, all modulo 2**32.

    sigma breaks up the set's structure, pi is the one permutation whose circular shifts stand in
    for ``length`` independent ones; both are bijective mixers, so no table is kept.
    """
    y = (mix64(shingles ^ SIGMA) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(length, dtype=np.uint32)
    best = np.full(length, 2**32 - 1, np.uint32)
    for at in range(0, len(y), STEP):
        x = y[at:at + STEP, None] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(best, x.min(0), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for equal coordinates in different bands."""
    weights = np.array([pow(0xA0761D6478BD642F, k + 1, 2**64) for k in range(rows)], np.uint64)
    folded = (mix64(sig.reshape(bands, rows).astype(np.uint64)) * weights).sum(1, dtype=np.uint64)
    return mix64(folded + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sign(bands: int, rows: int):
    """Map function: (k, n, x, y, bands): set size, 128 bits that name the set, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y, keys = [], [], [], []
            for _, _, words in chunks(batch.column(1), fold=True):
                for s in shingle_sets(words):
                    n.append(len(s))
                    x.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    y.append(int(mix64(s ^ np.uint64(0x1234567890ABCDEF)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["k", "n", "x", "y", "bands"])

    return run


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, g, blocks, set): the text replaced by the ``HASH_BYTES`` low bytes of each shingle hash."""
    for batch in batches:
        sets = [s for _, _, words in chunks(batch.column(3), fold=True) for s in shingle_sets(words)]
        packed = [s.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["k", "g", "blocks", "set"])


def _tasks(sets: DataFrame) -> DataFrame:
    """(task, side, k, set): one row per task that a set takes part in.

    A group of one block is one task. A larger one is cut into its blocks by hash of the id; a set
    goes to the tasks of its block with every block, on side 0 as the lesser block.
    """
    many = F.col("blocks")
    own = F.pmod(F.xxhash64("k"), many).cast("int")
    dealt = sets.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), many - 1)))
    task = F.concat_ws(":", "g", F.least("i", "j"), F.greatest("i", "j"))
    return dealt.select(task.alias("task"), (F.col("i") > F.col("j")).cast("int").alias("side"), "k", "set")


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view(np.uint64).ravel()


def link_group(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of ``left`` x ``right`` (or within ``left``) connect; a spanning forest of them.

    Postings of all shingles give a document's intersections with all others at once.
    """
    docs = left + (right or [])
    sizes = np.array([len(s) for _, s in docs])
    values = np.concatenate([s for _, s in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    number = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    mine = np.empty(len(values), np.int64)
    mine[order] = number
    ends = np.cumsum(sizes)
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(len(left)):
        ids = mine[ends[i] - sizes[i]:ends[i]]
        common = np.zeros(len(docs), np.int64)
        for part in np.array_split(ids, 1 + len(ids) * len(docs) // POSTINGS):
            low, span = edge[part], edge[part + 1] - edge[part]
            at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
            common += np.bincount(owner[at], minlength=len(docs))
        first = len(left) if right is not None else i + 1
        near = first + np.flatnonzero(100 * common[first:] >= percent * (sizes[i] + sizes[first:] - common[first:]))
        for j in near:
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                links.append((docs[i][0], docs[int(j)][0]))
    return links


def _link_rows(percent: int):
    """Map function over rows (task, side, k, set) ordered by task: links (a, b)."""
    def solve(rows):
        left = [(k, s) for side, k, s in rows if side == 0]
        right = [(k, s) for side, k, s in rows if side == 1]
        return link_group(left, right, percent) if right else link_group(left, None, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        for batch in batches:
            for task, side, k, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now:
                    if len(rows) > 1:
                        found += solve(rows)
                    now, rows = task, []
                rows.append((side, k, _unpack(packed)))
            if len(found) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if len(rows) > 1:
            found += solve(rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents whose sets of 5-word shingles (A-Z lower-cased) have a Jaccard of at least
    ``percent`` / 100; component_id is the smallest id reachable over links.

    1. Documents with equal sets are one class, led by its smallest id (128 bits name a set).
    2. Leaders get ``bands`` * ``rows`` circulant coordinates and a key per band. A pair at 0.85
       shares no band with probability (1 - 0.85 ** 6) ** 30, below 1e-6.
    3. A bucket links each member to its least member: as many edges as members, never pairs.
       Components of these edges are candidate groups; every pair that shares a band is inside one.
    4. Groups are compared on whole sets: in one task up to ``block`` documents and
       ``BLOCK_SHINGLES`` shingles, larger groups as blocks of about that size, each pair of
       blocks being a task of its own. Tasks return at most one link per document they hold.
    5. Components of the confirmed links give the classes.

    Sets are compared as 48-bit hashes. Null, empty and blank texts have an empty set and no link;
    a null id counts as -2**63 inside and gives null ids; rows that share an id are one document
    that links where any of its rows does; repeated rows are reported as often as they stand;
    an empty table gives no rows; other columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k")
    texts = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = staged(texts.mapInArrow(_sign(bands, rows), "k long, n long, x long, y long, bands array<long>"))
    classes = staged(signed.filter("n > 0").groupBy("x", "y", "n").agg(F.min("k").alias("lead")))
    leaders = classes.select(F.col("lead").alias("k")).distinct()
    members = signed.filter("n > 0").join(leaders, "k").select("k", F.explode("bands").alias("b"))
    least = members.groupBy("b").agg(F.min("k").alias("a"), F.max("k").alias("z")).filter("a <> z").select("b", "a")
    edges = members.join(least, "b").filter("k <> a").select("a", F.col("k").alias("b")).distinct()
    groups = components(edges).withColumnRenamed("node", "k").withColumnRenamed("root", "g")

    sizes = classes.groupBy(F.col("lead").alias("k")).agg(F.max("n").alias("n"))
    counts = groups.join(sizes, "k").groupBy("g").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    # texts move once, by id, whatever the number of grouped documents
    sets = staged(texts.join(groups.join(counts, "g").hint("merge"), "k").select("k", "g", "blocks", "text")
                  .mapInArrow(_packed_sets, "k long, g long, blocks int, set binary"))
    links = _tasks(sets).repartition("task").sortWithinPartitions("task").mapInArrow(
        _link_rows(percent), "a long, b long")
    roots = components(links.distinct()).withColumnRenamed("node", "lead")
    named = classes.join(roots, "lead", "left").select("x", "y", "n", F.coalesce("root", "lead").alias("root"))
    per_id = signed.filter("n > 0").join(named, ["x", "y", "n"]).groupBy("k").agg(F.min("root").alias("root"))
    out = signed.select("k", "n").join(per_id, "k", "left").withColumn("root", F.coalesce("root", "k"))
    real = F.when(F.col("root") != NO_ID, F.col("root"))
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      real.alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its class, all columns; rows that share a kept id all stay."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **params).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    keyed = whole_rows(docs).withColumn("id", F.col("row")[id_col])
    return keyed.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
