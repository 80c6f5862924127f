"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.words import whole_rows, word_count, words
from parley.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEAT = 1.5, 2
BLOCK = 64
SHARD_ROWS = 4_000
SMALL_ROWS = 100_000


def apportion(parties: DataFrame, within: Sequence[str], party: str, votes: str, seats: str, name: str) -> DataFrame:
    """``parties`` with their seats by highest quotients votes / (2 s + 1), per ``within``.

    ``votes`` must be above 0 and ``seats`` the same for all rows of a group. Rather than hand out
    seat after seat, each party first gets its rounded share at a divisor that surely hands out
    too few; the open seats, fewer than the group has parties, go to the highest of the next
    quotients, of which a second divisor, surely too low, bounds the number. So the work is in
    proportion to the parties and not to the seats. Ties go to the lesser ``party``.
    """
    within = list(within)
    group = Window.partitionBy(*within)
    v, n = F.col(votes), F.col(seats)
    total, count = F.sum(v).over(group), F.count(F.lit(1)).over(group)
    few, many = n - count / 2, n + count / 2
    sized = (parties
             .withColumn("_low", F.when(few > 0, F.floor(v * few / total + 0.5)).otherwise(0).cast("long"))
             .withColumn("_high", F.floor(v * many / total + 0.5).cast("long") + 1)
             .withColumn("_open", n - F.sum("_low").over(group)))
    bids = (sized.select(*within, party, votes, "_open", F.explode(F.sequence("_low", "_high")).alias("_s"))
            .withColumn("_q", v / (2 * F.col("_s") + 1)))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("_q"), party))
    won = (bids.withColumn("_r", rank).filter(F.col("_r") <= F.col("_open"))
           .groupBy(*within, party).agg(F.count(F.lit(1)).alias("_won")))
    return (sized.join(won, [*within, party], "left")
            .withColumn(name, F.col("_low") + F.coalesce(F.col("_won"), F.lit(0)))
            .drop("_low", "_high", "_open", "_won"))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   repeat: float = REPEAT) -> DataFrame:
    """(key, source_size) rows with rank, weight and target in words.

    Sources in order of ``key`` take the weights in turn and share ``share`` times all words; a
    target stops at ``repeat`` times its source and the excess is shared anew by weight. All
    rounds at once: in order of capacity per weight, the first sources are full, and the rest
    share what those leave. One row per source; their running sums are the one single-task step.
    """
    order = Window.orderBy("key")
    ranked = sources.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    room = F.col("source_size") * F.lit(float(repeat))
    filled = ranked.withColumn("weight", weight).withColumn("room", room)
    fill = Window.orderBy(F.col("room") / F.col("weight"), "key")
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    stepped = filled.withColumn("_level", level)
    # the first source in fill order with room above its share of the rest sets the level for all
    fits = F.min(F.when(F.col("room") >= F.col("weight") * F.col("_level"), F.struct(F.col("room") / F.col("weight"), "key", F.col("_level").alias("l")))).over(every)["l"]
    target = F.least(F.col("room"), F.col("weight") * F.coalesce(fits, F.lit(float("inf"))))
    return stepped.withColumn("target", target).select("key", "source_size", "rank", "weight", "target")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK,
        shard_rows: int = SHARD_ROWS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, skip, taken.

    Blocks of ``block`` words are apportioned to the sources by target and to the shards of each
    source by words, both by Sainte-Laguë. A shard lays its documents end to end in a seeded
    order; its quota is taken from a seeded starting block on, around the end where need be, so
    that a shard is gone through ``repeat`` times at most, and all but the documents at the cut are
    taken whole. ``skip`` is the number of the document's words before the taken ones in its cut
    copy. Shards hold about ``shard_rows`` documents by hash of the id, so a source on any share
    of the rows is spread over tasks; only ids and sizes move, no texts. The source table is
    broadcast while it has at most ``SMALL_ROWS`` rows, else joined by key.

    Words are runs of other than ASCII white space. A null text has no words, a null source is a
    source of its own and the last, null ids sort first, rows repeated with one id are ordered by
    size and each taken on its own. Sources without words get nothing. Empty table: no rows. Other
    columns are ignored.
    """
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce(F.col("source"), F.lit("")).alias("s"))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
                        .select("doc_id", "size", key.alias("key")))
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = (source_targets(totals.drop("rows"), weights, share, repeat).join(totals.select("key", "rows"), "key")
               .withColumn("shards", F.ceil(F.col("rows") / F.lit(shard_rows)).cast("long"))
               .withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy()) / F.lit(block)).cast("long")))
    seated = apportion(sources.filter("source_size > 0"), [], "key", "target", "seats", "blocks")
    sources = materialize(sources.drop("seats").join(seated.select("key", "blocks"), "key", "left").fillna(0, ["blocks"]))

    small = sources.select("key", "rank", "shards", "blocks", "source_size", "target")
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        small = F.broadcast(small)
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = F.conv(F.substring(mark, 1, 12), 16, 10).cast("long")
    placed = (sized.join(small, "key").withColumn("mark", mark).withColumn("shard", F.pmod(number, F.col("shards"))))
    per_shard = placed.groupBy("key", "rank", "blocks", "shard").agg(F.sum("size").alias("words")).filter("words > 0")
    quotas = (apportion(per_shard, ["key"], "shard", "words", "blocks", "quota")
              .withColumn("length", F.ceil(F.col("words") / F.lit(block)).cast("long")))
    start = F.md5(F.concat_ws(":", F.lit(seed), F.col("rank").cast("string"), F.col("shard").cast("string")))
    quotas = quotas.select(
        "key", "shard", "words", F.least(F.col("quota") * block, F.col("words") * repeat).alias("quota"),
        (F.pmod(F.conv(F.substring(start, 1, 12), 16, 10).cast("long"), F.col("length")) * block).alias("from"))

    line = Window.partitionBy("key", "shard").orderBy("mark", "doc_id", "size")
    laid = placed.withColumn("at", F.sum("size").over(line) - F.col("size")).join(quotas, ["key", "shard"], "left")
    rounds, rest = F.floor(F.col("quota") / F.col("words")), F.col("quota") % F.col("words")
    end = F.col("at") + F.col("size")

    def overlap(low, high):
        return F.greatest(F.lit(0), F.least(end, high) - F.greatest(F.col("at"), low))

    wrapped = F.col("from") + rest - F.col("words")
    partly = overlap(F.col("from"), F.col("from") + rest) + overlap(F.lit(0), wrapped)
    skip = F.when(overlap(F.lit(0), wrapped) > 0, 0).otherwise(F.greatest(F.lit(0), F.col("from") - F.col("at")))
    taken = F.coalesce(rounds * F.col("size") + partly, F.lit(0)).cast("long")
    return (laid.withColumn("taken", taken).withColumn("skip", F.coalesce(skip, F.lit(0)).cast("long"))
            .select("doc_id", "size", "source_size", "target", "skip", "taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **params) -> DataFrame:
    """The mix as rows with the columns of ``docs``.

    A document taken k times whole stands k times; a cut copy holds the taken words, joined by one
    space, and its own ``chars_col`` where there is one. Rows of one id share their decision by size.
    """
    chosen = (mix(docs, id_col=id_col, text_col=text_col, **params).filter("taken > 0")
              .select(F.col("doc_id").alias("its_id"), F.col("size").alias("its_size"), "skip", "taken").dropDuplicates(["its_id", "its_size"]))
    row = F.col("row")
    keyed = whole_rows(docs).withColumn("id", row[id_col]).withColumn("size", word_count(row[text_col]))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("size") == F.col("its_size"))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = (keyed.join(chosen, same).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
            .withColumn("cut", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))))
    piece = F.array_join(F.slice(words(row[text_col]), (F.col("skip") + 1).cast("int"), F.col("cut").cast("int")), " ")
    rows = rows.withColumn("piece", F.when(F.col("cut") < F.col("size"), piece))
    columns = [F.coalesce(F.col("piece"), row[text_col]).alias(c) if c == text_col
               else F.when(F.col("piece").isNotNull(), F.length("piece").cast(t)).otherwise(row[c]).alias(c) if c == chars_col
               else row[c].alias(c) for c, t in docs.dtypes]
    return rows.select(*columns)
