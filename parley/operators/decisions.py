"""Decisions on waiting corrections, made durable as one commit.

A store keeps four tables: ``words``, ``waiting`` (``WAITING``, one row per place of a group), the
``dictionary`` (``DICTIONARY``) and the ``audit`` (``AUDIT``). A batch of decisions rewrites the
parts of the tables that it touches beside the old ones, and counts once its commit file is there:
readers see all of a batch or nothing of it, wherever a writer dies. Older versions stay readable.

Parts are hashes of the recording (of the world for the dictionary), so a batch reads and rewrites
the touched parts only; give ``create`` as many parts as leave a part of words near a gigabyte.
"""

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from parley.operators.corrections import HISTORY, apply_at, shape_changes
from parley.operators.names import AT, SEG
from parley.operators.registry import read_or_empty
from parley.operators.skew import keyed_lookup
from parley.session import staged

WAITING = "session_id string, key string, world string, heard string, canonical string, state string, seg_pos int, word_index int"
DICTIONARY = "world string, canonical string, variant string, since long"
AUDIT = ("version long, at timestamp, kind string, session_id string, key string, world string, heard string, canonical string, "
         "n_places long, provenance string")
MANIFEST = "version long, name string, part int, run string"
COMMIT = "version long, run string, parts int, words_schema string, previous long"
STAGE = "namefix_bless"
GROUP = ["session_id", "key"]
PLACE = [*GROUP, "state", "seg_pos", "word_index"]
BLOCK = 4096
SHARDS = 64          # tasks that may write one part's recordings


class Conflict(RuntimeError):
    """Another batch was committed on the version this one started from."""


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key), F.lit(""))), F.lit(parts)).cast("int").alias("part")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _write(df: DataFrame, path: str, name: str, run: str, spread: Sequence[str] = ()) -> None:
    """Write the parts of one table; ``spread`` keeps a part, and one long recording, off a single task.

    Spark puts small shares together, so a small table still has one file a part.
    """
    shard = [F.pmod(F.xxhash64("session_id"), F.lit(SHARDS))] if spread else []
    df.repartition("part", *shard, *[F.floor(F.col(c) / BLOCK) for c in spread]).write.partitionBy("part").parquet(f"{path}/{name}/run={run}")


def _publish(spark: SparkSession, path: str, row: tuple) -> None:
    """Make a version count: one row in one file, which appears whole or not at all.

    Of two writers of one version the one with the lesser run counts, and the other learns it here.
    """
    this = F.col("version") == row[0]
    if versions(spark, path).filter(this).limit(1).count():
        raise Conflict(f"version {row[0]} is there already")
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    if versions(spark, path).filter(this).first()["run"] != row[1]:
        raise Conflict(f"version {row[0]} was made by another writer")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All committed versions: ``COMMIT``."""
    rest = _columns(COMMIT)[1:]
    rows = read_or_empty(spark, f"{path}/commits", COMMIT)
    return rows.groupBy("version").agg(F.min_by(F.struct(*rest), "run").alias("_r")).select("version", "_r.*")


def head(spark: SparkSession, path: str) -> dict:
    """The latest commit."""
    row = versions(spark, path).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no decision store at {path}")
    return row.asDict()


def _parts(spark: SparkSession, path: str, name: str, version: int | None) -> DataFrame:
    """(part, run): where each part of a table stands at a version."""
    made = versions(spark, path)
    made = made if version is None else made.filter(F.col("version") <= version)
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter(F.col("name") == name)
    return (rows.join(made.select("run"), "run", "left_semi").groupBy("part").agg(F.max_by("run", "version").alias("run")))


def _table(spark: SparkSession, path: str, name: str, version: int | None) -> DataFrame:
    schema = {"waiting": WAITING, "dictionary": DICTIONARY}.get(name)
    if schema is None:
        fields = StructType.fromJson(json.loads(head(spark, path)["words_schema"]))
    else:
        fields = StructType.fromDDL(schema)
    written = spark.read.schema(StructType(list(fields.fields)).add("run", StringType()).add("part", IntegerType())).parquet(f"{path}/{name}")
    return written.join(_parts(spark, path, name, version), ["part", "run"], "left_semi").drop("run")


def state(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the store as of a version, by default the latest."""
    if name == "audit":
        made = versions(spark, path)
        made = made if version is None else made.filter(F.col("version") <= version)
        rows = spark.read.schema(f"{AUDIT}, run string").parquet(f"{path}/audit")
        return rows.join(made.select("run"), "run", "left_semi").drop("run")
    return _table(spark, path, name, version).drop("part")


def create(words: DataFrame, waiting: DataFrame, dictionary: DataFrame, path: str, parts: int = 64) -> None:
    """Start a store as version 0. Of rows that name one place of a group twice, one stays.

    ``words`` has AT and word, and may have original, corrections and other columns; ``waiting`` the
    columns of ``WAITING`` (state: pending, auto or rejected); ``dictionary`` world, canonical, variant.
    """
    spark, run = words.sparkSession, uuid4().hex
    if "original" not in words.columns:
        words = words.withColumn("original", F.lit(None).cast("string"))
    if "corrections" not in words.columns:
        words = words.withColumn("corrections", F.array().cast(HISTORY))
    once = waiting.groupBy(*PLACE).agg(F.min(F.struct("world", "heard", "canonical")).alias("_r")).select(*PLACE, "_r.*")
    typed = once.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in WAITING.split(", ")])
    held = dictionary.select("world", "canonical", "variant", F.lit(0).cast("long").alias("since"))
    _write(words.withColumn("part", _part("session_id", parts)), path, "words", run, ["seg_pos"])
    _write(typed.withColumn("part", _part("session_id", parts)), path, "waiting", run, ["seg_pos"])
    _write(held.withColumn("part", _part("world", parts)), path, "dictionary", run)
    spark.createDataFrame([], AUDIT).write.parquet(f"{path}/audit/run={run}")
    every = spark.range(parts).select(F.lit(0).cast("long").alias("version"), F.explode(F.array(*[F.lit(n) for n in ("words", "waiting", "dictionary")])).alias("name"),
                                      F.col("id").cast("int").alias("part"))
    every.coalesce(1).write.parquet(f"{path}/manifest/run={run}")
    _publish(spark, path, (0, run, parts, json.dumps(words.schema.jsonValue()), None))


def _meet(waiting: DataFrame, asked: DataFrame, spots: DataFrame | None) -> DataFrame:
    """Places of the groups that decisions are about, and whether a decision takes the place."""
    first = asked.filter("_first").select("ordinal", *GROUP, "action", F.trim("action_canonical").alias("_own"))
    need = F.when(F.col("action") == "demote", "auto").otherwise("pending")
    met = keyed_lookup(waiting, first, GROUP, ["seg_pos", "word_index"]).filter(F.col("state") == need)
    met = met.withColumn("_canon", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("canonical")))
    if spots is None:
        return met.withColumn("_taken", F.lit(True))
    wanted = spots.select(*GROUP, "seg_pos", "word_index").distinct()
    met = keyed_lookup(met, wanted.select(*GROUP).distinct().withColumn("_some", F.lit(True)), GROUP, ["seg_pos", "word_index"], "left")
    met = met.join(wanted.withColumn("_pick", F.lit(True)), [*GROUP, "seg_pos", "word_index"], "left")
    return met.withColumn("_taken", (F.col("action") != "bless") | F.col("_some").isNull() | F.col("_pick").isNotNull()).drop("_some", "_pick")


def _grown(held: DataFrame, full: DataFrame, version: int) -> DataFrame:
    """Dictionary rows to add: variants new to their world and spelling, compared without case.

    A spelling the dictionary has keeps its written form; of a new one the first decision's form is taken.
    """
    low = held.select("world", F.lower("canonical").alias("_c"), F.lower("variant").alias("_v"), "canonical")
    told = full.withColumn("_c", F.lower("_canon")).withColumn("_v", F.lower("heard"))
    spelled = told.groupBy("world", "_c").agg(F.min_by("_canon", "ordinal").alias("_new")).join(
        low.groupBy("world", "_c").agg(F.min("canonical").alias("_old")), ["world", "_c"], "left")
    fresh = (told.filter("_c <> _v").join(low.select("world", "_c", "_v"), ["world", "_c", "_v"], "left_anti")
             .groupBy("world", "_c", "_v").agg(F.min_by("heard", "ordinal").alias("variant")))
    return fresh.join(spelled, ["world", "_c"]).select(
        "world", F.coalesce("_old", "_new").alias("canonical"), "variant", F.lit(version).cast("long").alias("since"))


def decide(spark: SparkSession, path: str, decisions: DataFrame, spots: DataFrame | None = None, at: datetime | None = None) -> DataFrame:
    """Carry out a batch of decisions as one new version; returns what became of each.

    ``decisions``: ordinal (unique), session_id, key, action, canonical (null or blank: the group's own).

    * ``bless`` rewrites the group's places in ``words``, takes them off the queue and, where the whole
      group was blessed and its world is known, adds the heard form to the dictionary. ``spots``
      (session_id, key, seg_pos, word_index) names the places where only some are meant: the rest
      keeps waiting under the decided spelling and the dictionary stays as it is.
    * ``reject`` takes a waiting group off the queue, ``demote`` puts an automatic one on it.

    Per group the first decision of a batch acts. Result: the decisions with ``status`` (blessed,
    partly blessed, rejected, demoted, no such group, no matching place, deferred, unknown action)
    and ``n_places`` (words rewritten, or places moved). Without any effect no version is made. A
    batch whose start version is no longer the latest raises ``Conflict`` and changes nothing.
    """
    base = head(spark, path)
    version, parts, run = base["version"] + 1, base["parts"], uuid4().hex
    at = at or datetime.now(timezone.utc)
    known = F.col("action").isin("bless", "reject", "demote")
    leads = decisions.filter(known).groupBy(*GROUP).agg(F.min("ordinal").alias("_lead"))
    asked = staged(decisions.select("ordinal", *GROUP, "action", F.col("canonical").cast("string").alias("action_canonical"))
                   .join(leads, GROUP, "left").withColumn("_first", known & F.coalesce(F.col("ordinal") == F.col("_lead"), F.lit(True))).drop("_lead"))
    here = asked.select(_part("session_id", parts)).distinct()
    waiting = _table(spark, path, "waiting", base["version"]).join(here, "part", "left_semi")
    met = staged(_meet(waiting, asked, spots))
    groups = staged(met.groupBy("ordinal", *GROUP, "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_taken").alias("n_taken"), F.min("_canon").alias("_canon"), F.min("world").alias("world"),
        F.min(F.when(F.trim("heard") != "", F.col("heard")).otherwise(F.col("key"))).alias("heard")))
    acting = groups.filter("n_taken > 0")
    blessed = acting.filter("action = 'bless'")
    places = staged(met.filter("action = 'bless' and _taken").groupBy(*AT).agg(F.min(F.struct("ordinal", F.col("_canon").alias("canonical"))).alias("_r"))
                    .select(*AT, "_r.*").withColumn("part", _part("session_id", parts)))
    old = _table(spark, path, "words", base["version"])
    written = places.join(old.select("part", *AT), ["part", *AT], "left_semi").groupBy("ordinal").agg(F.count(F.lit(1)).alias("_words"))
    done = staged(acting.join(written, "ordinal", "left").withColumn(
        "n_places", F.when(F.col("action") == "bless", F.coalesce("_words", F.lit(0).cast("long"))).otherwise(F.col("n_taken"))).drop("_words"))
    outcome = asked.join(groups.select("ordinal", "n", "n_taken"), "ordinal", "left").join(done.select("ordinal", "n_places"), "ordinal", "left")
    status = (F.when(~F.coalesce(known, F.lit(False)), "unknown action").when(~F.col("_first"), "deferred").when(F.col("n").isNull(), "no such group")
              .when(F.col("n_taken") == 0, "no matching place").when(F.col("action") == "reject", "rejected")
              .when(F.col("action") == "demote", "demoted").when(F.col("n_taken") < F.col("n"), "partly blessed").otherwise("blessed"))
    outcome = staged(outcome.select("ordinal", *GROUP, "action", status.alias("status"), F.coalesce("n_places", F.lit(0).cast("long")).alias("n_places")))
    if not done.limit(1).count():
        return outcome
    touched = []

    def mark(name: str, rows: DataFrame, key: str) -> DataFrame:
        found = rows.select(_part(key, parts)).distinct()
        touched.append(found.select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), "part"))
        return found

    before = old.join(mark("words", places, "session_id"), "part", "left_semi")
    after = apply_at(before, places.select(*AT, "canonical"), STAGE)
    fields = StructType.fromJson(json.loads(base["words_schema"]))
    _write(after.select(*fields.names, "part"), path, "words", run, ["seg_pos"])
    new = spark.read.schema(StructType(list(fields.fields)).add("part", IntegerType())).parquet(f"{path}/words/run={run}")
    if shape_changes(before, new).limit(1).count():
        raise RuntimeError("segments or word counts would change")

    queue = _table(spark, path, "waiting", base["version"]).join(mark("waiting", acting, "session_id"), "part", "left_semi")
    moves = keyed_lookup(met.select(*PLACE, "ordinal", "_taken"), acting.select("ordinal", "action", "_canon"), ["ordinal"], ["seg_pos", "word_index"])
    queue = queue.join(moves.drop("ordinal"), PLACE, "left").filter("not coalesce(action = 'bless' and _taken, false)")
    queue = (queue.withColumn("canonical", F.when(F.col("action") == "bless", F.col("_canon")).otherwise(F.col("canonical")))
             .withColumn("state", F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "demote", "pending").otherwise(F.col("state"))))
    _write(queue.select(*_columns(WAITING), "part"), path, "waiting", run, ["seg_pos"])

    full = blessed.filter("n_taken = n and world <> ''")
    held = _table(spark, path, "dictionary", base["version"]).join(mark("dictionary", full, "world"), "part", "left_semi")
    added = _grown(held, full, version).withColumn("part", _part("world", parts))
    _write(held.select(*_columns(DICTIONARY), "part").unionByName(added), path, "dictionary", run)

    kind = F.when(F.col("action") == "bless", "blessed").when(F.col("action") == "reject", "rejected").otherwise("demoted")
    facts = [F.lit(version).cast("long").alias("version"), F.lit(at).cast("timestamp").alias("at")]
    whole = done.select(*facts, kind.alias("kind"), *GROUP, "world", "heard", F.col("_canon").alias("canonical"), "n_places",
                        F.when(F.col("action") == "demote", "human: one sound, several referents").alias("provenance"))
    learnt = full.select(*facts, F.lit("variant").alias("kind"), *GROUP, "world", "heard", F.col("_canon").alias("canonical"),
                         F.lit(None).cast("long").alias("n_places"), F.concat(F.lit("bless:"), "session_id").alias("provenance"))
    whole.unionByName(learnt).write.parquet(f"{path}/audit/run={run}")
    manifest = touched[0].unionByName(touched[1]).unionByName(touched[2])
    manifest.coalesce(1).write.parquet(f"{path}/manifest/run={run}")
    _publish(spark, path, (version, run, parts, base["words_schema"], base["version"]))
    return outcome


def touched_segments(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(session_id, seg_pos): segments whose words a version rewrote, for ``corrections.heal_text``; only its parts are read."""
    made = versions(spark, path).filter(F.col("version") == version).select("run")
    parts = (spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter("name = 'words'")
             .join(made, "run", "left_semi").select("part"))
    now, then = (_table(spark, path, "words", v).join(parts, "part", "left_semi") for v in (version, version - 1))
    pairs = now.select(*AT, "word").join(then.select(*AT, F.col("word").alias("_w")), AT)
    return pairs.filter(~F.col("word").eqNullSafe(F.col("_w"))).select(*SEG).distinct()
