"""Connected components of forms sharing a code, inside a scope."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.skew import keyed_lookup
from parley.session import ensure_checkpoint_dir

MAX_ROUNDS = 60


def connected_forms(edges: DataFrame, scope: Sequence[str], form: str = "form", code: str = "code",
                    max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(scope, form, cluster_id): cluster_id is the least form of the component.

    Each round lowers a form's label to the least label among forms sharing a code with it and
    then jumps to its label's own label (one row per form, a plain join whose large labels Spark splits), so chains
    collapse in few rounds. Edges stay linear (one
    per form and code, never form x form). Rounds are cut with reliable checkpoints; the loop
    ends when no label changed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    scope = list(scope)
    keys = [*scope, form]
    held = edges.select(*scope, form, code).distinct().checkpoint()
    # a code held by one form joins nothing: only shared codes take part in the rounds
    shared = held.groupBy(*scope, code).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    pairs = keyed_lookup(held, shared, [*scope, code], [form]).checkpoint()
    labels = pairs.groupBy(*keys).agg(F.min(form).alias("label"))
    for _ in range(max_rounds):
        at_code = pairs.join(labels, keys)
        code_min = at_code.groupBy(*scope, code).agg(F.min("label").alias("_m"))
        stepped = (keyed_lookup(at_code, code_min, [*scope, code], [form])
                   .groupBy(*keys).agg(F.min("label").alias("_old"), F.min("_m").alias("label")))
        jump = stepped.select(*scope, F.col(form).alias("label"), F.col("label").alias("_root"))
        labels = stepped.join(jump, [*scope, "label"]).select(
            *keys, "_old", F.least("label", "_root").alias("label")).checkpoint()
        moved = labels.filter("label <> _old").limit(1).count()
        labels = labels.drop("_old")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    alone = held.select(*keys).distinct().join(labels.select(*keys), keys, "left_anti").withColumn("label", F.col(form))
    return labels.unionByName(alone).withColumnRenamed("label", "cluster_id")
