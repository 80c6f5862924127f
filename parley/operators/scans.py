"""Ordered scans over a key whose rows may not fit one task.

``lag``, running sums and "last value seen" over ``partitionBy(session)`` put a whole session in
one task. Here every scan runs twice: once inside a block of the session (a monotone slice of its
order), once over one summary row per block, and the summary's carry is joined back. A session
holding a third of the table is spread over as many tasks as it has blocks.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


@dataclass(frozen=True)
class Prev:
    """The expression on the row just before (a null value stays null)."""

    expr: Column


@dataclass(frozen=True)
class Next:
    """The expression on the row just after."""

    expr: Column


@dataclass(frozen=True)
class RunSum:
    """Sum over all rows before, with the current one when ``inclusive``."""

    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunMax:
    """Maximum over all rows strictly before."""

    expr: Column


@dataclass(frozen=True)
class LastSeen:
    """Latest non-null value strictly before the row (or up to it when ``inclusive``)."""

    expr: Column
    inclusive: bool = False


@dataclass(frozen=True)
class NextSeen:
    """Earliest non-null value strictly after the row (or from it when ``inclusive``)."""

    expr: Column
    inclusive: bool = False


def block_of(column: str | Column, width: int) -> Column:
    """Slice number of a position or a time: monotone, so blocks keep the order."""
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(col / F.lit(width)).cast("long")


def _next_seen(column: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Earliest non-null value strictly after the row.

    A frame that runs to the end of a partition is computed anew for each row, so its work grows with
    the square of the partition; this ``lead`` goes over the rows once.
    """
    by, along = (", ".join(f"`{c}`" for c in names) for names in (keys, order))
    return F.expr(f"lead(`{column}`) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY {along})")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, **specs) -> DataFrame:
    """Add one column per spec, computed over ``keys`` in ``order``, block by block.

    ``order`` must be a total order and ``block`` must not decrease along it.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn(BLOCK, block)
    for name, spec in specs.items():
        base = base.withColumn(f"_in_{name}", spec.expr)

    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    before = (Window.unboundedPreceding, -1)
    rank = F.struct(*order)

    totals, carries, local, final = [], [], base, {}
    for name, spec in specs.items():
        value, seen = F.col(f"_in_{name}"), F.col(f"_in_{name}").isNotNull()
        here, total, carry = f"_here_{name}", f"_total_{name}", f"_carry_{name}"
        if isinstance(spec, Prev):
            local = local.withColumn(here, F.lag(F.struct(value.alias("v"))).over(inside))
            totals.append(F.max_by(F.struct(value.alias("v")), rank).alias(total))
            carries.append(F.lag(total).over(across).alias(carry))
            final[name] = F.coalesce(F.col(here), F.col(carry))["v"]
        elif isinstance(spec, Next):
            local = local.withColumn(here, F.lead(F.struct(value.alias("v"))).over(inside))
            totals.append(F.min_by(F.struct(value.alias("v")), rank).alias(total))
            carries.append(F.lead(total).over(across).alias(carry))
            final[name] = F.coalesce(F.col(here), F.col(carry))["v"]
        elif isinstance(spec, RunSum):
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
            local = local.withColumn(here, F.sum(value).over(frame))
            totals.append(F.sum(value).alias(total))
            carries.append(F.sum(total).over(across.rowsBetween(*before)).alias(carry))
            final[name] = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
        elif isinstance(spec, RunMax):
            local = local.withColumn(here, F.max(value).over(inside.rowsBetween(*before)))
            totals.append(F.max(value).alias(total))
            carries.append(F.max(total).over(across.rowsBetween(*before)).alias(carry))
            final[name] = F.greatest(F.col(here), F.col(carry))
        elif isinstance(spec, LastSeen):
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
            local = local.withColumn(here, F.last(value, ignorenulls=True).over(frame))
            totals.append(F.max_by(value, F.when(seen, rank)).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(across.rowsBetween(*before)).alias(carry))
            final[name] = F.coalesce(F.col(here), F.col(carry))
        elif isinstance(spec, NextSeen):
            following = _next_seen(f"_in_{name}", [*keys, BLOCK], order)
            local = local.withColumn(here, F.coalesce(value, following) if spec.inclusive else following)
            totals.append(F.min_by(value, F.when(seen, rank)).alias(total))
            carries.append(_next_seen(total, keys, [BLOCK]).alias(carry))
            final[name] = F.coalesce(F.col(here), F.col(carry))
        else:
            raise TypeError(f"unknown scan {spec!r}")

    summary = base.groupBy(*keys, BLOCK).agg(*totals).select(*keys, BLOCK, *carries)
    joined = local.join(summary, [*keys, BLOCK])
    return joined.select(*df.columns, *[col.alias(name) for name, col in final.items()])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least in ``order``; combines on the map side, so hot keys are safe."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def later_copies(df: DataFrame, keys: Sequence[str], order: str, block: Column) -> DataFrame:
    """Rows that are not the first of their key, without gathering a key in one task.

    Inside a (key, block) every row but the first is a later copy. The block firsts, at most one
    per block, are then ranked among themselves.
    """
    cut = df.withColumn(BLOCK, block)
    ranked = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(order)))
    inner = ranked.filter("_rn > 1")
    heads = ranked.filter("_rn = 1").withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return inner.unionByName(heads.filter("_rn > 1")).select(*df.columns)


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """1-based row number over ``keys`` in ``order``, block by block."""
    return scan(df, keys, order, block, **{name: RunSum(F.lit(1).cast("long"))})


def ordered_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column,
                 block: Column, sep: str, name: str = "text") -> DataFrame:
    """Text of each key joined in order: parts per block first, then the parts."""
    part = (df.withColumn(BLOCK, block)
            .groupBy(*keys, BLOCK)
            .agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))).alias("_l"))
            .select(*keys, BLOCK, F.array_join(F.transform("_l", lambda s: s["_t"]), sep).alias("_p")))
    return (part.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(BLOCK, "_p"))).alias("_l"))
            .select(*keys, F.array_join(F.transform("_l", lambda s: s["_p"]), sep).alias(name)))
