"""Vector arithmetic on array columns."""

from pyspark.sql import Column, DataFrame
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero vectors give 0 and unequal lengths raise."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length")).isNull()
    scale = norm(a) * norm(b)
    return F.when(same & (scale > 0), dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / F.nullif(n, F.lit(0.0))).otherwise(x.cast("double")))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def mean_vector(df: DataFrame, keys: list[str], vector: str = "vector", name: str = "centroid") -> DataFrame:
    """Element-wise mean per key; sums of whole vectors combine on the map side, one row per key and task."""
    packed = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return packed.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*keys, vector_to_array("_m").alias(name))
