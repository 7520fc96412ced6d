"""Preprocessing, decomposition and clustering through Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import q
from tabulon.operators.ranking import running_sum
from tabulon.session import shared_table


def scale_columns(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Z-score (population sd, as common scalers use) and min-max per column.

    The statistics are one aggregation, read back as scalar subqueries."""
    stats = df.agg(*[e for c in cols for e in (
        F.avg(q(c)).alias(f"m_{c}"), F.stddev_pop(q(c)).alias(f"s_{c}"),
        F.min(q(c)).alias(f"lo_{c}"), F.max(q(c)).alias(f"hi_{c}"))])
    out = [q(k) for k in (keep or [])]
    for c in cols:
        m, s = stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
        lo, hi = stats.select(f"lo_{c}").scalar(), stats.select(f"hi_{c}").scalar()
        out.append(F.try_divide(q(c) - m, s).alias(f"z_{c}"))
        out.append(F.try_divide(q(c) - lo, hi - lo).alias(f"mm_{c}"))
    return df.select(*out)


#: A value held by more than one row in this many is joined apart from the rest, so no
#: task gets more than that share of the rows for one value, and at most this many values
#: are broadcast.
HOT_SHARE = 1000


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """The distinct non-null values of a column with their index: value, n, idx (from 0, by
    count descending, then value).  Counts collapse map-side, and the indexes are running
    sums over range partitions: nothing but one sum per partition meets in one place."""
    counts = (df.filter(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_less", -F.col("n")))
    ranked = running_sum(counts, ["_less", "value"], F.lit(1), "_at")
    return ranked.select("value", "n", (F.col("_at") - 1).cast("long").alias("idx"))


def string_index(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Frequency-ordered index (ties alphabetical) as a column of doubles; a null gets
    the number of distinct values.

    The dictionary is a table and never on the driver.  Values that hold more than one row in
    ``HOT_SHARE`` (so at most that many) are joined by broadcast; the others, and only they,
    are shuffled by value."""
    out_col = out_col or f"{col}_index"
    words = shared_table(dictionary(df, col), "dictionary")
    sums = words.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    hot = F.col("n") * HOT_SHARE > sums["n"]
    names = [c for c in df.columns if c != out_col]
    key = "_value"
    while key in names:
        key += "_"
    often, seldom = [words.filter(x).select(F.col("value").alias(key), F.col("idx").cast("double").alias(out_col))
                     for x in (hot, ~hot)]
    base = df.select(*[q(c) for c in names])
    same = q(col) == F.col(key)
    out = base.join(F.broadcast(often), same).drop(key)
    rest = base.filter(q(col).isNotNull()).join(F.broadcast(often.select(key)), same, "left_anti")
    out = out.unionByName(rest.join(seldom, same).drop(key))
    return out.unionByName(base.filter(q(col).isNull()).withColumn(out_col, F.lit(float(sums["k"]))))


def one_hot(df: DataFrame, col: str) -> DataFrame:
    """Index and one-hot vector (sparse) of a string column.  The last place of the
    vector is null's and is left out, so a null is the zero vector."""
    from pyspark.ml.feature import OneHotEncoder
    idx = string_index(df, col, f"{col}_index")
    # The encoder sizes its vectors by the greatest index plus one, less the dropped last one.
    top = idx.unionByName(idx.limit(1).withColumn(f"{col}_index", F.lit(float(distinct_values(df, col)))))
    return OneHotEncoder(inputCols=[f"{col}_index"], outputCols=[f"{col}_vec"]).fit(top).transform(idx)


def distinct_values(df: DataFrame, col: str) -> int:
    return df.agg(F.count_distinct(q(col))).first()[0]


def _vectors(df: DataFrame, array_col: str):
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def pca(df: DataFrame, array_col: str, k: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Principal components of an array column (distributed covariance)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    v = _vectors(df, array_col)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(v)
    arr = vector_to_array(F.col("pcs"))
    return model.transform(v).select(*(keep or []), *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


def kmeans(df: DataFrame, array_col: str, k: int = 4, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """K-means cluster per row (Spark ML, k-means|| init, fixed seed)."""
    from pyspark.ml.clustering import KMeans
    v = _vectors(df, array_col)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).select(*(keep or []), "cluster")
