"""Function transforms: caller code applied the Spark way.

``function_transform`` takes a DataFrame → DataFrame function (Spark columns,
fully optimised by Catalyst).  ``grouped_function`` runs a pandas function per
key (or over many whole groups at a time) with ``applyInPandas``; for keys that can be hot, pass ``partial`` and
``final`` so each key is first split over salt buckets and the partial
results are merged — no key is ever loaded whole into one task.
``batch_function`` runs a row-local pandas function per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import shared_table


def _check(result, what="transform_data") -> DataFrame:
    if not isinstance(result, DataFrame):
        raise TypeError(f"{what} must return a DataFrame, got {type(result).__name__}")
    return result


def function_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None,
                       fallback: Callable[[DataFrame], DataFrame] | None = None,
                       validate: bool = True) -> DataFrame:
    """Apply ``fn``; on failure run ``fallback`` once, else raise both.

    ``validate`` computes the whole result here, once, into the shared folder, so an
    error in any row is seen now rather than at the caller's first action."""
    if fn is None:
        raise ValueError("Function 'transform_data' not found")

    def run(f):
        out = _check(f(df))
        if validate:
            out = shared_table(out, "function")
        return out

    try:
        return run(fn)
    except Exception as first:  # noqa: BLE001
        if fallback is None:
            raise
        try:
            return run(fallback)
        except Exception as second:  # noqa: BLE001
            raise RuntimeError(f"Function failed: {first}; fallback failed: {second}") from second


def _packed(keys, fn):
    """Run ``fn`` per key over one pandas frame holding many keys."""
    import pandas as pd

    def run(pdf):
        parts = [fn(g) for _, g in pdf.groupby(keys, sort=False, dropna=False)]
        return pd.concat(parts, ignore_index=True) if parts else pdf.iloc[0:0]
    return run


#: Rows of one group that :func:`grouped_function` hands to a function as a whole.
MAX_GROUP_ROWS = 1_000_000


def pack_bucket_count(df: DataFrame, pack_rows: int, total: int | None = None) -> int:
    """Buckets for about ``pack_rows`` rows each (one row count, unless ``total`` gives
    it), never fewer than four per shuffle partition."""
    width = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-(df.count() if total is None else total) // pack_rows))


def grouped_function(df: DataFrame, keys: list[str], fn, schema: str,
                     partial=None, partial_schema: str | None = None, partial_rows: int = 500_000,
                     pack_buckets: int | None = None, pack_rows: int | None = None,
                     max_group_rows: int | None = MAX_GROUP_ROWS, many_groups: bool = False) -> DataFrame:
    """Pandas function per key.

    Without ``partial`` the function sees each whole group: use it for keys
    whose groups are bounded (an order's lines, a user's session).  The bound is
    ``max_group_rows``: the keys are counted first (a partial aggregation), and a greater
    group raises before any is loaded (None: not checked).  With
    ``partial`` (pandas → pandas of partial results, schema
    ``partial_schema``) each task reduces its own rows per key, about
    ``partial_rows`` at a time and without a shuffle, and ``fn`` then merges the
    partial frames of each key.

    ``pack_buckets`` hashes many small keys into each task-level group and
    applies ``fn`` per key inside it, which removes the per-group overhead
    when there are millions of tiny groups (keys must then be bounded).
    ``pack_rows`` sizes the buckets from the data instead: about that many
    rows per bucket (a row count sets the number of buckets, never fewer
    than four per shuffle partition), so a packed group stays the same size
    however large the table grows.

    With ``many_groups`` a packed frame goes to ``fn`` as it is: all rows of many keys, of
    which ``fn`` makes the rows of every key (pandas' own grouped functions), so that no
    Python call is made per key."""
    if many_groups and (partial is not None or not (pack_rows or pack_buckets)):
        raise ValueError("many_groups goes with pack_rows or pack_buckets")
    if partial is None:
        if max_group_rows is not None or pack_rows:
            sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            total, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
            if max_group_rows is not None and most > max_group_rows:
                raise ValueError(f"A group of {keys} has {most} rows, more than max_group_rows ({max_group_rows}); "
                                 "reduce the rows of each task with partial")
            if pack_rows:
                pack_buckets = pack_bucket_count(df, pack_rows, total)
        if pack_buckets:
            bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(pack_buckets))
            run = fn if many_groups else _packed(keys, fn)
            return (df.withColumn("_bucket", bucket).groupBy("_bucket")
                    .applyInPandas(lambda pdf: run(pdf.drop(columns=["_bucket"])), schema))
        return df.groupBy(*keys).applyInPandas(fn, schema)
    def reduce_rows(batches):
        import pandas as pd
        reduce, held, n = _packed(keys, partial), [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= partial_rows:
                yield reduce(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield reduce(pd.concat(held, ignore_index=True))

    return df.mapInPandas(reduce_rows, partial_schema).groupBy(*keys).applyInPandas(fn, schema)


def batch_function(df: DataFrame, fn, schema: str) -> DataFrame:
    """A row-local pandas function over Arrow batches."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)
