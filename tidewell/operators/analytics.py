"""Page views, unique visitors, top k and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_views(df: DataFrame, page: str, window_ms: int, ms: str = "ms") -> DataFrame:
    """At each view the views of its page with ``time > now - window``."""
    by = Window.partitionBy(page).orderBy(ms).rangeBetween(-(window_ms - 1), 0)
    return df.withColumn("views", F.count("*").over(by))


def views_at(df: DataFrame, page: str, now_ms: int, window_ms: int, ms: str = "ms") -> DataFrame:
    return df.where((F.col(ms) > now_ms - window_ms) & (F.col(ms) <= now_ms)).groupBy(page).agg(F.count("*").alias("views"))


def views_between(df: DataFrame, page: str, start_ms: int, end_ms: int, ms: str = "ms") -> DataFrame:
    """Views in ``[start, end)``; a blank page or an empty range has none."""
    return df.where((F.trim(page) != "") & (F.col(ms) >= start_ms) & (F.col(ms) < end_ms)).groupBy(page).agg(F.count("*").alias("views"))


def view_statistics(df: DataFrame, page: str) -> DataFrame:
    """Pages and all views; aggregated by page first, so that no task sees all rows."""
    return df.groupBy(page).agg(F.count("*").alias("n")).agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_views"))


def unique_visitors(df: DataFrame, page: str, visitor: str, bucket_ms: int, start_ms: int, end_ms: int, ms: str = "ms", exact: bool = True) -> DataFrame:
    """Visitors of a page in the whole buckets that ``[start, end]`` touches; sketches of buckets are merged if not exact."""
    first, last = start_ms // bucket_ms * bucket_ms, end_ms // bucket_ms * bucket_ms + bucket_ms
    own = df.where((F.col(ms) >= first) & (F.col(ms) < last))
    if exact:
        return own.select(page, visitor).distinct().groupBy(page).agg(F.count(visitor).alias("visitors"))
    sketches = own.groupBy(page, (F.col(ms) - F.pmod(F.col(ms), F.lit(bucket_ms))).alias("bucket")).agg(F.hll_sketch_agg(visitor).alias("s"))
    return sketches.groupBy(page).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("visitors"))


def top_k(df: DataFrame, category: str, item: str, weight: str, k: int, scale: int = 2) -> DataFrame:
    """The k items of most weight in each category, with ranks from 1; ties go to the greater item."""
    scores = df.groupBy(category, item).agg(F.sum(F.col(weight).cast(f"decimal(18,{scale})")).cast(f"decimal(38,{scale})").alias("score"))
    by = Window.partitionBy(category).orderBy(F.desc("score"), F.desc(item))
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ranks(df: DataFrame, wanted: DataFrame, category: str, item: str, weight: str, scale: int = 2) -> DataFrame:
    """Rank and score of wanted (category, item) rows; -1 and 0 where there is no such item."""
    scores = df.groupBy(category, item).agg(F.sum(F.col(weight).cast(f"decimal(18,{scale})")).cast(f"decimal(38,{scale})").alias("score"))
    by = Window.partitionBy(category).orderBy(F.desc("score"), F.desc(item))
    ranked = scores.withColumn("rank", F.row_number().over(by))
    return wanted.join(ranked, [category, item], "left").withColumn("rank", F.coalesce("rank", F.lit(-1))).withColumn("score", F.coalesce("score", F.lit(0)).cast(f"decimal(38,{scale})"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """The value at place floor(q * (n - 1)) of the ascending values; q is held to [0, 1]. Values are ranked, not collected."""
    by = Window.partitionBy(*keys)
    numbered = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(by.orderBy(value)) - 1).alias("__i"), F.count("*").over(by).alias("__n"))
    picks = [F.max(F.when(F.col("__i") == F.floor(F.lit(min(1.0, max(0.0, q))) * (F.col("__n") - 1)), F.col(value))).alias(name) for name, q in qs.items()]
    return numbered.groupBy(*keys).agg(*picks)


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """From one mergeable sketch a group."""
    s = df.groupBy(*keys).agg(F.kll_sketch_agg_double(value).alias("s"))
    return s.select(*keys, *[F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(n) for n, q in qs.items()])


def metric_rollup(df: DataFrame, name: str = "name", kind: str = "kind", value: str = "value", seq: str = "seq") -> DataFrame:
    """Counters sum, gauges keep the last value, meters count, histograms and timers show count, last, min, max and mean."""
    return df.groupBy(name, kind).agg(
        F.when(F.first(kind) == "counter", F.sum(value)).when(F.first(kind) == "meter", F.count(value).cast("double")).otherwise(F.max_by(value, seq)).alias("value"),
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"),
    )
