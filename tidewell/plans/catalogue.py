"""Every operator as a query over the tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.operators import aggregates, analytics, cdc, cep, joins, log, registry, reliability, windows
from tidewell.operators.table import UpsertTable
from tidewell.session import epoch_ms, events, load
from tidewell.sources import sources

HOUR = 3_600_000
DAY = 24 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The events table as the SQL side sees it.
EV = "(SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, props FROM events)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$EV", EV)
        return f

    return add


# Stateless

@query("SELECT event_id AS seq, user_id * 10 + 1 AS mapped, upper(event_type) AS kind FROM events")
def map_projection(spark, d):
    return events(spark, d).select("seq", (F.col("user_id") * 10 + 1).alias("mapped"), F.upper("event_type").alias("kind"))


@query("SELECT event_id AS seq, value FROM events WHERE event_type = 'purchase' AND value > 50")
def filter_predicate(spark, d):
    return events(spark, d).where("event_type = 'purchase' and value > 50").select("seq", "value")


@query("SELECT seq, t AS token FROM (SELECT event_id AS seq, unnest(string_split(event_type || ' ' || CAST(user_id AS VARCHAR), ' ')) AS t FROM events)")
def flat_map_tokens(spark, d):
    return events(spark, d).select("seq", F.explode(F.split(F.concat_ws(" ", "event_type", "user_id"), " ")).alias("token"))


@query("SELECT doc_id, t AS token FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents)")
def flat_map_documents(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))


@query("SELECT event_id AS seq, value > 50 AND event_type = 'click' AS both_hold, value > 50 OR event_type = 'click' AS either, NOT (value > 50) AS neither FROM events")
def pattern_algebra(spark, d):
    a, b = F.col("value") > 50, F.col("event_type") == "click"
    return events(spark, d).select("seq", cep.all_of(a, b).alias("both_hold"), cep.any_of(a, b).alias("either"), (~a).alias("neither"))


# Keyed folds

@query("SELECT seq, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DECIMAL(38,2)) AS total FROM $EV WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def keyed_running_sum(spark, d):
    return aggregates.running(events(spark, d), ["user_id"], F.col("value").cast("decimal(18,2)"), "total").select("seq", "user_id", F.col("total").cast("decimal(38,2)"))


@query("SELECT seq, user_id, max(value) OVER w AS most, min(value) OVER w AS least, count(*) OVER w AS n FROM $EV WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def keyed_running_max(spark, d):
    out = events(spark, d)
    for name, how in (("most", "max"), ("least", "min"), ("n", "count")):
        out = aggregates.running(out, ["user_id"], F.col("value"), name, how)
    return out.select("seq", "user_id", "most", "least", "n")


@query("SELECT seq, user_id, max(value) OVER w AS fold FROM $EV WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def keyed_custom_reduce(spark, d):
    ev = events(spark, d).select("user_id", "seq", "value")
    return aggregates.running_fold(ev, "user_id", "seq", "value", float("-inf"), aggregates.greatest, "fold")


# Windows

@query(f"SELECT event_type, ms - ms % {HOUR} AS w_start, count(*) AS n FROM $EV GROUP BY ALL")
def tumbling_count(spark, d):
    return windows.tumbling(events(spark, d), HOUR).groupBy("event_type", "w_start").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, ms - ms % {HOUR} AS w_start, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, CAST(round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 10) AS DECIMAL(38,10)) AS mean, min(value) AS least, max(value) AS most FROM $EV GROUP BY ALL")
def tumbling_sum_decimal(spark, d):
    v = F.col("value")
    return windows.tumbling(events(spark, d), HOUR).groupBy("event_type", "w_start").agg(aggregates.exact_sum(v).alias("total"), aggregates.exact_avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


@query(f"SELECT event_type, s AS w_start, count(*) AS n FROM (SELECT event_type, ms, unnest([ms - ms % {HOUR // 4} - k * {HOUR // 4} FOR k IN range(0, 4)]) AS s FROM $EV) WHERE s + {HOUR} > ms GROUP BY ALL")
def sliding_count(spark, d):
    return windows.sliding(events(spark, d), HOUR, HOUR // 4).groupBy("event_type", "w_start").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, s AS w_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM (SELECT event_type, value, unnest([ms - ms % {HOUR // 4} - k * {HOUR // 4} FOR k IN range(0, 4)]) AS s FROM $EV) GROUP BY ALL")
def sliding_sliced(spark, d):
    out = windows.sliding_aggregate(
        events(spark, d), ["event_type"], HOUR, HOUR // 4,
        {"n": F.count("*"), "total": aggregates.exact_sum(F.col("value"))},
        {"n": lambda c: F.sum(c), "total": lambda c: F.sum(c).cast("decimal(38,2)")},
    )
    return out.select("event_type", "w_start", "n", "total")


@query(f"SELECT seq, s AS w_start FROM (SELECT seq, ms, ms - ms % {2 * HOUR} AS s FROM $EV) WHERE s + {HOUR} > ms")
def sliding_gaps(spark, d):
    return windows.sliding(events(spark, d), HOUR, 2 * HOUR).select("seq", "w_start")


def _islands(op: str) -> str:
    return f"""SELECT user_id, min(ms) AS w_start, max(ms) + 1800000 AS w_end, count(*) AS n FROM (
      SELECT user_id, ms, sum(b) OVER (PARTITION BY user_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT user_id, ms, seq, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, seq) {op} 1800000 THEN 1 ELSE 0 END AS b FROM $EV)) GROUP BY user_id, k"""


@query(_islands(">"))
def session_merged(spark, d):
    return windows.session_aggregate(events(spark, d), ["user_id"], HOUR // 2, {"n": F.count("*")})


@query(_islands(">="))
def session_strict(spark, d):
    return windows.session_aggregate(events(spark, d), ["user_id"], HOUR // 2, {"n": F.count("*")}, touching=False)


@query(f"SELECT user_id, ms AS w_start, ms + {HOUR // 2} AS w_end, count(*) AS n FROM $EV GROUP BY ALL")
def session_unmerged(spark, d):
    return windows.sessions(events(spark, d), ["user_id"], HOUR // 2, merge=False).groupBy("user_id", "w_start", "w_end").agg(F.count("*").alias("n"))


@query("SELECT user_id, k AS w_index, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 5 AS k FROM $EV) GROUP BY ALL")
def count_window(spark, d):
    return windows.count_windows(events(spark, d), ["user_id"], 5).groupBy("user_id", "w_index").agg(F.count("*").alias("n"), aggregates.exact_sum(F.col("value")).alias("total"))


@query("SELECT seq, user_id FROM (SELECT seq, user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM $EV) WHERE k % 3 = 0")
def count_trigger(spark, d):
    return windows.count_trigger(events(spark, d), ["user_id"], 3).select("seq", "user_id")


@query(f"SELECT seq, unnest([ms - ms % {DAY}, ms - ms % {HOUR}]) AS w_start, unnest([ms - ms % {DAY} + {DAY}, ms - ms % {HOUR} + {HOUR}]) AS w_end FROM $EV")
def custom_windows(spark, d):
    both = F.array(*[F.struct((F.col("ms") - F.col("ms") % n).alias("start"), (F.col("ms") - F.col("ms") % n + n).alias("end")) for n in (DAY, HOUR)])
    return windows.custom(events(spark, d), both).select("seq", "w_start", "w_end")


@query(f"SELECT user_id, ms - ms % {DAY} AS w_start, arg_min(value, seq) AS first, arg_max(value, seq) AS last, array_to_string(list(seq ORDER BY seq), ',') AS members FROM $EV GROUP BY ALL")
def window_apply_first_last_collect(spark, d):
    out = windows.tumbling(events(spark, d), DAY).withColumn("id", F.col("seq").cast("string"))
    panes = out.groupBy("user_id", "w_start").agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"), F.sort_array(F.collect_list("seq")).alias("m"))
    return panes.select("user_id", "w_start", "first", "last", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


_SHUFFLED = "SELECT event_type, ms, event_id + 37 * (event_id % 11) AS arrival, event_id FROM (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events)"
_LATE = f"SELECT event_type, ms - ms % {HOUR} AS w_start, max(ms) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - {HOUR} AS wm FROM ({_SHUFFLED})"


def _arrivals(spark, d):
    ev = events(spark, d).withColumn("arrival", F.struct((F.col("seq") + 37 * (F.col("seq") % 11)).alias("a"), "seq"))
    return windows.watermark_before(windows.tumbling(ev, HOUR), HOUR, slot=F.floor(F.col("arrival.a") / 4096))


@query(f"SELECT event_type, w_start, count(*) AS n FROM ({_LATE}) WHERE wm < w_start + {HOUR} GROUP BY ALL")
def late_drop_simulation(spark, d):
    return windows.drop_late(_arrivals(spark, d)).groupBy("event_type", "w_start").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, w_start, count(*) AS n FROM ({_LATE}) WHERE wm >= w_start + {HOUR} GROUP BY ALL")
def late_side_output(spark, d):
    return windows.late(_arrivals(spark, d)).groupBy("event_type", "w_start").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, w_start, count(*) AS n FROM ({_LATE}) WHERE wm < w_start + {2 * HOUR} GROUP BY ALL")
def late_with_allowed_lateness(spark, d):
    return windows.drop_late(_arrivals(spark, d), HOUR).groupBy("event_type", "w_start").agg(F.count("*").alias("n"))


@query("SELECT seq, max(ms) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 60001 AS wm FROM $EV")
def watermark_series(spark, d):
    return windows.watermark_before(events(spark, d), 60_000, arrival="seq", keys=["user_id"], exclusive=True).select("seq", "wm")


# Aggregates

@query(f"SELECT event_type, w AS w_start, count(DISTINCT value) AS count, CAST(sum(DISTINCT CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum FROM (SELECT event_type, CAST(value AS DECIMAL(18,2)) AS value, ms - ms % {HOUR} AS w FROM $EV) GROUP BY ALL")
def window_aggregator_distinct(spark, d):
    ev = windows.tumbling(events(spark, d).withColumn("value", F.col("value").cast("decimal(18,2)")), HOUR)
    return aggregates.aggregate(ev, ["event_type", "w_start"], value="value", names=["COUNT", "SUM"], distinct=True)


@query("SELECT event_type, count(value) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum, CAST(round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 10) AS DECIMAL(38,10)) AS average, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def named_aggregates(spark, d):
    return aggregates.aggregate(events(spark, d), ["event_type"], value="value", names=["COUNT", "SUM", "AVERAGE", "MIN", "MAX"])


@query(f"SELECT event_type, ms - ms % {HOUR} AS w_start, ms - ms % {HOUR} + {HOUR} AS w_end, count(*) AS n, {HOUR} AS size_ms FROM $EV GROUP BY ALL")
def window_statistics(spark, d):
    return windows.tumbling(events(spark, d), HOUR).groupBy("event_type", "w_start", "w_end").agg(F.count("*").alias("n")).withColumn("size_ms", F.lit(HOUR))


@query("SELECT user_id, CAST(list_reduce(list(CAST(seq AS BIGINT) ORDER BY seq), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS digest FROM $EV GROUP BY user_id")
def collection_aggregate(spark, d):
    def digest(values):
        return F.aggregate(F.slice(values, 2, 2**30), F.element_at(values, 1), lambda a, x: (a * 31 + x) % 1000003)

    return aggregates.collection_aggregate(events(spark, d).withColumn("v", F.col("seq")), ["user_id"], "seq", "v", digest, "digest")


@query(f"SELECT seq, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS views FROM $EV")
def pv_rolling(spark, d):
    return analytics.rolling_views(events(spark, d), "event_type", HOUR).select("seq", "event_type", "views")


_T0 = 1_704_067_200_000  # 2024-01-01


@query(f"SELECT event_type, count(*) AS views FROM $EV WHERE ms >= {_T0 + DAY} AND ms < {_T0 + 8 * DAY} GROUP BY ALL")
def pv_range(spark, d):
    return analytics.views_between(events(spark, d), "event_type", _T0 + DAY, _T0 + 8 * DAY)


@query(f"SELECT event_type, count(*) AS views FROM $EV WHERE ms > {_T0 + 3 * DAY} AND ms <= {_T0 + 10 * DAY} GROUP BY ALL")
def pv_at(spark, d):
    return analytics.views_at(events(spark, d), "event_type", _T0 + 10 * DAY, 7 * DAY)


@query("SELECT count(DISTINCT event_type) AS pages, count(*) AS total_views FROM events")
def pv_stats(spark, d):
    return analytics.view_statistics(events(spark, d), "event_type")


@query(f"SELECT event_type, count(DISTINCT user_id) AS visitors FROM $EV WHERE ms >= {_T0 + DAY} AND ms < {_T0 + 8 * DAY + 60_000} GROUP BY ALL")
def uv_exact_bucketed(spark, d):
    return analytics.unique_visitors(events(spark, d), "event_type", "user_id", 60_000, _T0 + DAY + 30_000, _T0 + 8 * DAY)


@query(f"SELECT event_type, count(DISTINCT user_id) AS visitors, true AS close FROM $EV WHERE ms >= {_T0 // HOUR * HOUR} AND ms < {(_T0 + 30 * DAY) // HOUR * HOUR + HOUR} GROUP BY ALL")
def uv_hll(spark, d):
    """The sketch's estimate against the exact number: three standard errors of 1.6 % are allowed."""
    span = (events(spark, d), "event_type", "user_id", HOUR, _T0, _T0 + 30 * DAY)
    estimate = analytics.unique_visitors(*span, exact=False).withColumnRenamed("visitors", "estimate")
    both = analytics.unique_visitors(*span).join(estimate, "event_type")
    return both.select("event_type", "visitors", (F.abs(F.col("estimate") - F.col("visitors")) <= 0.05 * F.col("visitors")).alias("close"))


_SCORES = "SELECT event_type, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS score FROM events GROUP BY ALL"


@query(f"SELECT * FROM (SELECT event_type, user_id, score, CAST(row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id DESC) AS INTEGER) AS rank FROM ({_SCORES})) WHERE rank <= 3")
def topk_users_by_value(spark, d):
    return analytics.top_k(events(spark, d), "event_type", "user_id", "value", 3)


@query(f"""SELECT w.event_type, w.user_id, coalesce(score, 0) AS score, coalesce(rank, -1) AS rank FROM (SELECT event_type, u AS user_id FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([1, 2, 3, 1000000]) AS u)) w
  LEFT JOIN (SELECT event_type, user_id, score, CAST(row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id DESC) AS INTEGER) AS rank FROM ({_SCORES})) USING (event_type, user_id)""")
def topk_rank_lookup(spark, d):
    ev = events(spark, d)
    wanted = ev.select("event_type").distinct().withColumn("user_id", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 1_000_000)])))
    return analytics.ranks(ev, wanted.withColumn("user_id", F.col("user_id").cast("bigint")), "event_type", "user_id", "value").select("event_type", "user_id", "score", "rank")


SQL["topk_rank_lookup"] = SQL["topk_rank_lookup"].replace("u AS user_id FROM", "CAST(u AS BIGINT) AS user_id FROM").replace("coalesce(score, 0) AS score", "CAST(coalesce(score, 0) AS DECIMAL(38,2)) AS score")


@query("SELECT event_type, v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1] AS p50, v[CAST(floor(0.95 * (len(v) - 1)) AS BIGINT) + 1] AS p95, v[CAST(floor(0.99 * (len(v) - 1)) AS BIGINT) + 1] AS p99 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def quantile_p50_p95_p99(spark, d):
    return analytics.quantiles(events(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT event_type, count(value) AS n, true AS p50_close, true AS p99_close FROM events GROUP BY event_type")
def quantile_sketch(spark, d):
    """The ranks of the sketch's quantiles among all values: 3 % off at most, twice the sketch's stated error."""
    ev, qs = events(spark, d), {"p50": 0.5, "p99": 0.99}
    met = ev.join(analytics.approximate_quantiles(ev, ["event_type"], "value", qs), "event_type")
    close = [((F.count_if(F.col("value") <= F.col(q)) >= (p - 0.03) * F.count("value")) & (F.count_if(F.col("value") < F.col(q)) <= (p + 0.03) * F.count("value"))).alias(f"{q}_close") for q, p in qs.items()]
    return met.groupBy("event_type").agg(F.count("value").alias("n"), *close)


@query("SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'meter' ELSE 'gauge' END AS kind, CAST(CASE event_type WHEN 'click' THEN sum(value) WHEN 'view' THEN count(value) ELSE arg_max(value, seq) END AS DOUBLE) AS value, count(value) AS n, min(value) AS least, max(value) AS most FROM (SELECT seq, event_type, floor(value) AS value FROM $EV) GROUP BY event_type")
def metrics_rollup(spark, d):
    ev = events(spark, d).select("seq", F.col("event_type").alias("name"), F.expr("case event_type when 'click' then 'counter' when 'view' then 'meter' else 'gauge' end").alias("kind"), F.floor("value").cast("double").alias("value"))
    return analytics.metric_rollup(ev).drop("mean")


# Joins

def _click_purchase(spark, d):
    ev = events(spark, d).select("seq", "ms", F.col("user_id").alias("key"), "event_type")
    return tuple(ev.where(F.col("event_type") == t).drop("event_type") for t in ("click", "purchase"))


_L = "(SELECT event_id AS l_seq, epoch_us(ts) // 1000 AS l_ms, user_id AS l_key FROM events WHERE event_type = 'click')"
_R = "(SELECT event_id AS r_seq, epoch_us(ts) // 1000 AS r_ms, user_id AS r_key FROM events WHERE event_type = 'purchase')"
_P = f"SELECT l_seq, r_seq FROM {_L} JOIN {_R} ON l_key = r_key AND r_ms - l_ms BETWEEN -{HOUR} AND {HOUR}"


def _joined(spark, d, how, emit="final", window=None, **more):
    left, right = _click_purchase(spark, d)
    return joins.window_join(left, right, window or joins.JoinWindow.of_size(HOUR), how, emit=emit, **more).select("l_seq", "r_seq")


@query(_P)
def join_inner_symmetric(spark, d):
    return _joined(spark, d, "inner")


@query(f"SELECT l_seq, r_seq FROM {_L} JOIN {_R} ON l_key = r_key AND CASE WHEN r_seq > l_seq THEN r_ms - l_ms ELSE l_ms - r_ms END BETWEEN -{HOUR} AND {6 * HOUR}")
def join_inner_asymmetric(spark, d):
    return _joined(spark, d, "inner", window=joins.JoinWindow(HOUR, 6 * HOUR), by_arrival=True)


_LEFT = "UNION ALL SELECT l_seq, NULL FROM {L} l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_seq = l.l_seq {more})"
_RIGHT = "UNION ALL SELECT NULL, r_seq FROM {R} r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r_seq = r.r_seq {more})"
_EAGER_L, _EAGER_R = "AND p.r_seq < l.l_seq", "AND p.l_seq < r.r_seq"


@query(f"WITH p AS ({_P}) SELECT * FROM p " + _LEFT.format(L=_L, more=""))
def join_left_final(spark, d):
    return _joined(spark, d, "left")


@query(f"WITH p AS ({_P}) SELECT * FROM p " + _LEFT.format(L=_L, more=_EAGER_L))
def join_left_eager(spark, d):
    return _joined(spark, d, "left", "eager")


@query(f"WITH p AS ({_P}) SELECT * FROM p " + _RIGHT.format(R=_R, more=_EAGER_R))
def join_right_eager(spark, d):
    return _joined(spark, d, "right", "eager")


@query(f"WITH p AS ({_P}) SELECT * FROM p " + _LEFT.format(L=_L, more=_EAGER_L) + " " + _RIGHT.format(R=_R, more=_EAGER_R))
def join_full_eager(spark, d):
    return _joined(spark, d, "full", "eager")


@query(f"WITH p AS ({_P}) SELECT * FROM p " + _LEFT.format(L=_L, more="") + " " + _RIGHT.format(R=_R, more=""))
def join_full_final(spark, d):
    return _joined(spark, d, "full")


@query(f"""WITH b AS (SELECT seq, user_id AS key, ms, max(ms) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM $EV WHERE event_type IN ('click', 'purchase'))
  SELECT l_seq, r_seq FROM {_L} JOIN {_R} ON l_key = r_key AND r_ms - l_ms BETWEEN -{DAY} AND {DAY} JOIN b x ON x.seq = greatest(l_seq, r_seq) WHERE coalesce(x.top, x.ms) - CASE WHEN l_seq < r_seq THEN l_ms ELSE r_ms END <= {2 * HOUR}""")
def join_with_retention(spark, d):
    return _joined(spark, d, "inner", window=joins.JoinWindow.of_size(DAY), retention_ms=2 * HOUR)


# Tables

@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def table_latest(spark, d):
    return UpsertTable.from_stream(events(spark, d).select("user_id", "seq", "value"), "user_id", "seq").rows.select("user_id", "value", "seq")


_TABLE = "SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"


def _user_table(spark, d):
    return UpsertTable.from_stream(events(spark, d).select("user_id", "seq", "value", "event_type"), "user_id", "seq", F.col("event_type") == "error")


@query(_TABLE)
def table_tombstones(spark, d):
    return _user_table(spark, d).rows.select("user_id", "value", "event_type")


@query(f"SELECT user_id, value * 2 AS doubled FROM ({_TABLE}) WHERE value > 20")
def table_map_filter(spark, d):
    return _user_table(spark, d).map_values(doubled=F.when(F.col("value") > 10, F.col("value") * 2)).filter(F.col("doubled") > 40).rows


_ORDERS = "SELECT o_custkey AS key, arg_max(o_orderkey, o_orderkey) AS orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey"


def _order_tables(spark, d):
    latest = UpsertTable.from_stream(load(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status")), "key", "orderkey")
    return latest, UpsertTable(load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), "key")


@query(f"SELECT key, orderkey, status, c_name AS name FROM ({_ORDERS}) JOIN customer ON c_custkey = key")
def table_inner_join(spark, d):
    latest, customers = _order_tables(spark, d)
    return latest.join(customers)


@query(f"SELECT c_custkey AS key, c_name AS name, orderkey, status FROM customer LEFT JOIN ({_ORDERS}) ON c_custkey = key")
def table_left_join(spark, d):
    latest, customers = _order_tables(spark, d)
    return customers.left_join(latest)


@query(f"SELECT event_type, count(*) AS n FROM ({_TABLE}) GROUP BY ALL")
def grouped_count(spark, d):
    return _user_table(spark, d).group_by("event_type").count()


@query(f"SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM ({_TABLE}) GROUP BY ALL")
def grouped_reduce_sum(spark, d):
    return _user_table(spark, d).group_by("event_type").reduce(F.col("value"), aggregates.exact_sum, "total")


@query(f"SELECT event_type, min(value) AS least, max(value) AS most, count(*) AS n FROM ({_TABLE}) GROUP BY ALL")
def grouped_aggregate(spark, d):
    return _user_table(spark, d).group_by("event_type").aggregate(least=F.min("value"), most=F.max("value"), n=F.count("*"))


# Patterns

def _is(kind):
    return F.col("event_type") == kind


@query("SELECT user_id, seq AS a_seq, b_seq FROM (SELECT user_id, seq, event_type, lead(seq) OVER w AS b_seq, lead(event_type) OVER w AS b FROM $EV WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE event_type = 'view' AND b = 'click'")
def cep_next(spark, d):
    return cep.matched_next(events(spark, d), "user_id", _is("view"), _is("click")).select("user_id", "a_seq", "b_seq")


_FB = f"SELECT user_id, seq AS a_seq, b_seq FROM (SELECT user_id, seq, ms, event_type, min(CASE WHEN event_type = 'click' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_seq FROM $EV) a JOIN (SELECT seq AS s, ms AS b_ms FROM $EV) b ON s = b_seq WHERE event_type = 'view' AND b_ms - ms <= {DAY}"


@query(_FB)
def cep_followed_by(spark, d):
    return cep.matched_followed_by(events(spark, d), "user_id", _is("view"), _is("click"), DAY).select("user_id", "a_seq", "b_seq")


@query(f"SELECT a.user_id, a.seq AS a_seq, b.seq AS b_seq FROM $EV a JOIN $EV b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.seq > a.seq AND b.ms - a.ms <= {DAY}")
def cep_followed_by_any(spark, d):
    return cep.matched_followed_by_any(events(spark, d), "user_id", _is("view"), _is("click"), DAY).select("user_id", "a_seq", "b_seq")


_ONES = "SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, min(seq) OVER (PARTITION BY user_id) AS f FROM $EV WHERE event_type = 'view'"


@query(f"SELECT user_id, f AS first_seq, seq AS last_seq, i AS n FROM ({_ONES})")
def cep_one_or_more(spark, d):
    return cep.matched_repeats(events(spark, d), "user_id", _is("view"), 1)


def _groups(n: int, least: int) -> str:
    return f"SELECT user_id, first_value(seq) OVER (PARTITION BY user_id, g ORDER BY seq) AS first_seq, seq AS last_seq, i - g * {n} AS n FROM (SELECT *, (i - 1) // {n} AS g FROM ({_ONES})) QUALIFY i - g * {n} >= {least}"


@query(_groups(3, 3))
def cep_exactly_n(spark, d):
    return cep.matched_repeats(events(spark, d), "user_id", _is("view"), 3, 3)


@query(_groups(4, 2))
def cep_range(spark, d):
    return cep.matched_repeats(events(spark, d), "user_id", _is("view"), 2, 4)


@query("SELECT user_id, seq AS a_seq, b_seq FROM (SELECT user_id, seq, event_type, lead(seq) OVER w AS b_seq, lead(event_type) OVER w AS b FROM $EV WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE event_type = 'view' AND b = 'click'")
def cep_machine_next(spark, d):
    found = cep.detect(events(spark, d), "user_id", cep.Pattern.begin("a", _is("view")).next("b", _is("click")))
    return found.select("user_id", F.col("seqs")[0].alias("a_seq"), F.col("seqs")[1].alias("b_seq"))


@query(_FB)
def cep_machine_followed_by(spark, d):
    found = cep.detect(events(spark, d), "user_id", cep.Pattern.begin("a", _is("view")).followed_by("b", _is("click")).within(DAY))
    return found.select("user_id", F.col("seqs")[0].alias("a_seq"), F.col("seqs")[1].alias("b_seq"))


@query()
def cep_nfa_mixed(spark, d):
    c = F.col("event_type") == "purchase"
    found = cep.detect(events(spark, d), "user_id", cep.Pattern.begin("a", _is("view")).followed_by("b", _is("click")).optional().followed_by("c", c).within(DAY))
    return found.withColumn("seqs", F.array_join(F.col("seqs").cast("array<string>"), ",")).withColumn("steps", F.array_join(F.col("steps").cast("array<string>"), ","))


@query("SELECT event_id AS seq FROM events WHERE event_type = 'error' AND value > 90")
def cep_single_events(spark, d):
    return cep.single_events(events(spark, d), (F.col("event_type") == "error") & (F.col("value") > 90)).select("seq")


# Reliability

@query("SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY ALL")
def dedup_first(spark, d):
    return reliability.first_of_each(events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", "seq")


@query("SELECT seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) > 1 AS duplicate FROM $EV")
def dedup_marked(spark, d):
    return reliability.duplicates_marked(events(spark, d), ["user_id", "event_type"]).select("seq", "duplicate")


_GAP = 240_000


@query(f"SELECT min(seq) AS seq, user_id FROM (SELECT seq, user_id, sum(b) OVER (ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT seq, ms, user_id, CASE WHEN ms - lag(ms) OVER (ORDER BY ms, seq) >= {_GAP} THEN 1 ELSE 0 END AS b FROM $EV)) GROUP BY user_id, p")
def dedup_idle_gap(spark, d):
    return reliability.first_after_idle(events(spark, d), "user_id", _GAP).select("seq", "user_id")


@query(f"SELECT seq FROM (SELECT seq, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY seq) AS p FROM $EV) WHERE p IS NULL OR ms - p >= {HOUR}")
def dedup_sliding_key(spark, d):
    return reliability.first_within_horizon(events(spark, d), "user_id", HOUR).select("seq")


def _limited(state: str, before: str, held: str, verdict: str, after: str) -> str:
    """A recurrence over each user's hits in order: ``held`` is the state at a hit, ``after`` the state it leaves."""
    return f"""WITH RECURSIVE hits AS (SELECT user_id, seq, ms, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM $EV),
  step AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS BIGINT) AS stamp, {before}::{state} AS held, false AS allowed FROM (SELECT DISTINCT user_id FROM hits)
    UNION ALL SELECT user_id, k, seq, ms, greatest(stamp, ms), {after}, {verdict} FROM (SELECT h.user_id, h.k, h.seq, h.ms, p.stamp, {held} AS held FROM step p JOIN hits h ON h.user_id = p.user_id AND h.k = p.k + 1))
  SELECT user_id, seq, ms, allowed FROM step WHERE k > 0"""


_PASSED = "(greatest(h.ms, coalesce(p.stamp, h.ms)) - coalesce(p.stamp, h.ms)) * (CAST(1 AS DOUBLE) / 7200 / 1000)"


@query(_limited("BIGINT[]", "[]", f"[x FOR x IN p.held IF x > h.ms - {6 * HOUR}]", "len(held) < 3", "CASE WHEN len(held) < 3 THEN list_append(held, ms) ELSE held END"))
def rate_sliding(spark, d):
    return reliability.rate_limited(events(spark, d), "user_id", lambda: reliability.SlidingLimit(3, 6 * HOUR))


@query(_limited("DOUBLE", "3", f"least(3, p.held + {_PASSED})", "held >= 1", "CASE WHEN held >= 1 THEN held - 1 ELSE held END"))
def rate_token(spark, d):
    return reliability.rate_limited(events(spark, d), "user_id", lambda: reliability.TokenBucket(3, 1 / 7200))


@query(_limited("DOUBLE", "0", f"greatest(0, p.held - {_PASSED})", "held + 1 <= 3", "CASE WHEN held + 1 <= 3 THEN held + 1 ELSE held END") + " AND allowed")
def rate_leaky(spark, d):
    return reliability.limit_sink(reliability.rate_limited(events(spark, d), "user_id", lambda: reliability.LeakyBucket(3, 1 / 7200)))


@query("SELECT a AS attempt, CAST(least(10000, floor(100 * pow(2.0, a - 1))) AS BIGINT) AS delay_ms FROM range(1, 13) r(a)")
def retry_backoff_schedule(spark, d):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), scalar.backoff_ms("id", 100).alias("delay_ms"))


@query("SELECT seq, CASE WHEN event_type = 'error' AND seq % 5 < 3 THEN 'retry' WHEN event_type = 'error' THEN 'dlq' ELSE 'ack' END AS \"to\", CASE WHEN event_type = 'error' AND seq % 5 < 3 THEN ms + CAST(least(60000, 1000 * pow(2, seq % 5)) AS BIGINT) END AS due_ms FROM $EV")
def mq_result_routing(spark, d):
    ev = events(spark, d).withColumn("result", F.when(F.col("event_type") == "error", "RETRY").otherwise("SUCCESS")).withColumn("attempt", F.col("seq") % 5)
    return reliability.routed_results(ev, "result", "attempt", 3, F.col("ms")).select("seq", "to", "due_ms")


@query("SELECT seq, try_cast(props->>'k' AS BIGINT) AS k FROM $EV WHERE try_cast(props->>'k' AS BIGINT) % 7 <> 0")
def dlq_good(spark, d):
    return _split(spark, d).good.select("seq", "k")


@query("SELECT seq, 'k is a multiple of 7' AS error FROM $EV WHERE coalesce(try_cast(props->>'k' AS BIGINT) % 7 = 0, true)")
def dlq_split(spark, d):
    return _split(spark, d).dead.select("seq", "error")


def _split(spark, d):
    ev = events(spark, d).withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return reliability.split_failures(ev, F.col("k") % 7 != 0, F.lit("k is a multiple of 7"))


# Registry, configuration, log

@query("SELECT event_id AS seq FROM events WHERE coalesce(try_cast(props->>'k' AS DOUBLE) >= 80, (props->>'k') >= '80', false)")
def metadata_filter(spark, d):
    return events(spark, d).where(scalar.matches("props", {"k:>=": "80"}, as_json=True)).select("seq")


def _significant(rule: str) -> str:
    return f"SELECT seq, CASE WHEN o IS NULL THEN true ELSE {rule} END AS significant FROM (SELECT seq, value AS n, lag(value) OVER (PARTITION BY user_id ORDER BY seq) AS o FROM $EV)"


@query(_significant("CASE WHEN o = 0 THEN n <> 0 ELSE abs(n - o) / abs(o) * 100 > 50 END"))
def change_detection_percent(spark, d):
    return registry.changes_marked(events(spark, d), "user_id", "value", "PERCENTAGE", 50).select("seq", "significant")


@query(_significant("abs(n - o) > 10"))
def change_detection_absolute(spark, d):
    return registry.changes_marked(events(spark, d), "user_id", "value", "ABSOLUTE", 10).select("seq", "significant")


@query(_significant("n <> o"))
def change_detection_any(spark, d):
    return registry.changes_marked(events(spark, d), "user_id", "value", "ANY").select("seq", "significant")


def _instances(spark, d):
    s = load(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("svc"), (F.col("s_suppkey") % 7).cast("string")).alias("service"), F.col("s_name").alias("instance"), (F.col("s_suppkey") % 5).cast("int").alias("weight"),
        (F.col("s_suppkey") * 37 % 100).cast("double").alias("cpu"), (F.col("s_suppkey") * 13 % 50).cast("double").alias("latency"), (F.col("s_suppkey") * 1000).alias("heartbeat_ms"),
        (F.col("s_suppkey") % 3 > 0).alias("enabled"), (F.col("s_suppkey") % 4 > 0).alias("healthy"), F.create_map(F.lit("weight"), (F.col("s_suppkey") % 5).cast("string"), F.lit("region"), F.concat(F.lit("r"), (F.col("s_suppkey") % 2).cast("string"))).alias("metadata"),
    )


_I = "(SELECT s_suppkey AS k, 'svc' || (s_suppkey % 7) AS service, s_name AS instance, CAST(s_suppkey % 5 AS INTEGER) AS weight, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS cpu, CAST(s_suppkey * 13 % 50 AS DOUBLE) AS latency, s_suppkey * 1000 AS heartbeat_ms, s_suppkey % 3 > 0 AS enabled, s_suppkey % 4 > 0 AS healthy, s_suppkey % 2 AS region FROM supplier)"


@query(f"SELECT instance FROM {_I} WHERE heartbeat_ms >= 10000 AND weight >= 2 AND region = 1")
def registry_active(spark, d):
    return registry.active(_instances(spark, d), 40_000, 30_000, {"weight:>=": "2", "region": "r1"}).select("instance")


@query(f"SELECT service, count(*) AS instances, count(*) FILTER (enabled AND healthy) AS healthy, max(heartbeat_ms) AS last_heartbeat_ms FROM {_I} GROUP BY service")
def registry_details(spark, d):
    return registry.service_details(_instances(spark, d))


@query(f"""SELECT service, arg_min(instance, (coalesce(-s, CAST('inf' AS DOUBLE)), instance)) AS instance FROM (SELECT service, instance, CASE WHEN cpu <= 60 AND inflight <= 20 THEN
  (1 + log10(greatest(weight, 1) + 1)) * (CASE WHEN region = 1 THEN 1.1 ELSE 1.0 END::DOUBLE) * (1 - least(cpu, 100.0::DOUBLE) / 100) * (50.0::DOUBLE / (50.0::DOUBLE + latency)) * sqrt(1 / (1 + inflight)) END AS s
  FROM (SELECT *, CAST(k % 23 AS DOUBLE) AS inflight FROM {_I})) GROUP BY service""")
def scored_selection(spark, d):
    own = _instances(spark, d).withColumn("inflight", F.floor(F.col("heartbeat_ms") / 1000) % 23)
    metrics = {"cpu": F.col("cpu"), "latency": F.col("latency"), "inflight": F.col("inflight")}
    score = registry.load_score(F.col("weight"), metrics, {"inflight": 0.5}, {"cpu": 60, "inflight": 20}, [(F.col("metadata")["region"], "r1", registry.REGION_BOOST)])
    return registry.best(own, "service", score, "instance").select("service", "instance")


@query(f"""SELECT seq, instance FROM (SELECT event_id AS seq, 'svc' || (user_id % 7) AS service, (value % 1.0) AS draw FROM events) JOIN
  (SELECT service, instance, sum(w) OVER (PARTITION BY service ORDER BY instance) AS hi, w AS weight, sum(w) OVER (PARTITION BY service) AS al FROM (SELECT *, greatest(weight, 1) AS w FROM {_I})) USING (service) WHERE draw * al >= hi - weight AND draw * al < hi""")
def weighted_random_choice(spark, d):
    requests = events(spark, d).select("seq", F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"), (F.col("value") % 1.0).alias("draw"))
    return registry.weighted_choice(_instances(spark, d), requests, "service", "weight", "instance", "draw").select("seq", "instance")


@query(f"""WITH RECURSIVE own AS (SELECT service, list(instance ORDER BY instance) AS ids, list(CAST(greatest(weight, 1) AS BIGINT) ORDER BY instance) AS ws, CAST(sum(greatest(weight, 1)) AS BIGINT) AS n FROM {_I} GROUP BY service),
  step AS (SELECT service, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT) FOR x IN ws] AS held, CAST(0 AS BIGINT) AS pick, ids, ws, n FROM own
    UNION ALL SELECT service, k + 1, [CASE WHEN i = p THEN g[i] - n ELSE g[i] END FOR i IN range(1, len(g) + 1)], p, ids, ws, n FROM
      (SELECT *, CAST(list_position(g, list_max(g)) AS BIGINT) AS p FROM (SELECT *, [held[i] + ws[i] FOR i IN range(1, len(ws) + 1)] AS g FROM step WHERE k < n)))
  SELECT seq, service, ids[pick] AS instance FROM (SELECT event_id AS seq, 'svc' || (user_id % 7) AS service, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS r FROM events) JOIN step USING (service) WHERE step.k = r % n + 1""")
def weighted_round_robin(spark, d):
    requests = events(spark, d).select("seq", F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"))
    return registry.round_robin(_instances(spark, d), requests, "service", "weight", "instance", "seq", slot=F.floor(F.col("seq") / 4096)).select("seq", "service", "instance")


@query("""WITH ring AS (SELECT CAST(CAST('0x' || substr(md5(s_name || '#' || v), 1, 16) AS UBIGINT) & CAST(9223372036854775807 AS UBIGINT) AS BIGINT) AS position, s_name AS node FROM supplier, range(128) r(v)),
  keys AS (SELECT DISTINCT user_id, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 16) AS UBIGINT) & CAST(9223372036854775807 AS UBIGINT) AS BIGINT) AS p FROM events)
  SELECT user_id, coalesce(node, (SELECT arg_min(node, (position, node)) FROM ring)) AS node FROM (SELECT user_id, min((position, node)) AS m FROM keys LEFT JOIN ring ON position >= p GROUP BY user_id) LEFT JOIN LATERAL (SELECT m[2] AS node) ON true""")
def consistent_hash_ring(spark, d):
    ring = registry.hash_ring(load(spark, d, "supplier"), "s_name")
    keys = events(spark, d).select("user_id").distinct().withColumn("k", F.col("user_id").cast("string"))
    return registry.on_ring(keys, "k", ring).select("user_id", "node")


@query("SELECT user_id, CAST(((h % 8) + 8) % 8 AS INTEGER) AS partition FROM (SELECT user_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM (SELECT user_id, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(user_id AS VARCHAR), '')]), lambda a, c: (a * 31 + c) % 4294967296) AS u FROM (SELECT DISTINCT user_id FROM events)))")
def partition_route_hash(spark, d):
    return events(spark, d).select("user_id").distinct().select("user_id", scalar.hash_partition(F.col("user_id").cast("string"), 8).cast("int").alias("partition"))


@query("SELECT seq, event_type FROM (SELECT seq, event_type, row_number() OVER (PARTITION BY event_type ORDER BY seq DESC) AS i FROM $EV) WHERE i <= 100")
def retention_maxlen(spark, d):
    return log.newest(events(spark, d), "event_type", "seq", 100).select("seq", "event_type")


@query(f"SELECT seq FROM $EV WHERE ms >= {_T0 + 20 * DAY}")
def retention_age(spark, d):
    return log.younger_than(events(spark, d), "ms", _T0 + 30 * DAY, 10 * DAY).select("seq")


_COMMITS = "(SELECT event_type AS p, grp, max(event_id) FILTER (user_id % n = 0) AS committed FROM events, (VALUES ('a', 2), ('b', 3)) g(grp, n) GROUP BY ALL HAVING max(event_id) FILTER (user_id % n = 0) IS NOT NULL)"


def _log(spark, d):
    ev = events(spark, d).withColumnRenamed("event_type", "p")
    commits = ev.where("user_id % 2 = 0").groupBy("p").agg(F.max("seq").alias("committed")).withColumn("grp", F.lit("a")).unionByName(ev.where("user_id % 3 = 0").groupBy("p").agg(F.max("seq").alias("committed")).withColumn("grp", F.lit("b")))
    return ev, commits


@query(f"SELECT grp, count(e.event_id) AS lag, CAST(max(t.x) AS BIGINT) AS position_lag FROM {_COMMITS} c LEFT JOIN events e ON e.event_type = c.p AND e.event_id > c.committed JOIN (SELECT grp, sum(l - committed) AS x FROM {_COMMITS} JOIN (SELECT event_type AS p, max(event_id) AS l FROM events GROUP BY ALL) USING (p) GROUP BY grp) t USING (grp) GROUP BY grp")
def group_lag(spark, d):
    ev, commits = _log(spark, d)
    return log.group_lag(ev, commits, "p", "seq")


@query(f"SELECT event_id AS seq FROM events JOIN (SELECT p, min(committed) AS m FROM {_COMMITS} GROUP BY p) ON p = event_type WHERE event_id > m")
def retention_frontier(spark, d):
    ev, commits = _log(spark, d)
    return log.beyond_frontier(ev, commits, "p", "seq").select("seq")


@query("SELECT event_id AS seq FROM events WHERE event_id BETWEEN 100 AND 500 ORDER BY event_id DESC LIMIT 50")
def log_reverse_range(spark, d):
    return log.range_scan(events(spark, d), "seq", 100, 500, 50, newest_first=True).select("seq")


@query("SELECT event_id AS seq FROM events WHERE user_id % 4 = 1")
def subscription_partitions(spark, d):
    return log.partition_share(events(spark, d), "user_id", 4, 5).select("seq")


@query("SELECT user_id, seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS INTEGER) AS version_rank FROM $EV QUALIFY version_rank <= 5")
def config_history_newest_n(spark, d):
    return log.history(events(spark, d), ["user_id"], "seq", 5).select("user_id", "seq", "version_rank")


@query("SELECT user_id, seq, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS valid_to FROM $EV")
def config_validity(spark, d):
    return log.validity(events(spark, d), ["user_id"], "seq").select("user_id", "seq", "valid_to")


# Change data

def _changes(spark, d):
    return events(spark, d).select("seq", "ms", F.col("user_id").alias("key"), "value", F.expr("case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end").alias("event_type"), F.lit("shop").alias("database"), F.col("event_type").alias("table"))


@query("SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def cdc_apply(spark, d):
    return cdc.applied(_changes(spark, d)).rows.select("key", "value")


@query("SELECT event_id AS seq FROM events WHERE event_type LIKE 'c%' OR event_type = 'view'")
def cdc_table_filter(spark, d):
    return cdc.selected(_changes(spark, d), ["shop.c*", "view", "purchase"], ["p*"]).select("seq")


@query("SELECT CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event_type, count(*) AS n FROM events GROUP BY ALL")
def cdc_event_rates(spark, d):
    return cdc.event_rates(_changes(spark, d)).select("event_type", "n")


@query("SELECT event_id AS seq, 'INSERT' AS event_type, CAST(event_id AS VARCHAR) AS position FROM events WHERE event_id > 500")
def cdc_polled(spark, d):
    rows = cdc.polled(load(spark, d, "events").select("event_id", "event_type"), "event_id", 500)
    return cdc.as_inserts(rows, "shop", "events", "event_id").select(F.element_at("after", "event_id").cast("bigint").alias("seq"), "event_type", "position")


@query("SELECT event_id AS seq, 'shop' AS database, 'it''s ' || event_type AS text FROM events WHERE event_id % 10 = 0")
def cdc_decoded_lines(spark, d):
    lines = events(spark, d).where("seq % 10 = 0").select(F.concat(F.lit("table shop.t: INSERT: id[bigint]:"), F.col("seq").cast("string"), F.lit(" text[text]:'it''s "), F.col("event_type"), F.lit("'")).alias("value"))
    return cdc.decoded_lines(lines).select(F.col("key").cast("bigint").alias("seq"), "database", F.element_at("after", "text").alias("text"))


@query("SELECT event_id AS seq, 'shop' AS database, 'it''s ' || event_type AS text FROM events")
def cdc_decoded_every_line(spark, d):
    lines = events(spark, d).select(F.concat(F.lit("table shop.t: INSERT: id[bigint]:"), F.col("seq").cast("string"), F.lit(" text[text]:'it''s "), F.col("event_type"), F.lit("'")).alias("value"))
    return cdc.decoded_lines(lines).select(F.col("key").cast("bigint").alias("seq"), "database", F.element_at("after", "text").alias("text"))


# Sources

@query("SELECT i AS seq, i AS ms, v FROM (SELECT CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS i, unnest(l) AS v FROM (SELECT ['a', 'b', 'c'] AS l))")
def source_elements(spark, d):
    return sources.from_elements(spark, ["a", "b", "c"])


@query("SELECT CAST(range AS BIGINT) AS v FROM range(5, 1005)")
def source_sequence(spark, d):
    return sources.sequence(spark, 1000, 5)


@query("SELECT event_id AS seq, try_cast(props->>'k' AS INTEGER) AS k FROM events")
def source_json_decode(spark, d):
    return sources.decoded(events(spark, d), "k int", "props").select("seq", "data.k")


# The reference tables of the star schema

@query("""SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark, d):
    o, c, n = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(aggregates.exact_sum(F.col("o_totalprice")).alias("revenue"), F.count("*").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def lineitem_summary(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(aggregates.exact_sum(F.col("l_quantity")).alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT o_custkey, epoch_us(o_orderdate) // 1000 AS ms, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 1000 RANGE BETWEEN 2592000000 PRECEDING AND CURRENT ROW) AS n FROM orders")
def orders_rolling_month(spark, d):
    o = load(spark, d, "orders").select("o_custkey", epoch_ms("o_orderdate").alias("ms"))
    return analytics.rolling_views(o, "o_custkey", 30 * DAY + 1).select("o_custkey", "ms", F.col("views").alias("n"))
