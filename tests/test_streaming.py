"""Streams against their batch twins."""

from pyspark.sql import functions as F

from tidewell.operators import aggregates, cep, joins, reliability
from tidewell.session import epoch_ms, events
from tidewell.sources import sinks
from tidewell.streaming import processors, watermarks
from tidewell.streaming.watermarks import WatermarkStrategy


def stream_of(spark, data, tmp_path):
    """The events in three files, in order, as a stream."""
    folder = str(tmp_path / "in")
    ev = spark.read.parquet(f"{data}/events.parquet")
    n = ev.count()
    for k in range(3):
        ev.where((F.col("event_id") > k * n // 3 - (k == 0)) & (F.col("event_id") <= (k + 1) * n // 3)).coalesce(1).write.mode("append").parquet(folder)
    return watermarks.read_events(spark, folder).withColumn("seq", F.col("event_id")).withColumn("ms", epoch_ms("ts"))


def collected(spark, df, tmp_path, name):
    watermarks.run_to_memory(df, name, str(tmp_path / f"cp-{name}"))
    return spark.table(name)


def test_windows_leave_only_open_panes(spark, data, tmp_path):
    stream = WatermarkStrategy.bounded(60_000).assign(stream_of(spark, data, tmp_path))
    got = {tuple(r) for r in collected(spark, watermarks.windowed(stream, ["event_type"], "1 hour", n=F.count("*")), tmp_path, "panes").select("event_type", "w_start", "n").collect()}
    batch = events(spark, data).groupBy("event_type", (F.col("ms") - F.col("ms") % 3_600_000).alias("w")).count()
    wanted = {tuple(r) for r in batch.collect()}
    last = max(w for _, w, _ in wanted)
    assert got <= wanted and {x for x in wanted if x[1] < last} <= got


def test_dedup_and_join_run(spark, data, tmp_path):
    stream = WatermarkStrategy.bounded(3_600_000 * 24 * 60).assign(stream_of(spark, data, tmp_path))
    got = collected(spark, watermarks.first_of_each(stream, ["user_id", "event_type"]), tmp_path, "firsts")
    assert got.count() == events(spark, data).select("user_id", "event_type").distinct().count()


def test_running_reduce_equals_batch(spark, data, tmp_path):
    stream = stream_of(spark, data, tmp_path).select("user_id", "seq", "value")
    got = collected(spark, processors.running_reduce(stream, "user_id", "seq", "value", max), tmp_path, "folds")
    batch = aggregates.running(events(spark, data), ["user_id"], F.col("value"), "acc", "max").select("user_id", "seq", "acc")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_rate_limit_equals_batch(spark, data, tmp_path):
    make = lambda: reliability.SlidingLimit(3, 21_600_000)
    got = collected(spark, processors.rate_limited(stream_of(spark, data, tmp_path), "user_id", "seq", "ms", make), tmp_path, "verdicts")
    batch = reliability.rate_limited(events(spark, data), "user_id", make).select("user_id", "seq", "allowed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_eager_join_equals_batch(spark, data, tmp_path):
    window = joins.JoinWindow.of_size(3_600_000)
    stream = stream_of(spark, data, tmp_path).where("event_type in ('click', 'purchase')")
    both = stream.select("user_id", F.when(F.col("event_type") == "click", "l").otherwise("r").alias("side"), "seq", "ms")
    got = collected(spark, processors.eager_join(both, "user_id", window, "left", 30 * 86_400_000), tmp_path, "eager")
    ev = events(spark, data).withColumnRenamed("user_id", "key").select("seq", "ms", "key", "event_type")
    batch = joins.window_join(ev.where("event_type = 'click'").drop("event_type"), ev.where("event_type = 'purchase'").drop("event_type"), window, "left", emit="eager")
    order = lambda df: sorted((x is None, x or 0, y is None, y or 0) for x, y in df.select("l_seq", "r_seq").collect())
    assert order(got) == order(batch)


def test_patterns_equal_batch(spark, data, tmp_path):
    pattern = cep.Pattern.begin("a", F.col("event_type") == "view").followed_by("b", F.col("event_type") == "click").within(86_400_000)
    got = collected(spark, processors.detect(stream_of(spark, data, tmp_path), "user_id", pattern), tmp_path, "patterns")
    batch = cep.detect(events(spark, data), "user_id", pattern)
    assert sorted(tuple(r.seqs) for r in got.collect()) == sorted(tuple(r.seqs) for r in batch.collect())


def test_timers_fire(spark, data, tmp_path):
    stream = WatermarkStrategy.monotonous().assign(stream_of(spark, data, tmp_path)).select("user_id", "seq", "ms", "event_time")

    def on_row(context, row):
        if context.state is None:
            context.state = {"first": int(row["seq"])}
            context.set_timer(int(row["ms"]) + 1000)
        return [(int(row["user_id"]), "row", int(row["seq"]))]

    def on_timer(context, ms):
        return [(-1, "timer", context.state["first"])]

    out = processors.process(stream, "user_id", "seq", "user_id bigint, kind string, seq bigint", on_row, on_timer)
    got = collected(spark, out, tmp_path, "timers")
    assert got.where("kind = 'row'").count() == 1000
    assert 0 < got.where("kind = 'timer'").count() <= 15


def test_upsert_restarts(spark, data, tmp_path):
    stream = stream_of(spark, data, tmp_path).select("user_id", "seq", "value")
    write = sinks.upsert(str(tmp_path / "table"), "user_id", "seq")
    for _ in range(2):  # the second run finds nothing new
        watermarks.run_batches(stream, write, str(tmp_path / "cp"))
    newest = max(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("version="))
    got = spark.read.parquet(str(tmp_path / "table" / newest)).select("user_id", "value")
    batch = events(spark, data).groupBy("user_id").agg(F.max_by("value", "seq"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
