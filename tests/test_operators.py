"""Small fixtures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.operators import aggregates, analytics, cdc, cep, joins, log, registry, reliability, windows
from tidewell.operators.table import UpsertTable
from tidewell.sources import sinks, sources
from tidewell.stream import Stream, sliding_ms, tumbling_ms


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fluent_surface(spark):
    s = Stream(sources.from_elements(spark, [("a", 1), ("b", 2), ("a", 3)], "key string, v int"))
    assert rows(s.map(w=F.col("v") * 2).filter(F.col("w") > 2).df, "seq", "w") == [(1, 4), (2, 6)]
    assert rows(s.flat_map(F.array_repeat("v", F.col("v")), "x").df, "x") == [(1,), (2,), (2,), (3,), (3,), (3,)]
    assert rows(s.key_by("key").sum("v").df, "seq", "sum") == [(0, 1), (1, 2), (2, 4)]
    assert rows(s.key_by("key").window(tumbling_ms(2)).count(), "key", "w_start", "n") == [("a", 0, 1), ("a", 2, 1), ("b", 0, 1)]
    assert rows(s.key_by("key").count_window(2).apply("v", lambda e: e), "key", "out") == [("a", 1), ("a", 3), ("b", 2)]
    assert len(rows(s.key_by("key").window(sliding_ms(2, 1)).count(), "key", "w_start", "n")) == 6


def test_window_bounds(spark):
    df = spark.createDataFrame([(1, -1), (2, 0), (3, 9), (4, 10)], "seq long, ms long")
    assert rows(windows.tumbling(df, 10), "ms", "w_start", "w_end") == [(-1, -10, 0), (0, 0, 10), (9, 0, 10), (10, 10, 20)]
    assert rows(windows.sliding(df.where("ms = 10"), 10, 5), "w_start") == [(5,), (10,)]
    touch = df.select(windows.windows_intersect(F.lit(0), F.lit(5), F.lit(5), F.lit(9)).alias("x"))
    assert not touch.first()["x"]


def test_sessions_that_touch(spark):
    df = spark.createDataFrame([("k", 0), ("k", 10), ("k", 25)], "key string, ms long")
    assert rows(windows.session_aggregate(df, ["key"], 10, {"n": F.count("*")}), "w_start", "w_end", "n") == [(0, 20, 2), (25, 35, 1)]
    assert rows(windows.session_aggregate(df, ["key"], 10, {"n": F.count("*")}, touching=False), "w_start", "n") == [(0, 1), (10, 1), (25, 1)]


def test_join_fixture(spark):
    orders = spark.createDataFrame([(1, 1000, "user1", 99.99)], "seq long, ms long, key string, amount double")
    users = spark.createDataFrame([(2, 1000, "user1", "Alice"), (3, 10999, "user1", "A"), (4, 12000, "user1", "B")], "seq long, ms long, key string, name string")
    out = joins.window_join(orders, users, joins.JoinWindow.of_size(10_000), "inner")
    assert rows(out, "r_name") == [("A",), ("Alice",)]
    eager = joins.window_join(orders, users, joins.JoinWindow.of_size(10_000), "left", emit="eager")
    assert eager.count() == 3  # alone at its arrival, then two pairs
    assert joins.window_join(orders, users, joins.JoinWindow.of_size(10_000), "left").count() == 2
    with pytest.raises(ValueError):
        joins.JoinWindow(-1, 0)
    assert rows(joins.evicted(orders, users, 2), "seq") == [(3,), (4,)]


def test_buckets_lose_nothing(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, rng.randint(-50, 50), "k") for i in range(60)], "seq long, ms long, key string")
    right = spark.createDataFrame([(100 + i, rng.randint(-50, 50), "k") for i in range(60)], "seq long, ms long, key string")
    for w in (joins.JoinWindow(7, 3), joins.JoinWindow(0, 0), joins.JoinWindow(0, 9)):
        both = [rows(joins.window_join(left, right, w, buckets=b), "l_seq", "r_seq") for b in (True, False)]
        assert both[0] == both[1]


def simulate(letters, steps, within=None):
    """The rules of a match once more, on strings, for plain steps."""
    machine = cep.Machine([(f, lo, hi) for _, f, lo, hi in steps], within)
    out = []
    for i, (ms, c) in enumerate(letters):
        bits = sum(1 << k for k, s in enumerate(steps) if s[0] == c)
        out += [tuple(e[0] for e in m) for m in machine.feed(i, ms, bits)]
    return out


def test_pattern_counts():
    seq = lambda s: [(1000 * i, c) for i, c in enumerate(s)]
    assert simulate(seq("ACDB"), [("A", "relaxed", 1, 1), ("B", "relaxed", 1, 1)]) == [(0, 3)]
    assert simulate(seq("ACB"), [("A", "relaxed", 1, 1), ("B", "strict", 1, 1)]) == []
    assert simulate(seq("ABB"), [("A", "relaxed", 1, 1), ("B", "any", 1, 1)]) == [(0, 1), (0, 2)]
    assert simulate(seq("ABB"), [("A", "relaxed", 1, 1), ("B", "relaxed", 1, 1)]) == [(0, 1)]
    assert len(simulate(seq("AAAAA"), [("A", "relaxed", 1, cep.UNBOUNDED)])) == 5
    assert simulate(seq("AAAAA"), [("A", "relaxed", 3, 3)]) == [(0, 1, 2)]
    assert len(simulate(seq("AAAAA"), [("A", "relaxed", 2, 4)])) == 3
    assert simulate([(0, "A"), (11, "B")], [("A", "relaxed", 1, 1), ("B", "relaxed", 1, 1)], 10) == []
    assert simulate(seq("AB"), [("A", "relaxed", 1, 1), ("B", "relaxed", 0, 1)]) == [(0, 1)]


def test_closed_forms_against_the_machine(spark):
    rng = random.Random(5)
    data = [(k, i, 10 * i + rng.randint(0, 9), rng.choice("ABC")) for k in range(40) for i in range(12)]
    df = spark.createDataFrame(data, "key long, seq long, ms long, e string")
    a, b = F.col("e") == "A", F.col("e") == "B"
    pick = (F.col("key"), F.col("seqs")[0], F.col("seqs")[1])
    begin = cep.Pattern.begin("a", a)
    assert rows(cep.detect(df, "key", begin.next("b", b)), *pick) == rows(cep.matched_next(df, "key", a, b), "key", "a_seq", "b_seq")
    assert rows(cep.detect(df, "key", begin.followed_by("b", b).within(30)), *pick) == rows(cep.matched_followed_by(df, "key", a, b, 30), "key", "a_seq", "b_seq")
    assert rows(cep.detect(df, "key", begin.followed_by_any("b", b).within(30)), *pick) == rows(cep.matched_followed_by_any(df, "key", a, b, 30), "key", "a_seq", "b_seq")
    ends = (F.col("key"), F.col("seqs")[0], F.element_at("seqs", -1), F.size("seqs").cast("long"))
    for pattern, args in ((begin.one_or_more(), (1,)), (begin.times(3), (3, 3)), (begin.times(2, 4), (2, 4))):
        assert rows(cep.detect(df, "key", pattern), *ends) == rows(cep.matched_repeats(df, "key", a, *args), "key", "first_seq", "last_seq", "n")


def test_tables(spark):
    changes = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", 5), (4, "b", None)], "seq long, key string, v int")
    t = UpsertTable.from_stream(changes, "key", "seq", F.col("v").isNull())
    assert rows(t.rows, "key", "v") == [("a", 5)]
    assert t.map_values(w=F.lit(None).cast("int")).rows.count() == 0
    assert t.filter(F.col("v") > 5).rows.count() == 0


def test_limits():
    sliding = reliability.SlidingLimit(2, 100)
    assert [sliding.allow(t) for t in (0, 10, 20, 100, 101, 111)] == [True, True, False, True, False, True]
    tokens = reliability.TokenBucket(2, 10)
    assert [tokens.allow(t) for t in (0, 0, 0, 100, 50, 200)] == [True, True, False, True, False, True]
    leaky = reliability.LeakyBucket(2, 10)
    assert [leaky.allow(t) for t in (0, 0, 0, 100, 100)] == [True, True, False, True, False]


def test_retry_policy():
    policy = reliability.RetryPolicy(most_attempts=2, never=(KeyError,))
    assert [policy.delay_ms(n) for n in (1, 2, 3, 20)] == [100, 200, 400, 10_000]
    slept, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("again")
        return "done"

    assert policy.run(work, slept.append) == "done" and slept == [0.1, 0.2]
    with pytest.raises(KeyError):
        policy.run(lambda: {}["x"], slept.append)


def test_split_failures(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, None)], "seq long, s string")
    split = reliability.split_failures(df, F.col("s").try_cast("int").isNotNull(), F.lit(" "))
    assert rows(split.good, "seq") == [(1,)]
    assert rows(split.dead, "seq", "error") == [(2, "Unknown error"), (3, "Unknown error")]
    with pytest.raises(Exception, match="bad"):
        reliability.split_failures(df, F.col("s") == "1", F.lit("bad"), reliability.FAIL_FAST).good.collect()


def test_dedup_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "seq long, key string")
    assert rows(reliability.first_of_each(df, ["key"]), "seq") == [(1,), (2,), (4,)]
    assert rows(reliability.duplicates_marked(df, ["key"]).where("duplicate"), "seq") == [(3,)]


def test_scalars(spark):
    one = spark.range(1).select(
        scalar.string_hash32(F.lit("abc")).alias("h"), scalar.string_hash32(F.lit("")).alias("e"), scalar.hash_partition(F.lit("abc"), 8).alias("p"),
        scalar.routed_partition(F.lit("13"), F.lit("abc"), 8).alias("r"), (scalar.record_id(F.lit("10-2")) < scalar.record_id(F.lit("10-10"))).alias("less"),
        scalar.table_allowed(F.lit("shop"), F.lit("orders"), ["shop.ord*"], ["*.x"]).alias("yes"), scalar.table_allowed(F.lit("shop"), F.lit("orders"), [], ["ord*"]).alias("no"),
        scalar.compares(F.lit("9"), "<", "10").alias("number"), scalar.compares(F.lit("b"), ">", "a").alias("text"), scalar.compares(F.lit(None), "!=", "a").alias("missing"),
        scalar.significant_change(F.lit(0.0), F.lit(1.0), "PERCENTAGE", 500).alias("zero"), scalar.is_offloaded(F.repeat(F.lit("x"), 65537)).alias("large"),
        scalar.decoded_columns(F.lit("id[integer]:1 name[text]:'it''s me' x[text]:null")).alias("m"),
    ).first()
    assert (one.h, one.e, one.p, one.r) == (96354, 0, 2, 5)
    assert one.less and one.yes and not one.no and one.number and one.text and not one.missing and one.zero and one.large
    assert one.m == {"id": "1", "name": "it's me", "x": None}


def test_logical_decoding(spark):
    lines = spark.createDataFrame([("table public.t: INSERT: id[integer]:1 n[text]:'a b'",), ("table public.t: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 n[text]:'c'",), ("table public.t: DELETE: id[integer]:2",), ("BEGIN 1",)], "value string")
    got = {r.event_type: r for r in cdc.decoded_lines(lines).collect()}
    assert got["INSERT"].after == {"id": "1", "n": "a b"} and got["INSERT"].key == "1"
    assert got["UPDATE"].before == {"id": "1"} and got["UPDATE"].after == {"id": "2", "n": "c"}
    assert got["DELETE"].before == {"id": "2"} and got["DELETE"].after is None


def test_quantile_rank(spark):
    df = spark.range(1, 101).select(F.lit("m").alias("k"), F.col("id").cast("double").alias("v"))
    r = analytics.quantiles(df, ["k"], "v", {"p99": 0.99, "lo": -1, "hi": 2}).first()
    assert (r.p99, r.lo, r.hi) == (99.0, 1.0, 100.0)


def test_load_score(spark):
    one = spark.range(1).select(F.lit(9).alias("w"), F.lit(25.0).alias("cpu"), F.lit(50.0).alias("latency"), F.lit("z").alias("zone"), F.lit(3).alias("queue"), F.lit(None).cast("double").alias("memory"))
    m = {c: F.col(c) for c in ("cpu", "latency", "queue", "memory")}
    score = registry.load_score(F.col("w"), m, near=[(F.col("zone"), "z", registry.ZONE_BOOST)])
    assert one.select(score).first()[0] == pytest.approx(2 * 1.05 * 0.75 * 0.5)
    assert one.select(registry.load_score(F.col("w"), m, {"queue": 1.0, "memory": 1.0})).first()[0] == pytest.approx(2 * 0.75 * 0.5 * 0.25)
    assert one.select(registry.load_score(F.col("w"), m, limits={"cpu": 20})).first()[0] is None
    assert one.select(registry.load_score(F.col("w"), m, limits={"cpu": 25, "memory": 1})).first()[0] is not None


def test_best_breaks_ties_and_never_leaves_a_service_without(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "v", 0.5), ("b", "q", None), ("b", "p", None)], "service string, instance string, s double")
    assert rows(registry.best(df, "service", F.col("s"), "instance"), "service", "instance", "score") == [("a", "x", 1.0), ("b", "p", None)]


def test_watermark_by_slots(spark):
    rng = random.Random(5)
    given = [(i, rng.randrange(1000) if rng.random() > 0.1 else None) for i in range(500)] + [(None, 40)]
    df = spark.createDataFrame(given, "arrival long, ms long")
    whole = windows.watermark_before(df, 10)
    for width in (1, 7, 100_000):
        slotted = windows.watermark_before(df, 10, slot=F.floor(F.col("arrival") / width))
        assert whole.exceptAll(slotted).count() == 0 and slotted.count() == 501


def test_round_robin_is_smooth(spark):
    instances = spark.createDataFrame([("s", "a", 5), ("s", "b", 1), ("s", "c", 1), ("z", "only", 0)], "service string, instance string, weight int")
    requests = spark.createDataFrame([*((i, "s") for i in range(14)), (99, "z")], "seq int, service string")
    picks = registry.round_robin(instances, requests, "service", "weight", "instance", "seq").orderBy("seq").collect()
    assert [r.instance for r in picks] == [*"aabacaaaabacaa", "only"]


def test_round_robin_is_fair(spark):
    instances = spark.createDataFrame([("s", "a", 3), ("s", "b", 1)], "service string, instance string, weight int")
    requests = spark.range(8).select(F.lit("s").alias("service"), F.col("id").alias("seq"))
    picks = registry.round_robin(instances, requests, "service", "weight", "instance", "seq").groupBy("instance").count()
    assert rows(picks, "instance", "count") == [("a", 6), ("b", 2)]


def test_round_robin_against_the_plain_recurrence(spark):
    rng = random.Random(3)
    weights = {"a": [rng.randint(0, 6) for _ in range(23)], "b": [4, 4, 2, 1, 1, 1], "c": [1]}
    instances = spark.createDataFrame([(s, f"i{k:02}", w) for s, ws in weights.items() for k, w in enumerate(ws)], "service string, instance string, weight int")
    asked = [(k, rng.choice("abcx")) for k in range(900)]
    wanted, now = [], {s: [0] * len(ws) for s, ws in weights.items()}
    for k, s in asked:
        if s in weights:
            w = [max(1, x) for x in weights[s]]
            now[s] = [x + y for x, y in zip(now[s], w, strict=True)]
            at = now[s].index(max(now[s]))
            now[s][at] -= sum(w)
            wanted.append((k, s, f"i{at:02}"))
    requests = spark.createDataFrame(asked, "seq long, service string")
    for slot in (None, F.floor(F.col("seq") / 64)):
        assert rows(registry.round_robin(instances, requests, "service", "weight", "instance", "seq", slot=slot), "seq", "service", "instance") == wanted


def test_round_robin_over_many_instances(spark):
    n = 3000  # a step that looks at every instance for every instance doesn't get there
    instances = spark.range(n).select(F.lit("s").alias("service"), F.format_string("i%05d", "id").alias("instance"), (F.col("id") % 5).alias("weight"))
    requests = spark.range(6600).select(F.lit("s").alias("service"), F.col("id").alias("seq"))
    picks = registry.round_robin(instances, requests, "service", "weight", "instance", "seq")
    times = picks.groupBy("instance").count().groupBy("count").agg(F.count("*").alias("of"))
    assert rows(times, "count", "of") == [(1, 1200), (2, 600), (3, 600), (4, 600)]


def _broadcast_bytes(df):
    """The most bytes of a broadcast in the plan that has run."""
    df.collect()
    sent, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            left.append(node.plan())
        if "BroadcastExchange" in node.nodeName():
            sent = max(sent, node.metrics().apply("dataSize").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return sent


def test_weighted_choice_meets_few_shares(spark):
    rng = random.Random(4)
    weights = {"s": [rng.choice([0, 1, 2, 900]) for _ in range(800)], "t": [3]}
    instances = spark.createDataFrame([(s, f"i{k:03}", w) for s, ws in weights.items() for k, w in enumerate(ws)], "service string, instance string, weight int")
    asked = [(k, rng.choice("sstx"), rng.choice([rng.random(), rng.randrange(8) / 8, 0.0])) for k in range(2000)] + [(2001, "s", None), (2002, "s", 1.0), (2003, "s", -0.1), (2004, "s", float("nan"))]
    wanted = []
    for k, s, draw in asked:
        if s in weights and draw is not None:
            low, total = 0, sum(max(1, w) for w in weights[s])
            for i, w in enumerate(weights[s]):
                if low <= draw * total < low + max(1, w):
                    wanted.append((k, s, f"i{i:03}"))
                low += max(1, w)
    got = registry.weighted_choice(instances, spark.createDataFrame(asked, "seq long, service string, draw double"), "service", "weight", "instance", "draw")
    assert rows(got, "seq", "service", "instance") == wanted
    keys = got._jdf.queryExecution().sparkPlan().toString()
    assert any("Join [service" in line and "__piece" in line for line in keys.split("\n"))  # not by the service alone


def test_ring_isn_t_broadcast(spark):
    nodes = spark.range(300).select(F.format_string("n%d", "id").alias("name"))
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"), F.col("id").alias("node"))
    ring = registry.hash_ring(nodes, "name", 40)
    found = registry.on_ring(keys.unionByName(spark.createDataFrame([(None, 1)], "key string, node long")), "key", ring)
    points = sorted((r.position, r.node) for r in ring.collect())
    places = [(r.key, r.p) for r in keys.select("key", scalar.ring_position("key").alias("p")).collect()]
    assert rows(found, "key", "node") == sorted((k, next((n for at, n in points if at >= p), points[0][1])) for k, p in places)
    one = registry.on_ring(keys, "key", registry.hash_ring(nodes.limit(1), "name", 1))  # nearly all slots are empty
    assert {r.node for r in one.collect()} == {"n0"} and found.columns == ["key", "node"]
    sent = [_broadcast_bytes(registry.on_ring(keys, "key", registry.hash_ring(nodes, "name", n))) for n in (100, 1000)]
    assert sent[1] < 1.5 * sent[0]


def test_log_pages(spark):
    df = spark.range(20).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("p"), (F.col("id") * 10).alias("idle"))
    assert rows(log.newest(df, "p", "seq", 2), "seq") == [(16,), (17,), (18,), (19,)]
    assert rows(log.pending(df, "idle", 100, "idle", 3), "seq") == [(17,), (18,), (19,)]


def test_sources_and_sinks(spark, tmp_path):
    lines = sources.from_elements(spark, ["x", "y"])
    sinks.text_file(lines, str(tmp_path / "t"), "v")
    sinks.text_file(lines, str(tmp_path / "t"), "v", append=True)
    assert sources.text_lines(spark, str(tmp_path / "t")).count() == 4
    raw = spark.createDataFrame([('{"a": 1}',), ("{bad",), ('[{"a": 2}, {"a": 3}]',)], "value string")
    assert rows(sources.decoded(raw.limit(2), "a int"), "data.a") == [(1,)]
    assert rows(sources.decoded_list(raw.where("value like '[%'"), "a int"), "data.a") == [(2,), (3,)]
    known: set[str] = set()
    sources.checked_source_id("orders-1", known)
    for bad in ("orders-1", "a b"):
        with pytest.raises(ValueError):
            sources.checked_source_id(bad, known)
    write = sinks.idempotent_append(str(tmp_path / "i"), "id")
    batch = spark.createDataFrame([("a",), ("b",), (" ",)], "id string")
    for n, df in ((0, batch), (1, batch.union(spark.createDataFrame([("c",)], "id string"))), (1, batch.union(spark.createDataFrame([("c",)], "id string")))):
        write(df, n)
    assert rows(spark.read.parquet(str(tmp_path / "i")), "id") == [("a",), ("b",), ("c",)]


def test_running_fold_streams_a_key_of_many_rows(spark):
    n = 200_000  # an array of folds that is copied at every row doesn't get there
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, 1).otherwise(2).cast("long").alias("k"), F.col("id").alias("seq"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    own = rows.unionByName(spark.createDataFrame([(None, 1, 5.0), (None, 2, None), (None, 3, float("nan")), (None, 4, 6.0)], "k long, seq long, v double"))
    got = aggregates.running_fold(own, "k", "seq", "v", float("-inf"), aggregates.greatest, "fold")
    wanted = aggregates.running(rows, ["k"], F.col("v"), "fold", "max").select("k", "seq", "fold")
    assert got.where("k is not null").exceptAll(wanted).count() == 0 and got.count() == n + 4
    assert [str(r.fold) for r in got.where("k is null").orderBy("seq").collect()] == ["5.0", "5.0", "nan", "nan"]
