import random

from pyspark.sql import functions as F

from tidewell.llm import common, graph, near_dup


def brute(docs, k=4, percent=80):
    def words(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()

    sets = {}
    for d, t in docs:
        w = words(t)
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), top(d)) for d in ids)


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, n = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "É a b c"), (6, "é a b c")], 10
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
            docs.append((n, " ".join(own)))
            n += 1
    return docs


def test_against_brute_force(spark):
    docs = sample(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("n_shingles", F.lit(1))
    for cell in (1024, 3):  # small cells: many that meet
        got = near_dup.near_duplicates(df, cell=cell).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z w")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_dup.near_duplicates(twice).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", None)]
    kept = near_dup.without_near_duplicates(twice.withColumn("more", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "more"] and kept.count() == 3


def test_equal_ids_with_different_texts(spark):
    rng = random.Random(4)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "another text of a few words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted((r.doc_id, r.text) for r in near_dup.without_near_duplicates(docs).collect()) == sorted([(1, a), (1, b), (4, "another text of a few words")])
    later = spark.createDataFrame([(1, a), (5, a), (5, "a text that only this row has, of a few words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:6]) for r in near_dup.without_near_duplicates(later).collect()) == sorted([(1, a[:6]), (5, "a text")])


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 150)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 150)}}


def test_estimates_are_close():
    import numpy as np

    make, rng = near_dup.Sketcher(32, 4, 1024, 256), np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64))
        b = np.unique(np.r_[a[60:], rng.integers(0, 2**63, 60, dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        odd = [np.frombuffer(make.sketch(x)[1], np.uint64) for x in (a, b)]
        errors.append(float(make.similarity(near_dup._xor_bits(odd[0], odd[1]))) - true)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


def test_nothing_that_grows_is_broadcast(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k % 7) * 50 + i}" for i in range(30)), k) for k in range(40)], "doc_id long, text string, __place long")
    plan = near_dup.near_duplicates(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
    left = near_dup.without_near_duplicates(docs.drop("__place"))
    assert sorted(r.doc_id for r in left.collect()) == list(range(7))


def test_marked_misses_no_key(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(9000).select("id", F.xxhash64("id").alias("by")).unionByName(spark.createDataFrame([(-1, None)], "id long, by long"))
    got = common.marked(rows, F.col("by"), keys, "h").groupBy((F.col("id").between(0, 2999)).alias("in"), "__maybe").count().collect()
    assert {(r["in"], r["__maybe"]): r["count"] for r in got}[(True, True)] == 3000 and (True, False) not in {(r["in"], r["__maybe"]) for r in got}
    assert sum(r["count"] for r in got if not r["in"] and r["__maybe"]) < 60 and sum(r["count"] for r in got) == 9001


def test_bitmap_grows_with_its_keys(spark):
    n = 3_000_000
    assert [common.places_for(k) for k in (0, 1 << 20, n, 10**9)] == [1 << 23, 1 << 23, 1 << 25, 1 << 26]
    keys = spark.range(n).select(F.xxhash64("id").alias("h"))
    rows = spark.range(n - 1000, n + 20000).select("id", F.xxhash64("id").alias("by"))
    got = {r["in"]: r["m"] for r in common.marked(rows, F.col("by"), keys, "h", places=common.places_for(n)).groupBy((F.col("id") < n).alias("in")).agg(F.count_if("__maybe").alias("m")).collect()}
    assert got[True] == 1000 and got[False] < 20000 / 8


def test_cells_beside_a_large_group_are_as_many_as_the_small_ones_need(spark):
    # 400 rows of one label, 9 of their own: every large row meets the nine once, in one cell
    held = spark.range(409).select(F.lit(5).cast("long").alias("bucket"), F.col("id").alias("b"), F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("label"), F.lit(409).cast("long").alias("n"))
    work = near_dup._mixed_cells(held, 20)
    assert work.where("b < 400").count() == 400
    own = work.alias("x").join(work.alias("y"), "task").where("x.b < y.b and x.label <> y.label and (x.within or x.side <> y.side)").select("x.b", "y.b").distinct()
    assert own.count() == 400 * 9 + 36


def test_pairs_that_are_nearly_linked_are_not_listed(spark, monkeypatch):
    # 200 texts around 0.72 of each other: 19,900 pairs that only the full sets refuse
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for d in range(200):
        own = list(base)
        for k in range(4):
            own[50 * k + rng.randrange(4, 46)] = f"d{d}x{k}"
        docs.append((d, " ".join(own)))
    docs += [(200 + k, docs[k][1].replace("w100", "other")) for k in (3, 70)]  # links that only some bands find
    rows, settle = [], near_dup.settle

    def counted(df, tag):
        out = settle(df, tag)
        rows.append((out.count(), tag))
        return out

    monkeypatch.setattr(near_dup, "settle", counted)
    for cell in (1024, 32):
        got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), cell=cell).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)
    assert max(rows)[0] <= 32 * len(docs), max(rows)


def test_common_elements_of_sorted_arrays():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, n)) for n in (30, 1, 12, 0, 25, 0)]
    for one in sets:
        assert near_dup._common(one, sets).tolist() == [len(np.intersect1d(one, x)) for x in sets]
