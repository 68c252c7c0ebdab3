import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm import decontaminate, license_scan, line_dedup, quality_model, quality_rules, substring_dedup
from tidewell.llm.substring_dedup import _marked


def frame(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in {"row": "clash", "line": 1, "kept": "x", **more}.items():
        df = df.withColumn(name, F.lit(value))
    return df


# Long repeats

def test_run_index_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.choice([3, 5, 8])
        base = bytes(rng.choice(b"ab\0") for _ in range(30))
        strings = [bytes(rng.choice(b"abc\0") for _ in range(rng.randint(1, 25))) if rng.random() < 0.4 else base[rng.randint(0, 10) : rng.randint(12, 30)] for _ in range(rng.randint(1, 6))]
        got = {(k, i) for k, a, b in _marked(strings, n) for i in range(a, b + 1)}
        count = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        assert got == {(k, i) for k, s in enumerate(strings) for i in range(len(s) - n + 1) if count[s[i : i + n]] > 1}


def repeats(docs, n):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def long_docs():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    passage = text(200)
    docs = [(i, text(rng.randint(0, 150)) + passage[rng.randint(0, 60) : rng.randint(100, 200)] + text(rng.randint(0, 150))) for i in range(25)]
    return [*docs, (30, None), (31, ""), (32, "x" * 300), (33, passage), (33, passage), (None, docs[0][1])]


def test_long_repeats(spark):
    docs = long_docs()
    for most in (1000, 3):  # 3: groups are split again and again
        got = substring_dedup.without_repeats(frame(spark, docs), length=50, most_contexts=most)
        got = got.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect())) == repeats(docs, 50)
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0


def test_rows_without_a_repeat_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(6)
    single = [(100 + i, "".join(rng.choice("abcdefghijkl ") for _ in range(200))) for i in range(200)]
    docs, passed, marked = [*long_docs(), *single], [], substring_dedup.marked

    def counted(*a, **more):
        out = marked(*a, **more)
        passed.append((out.where("__maybe").count(), out.count()))
        return out

    monkeypatch.setattr(substring_dedup, "marked", counted)
    got = substring_dedup.without_repeats(frame(spark, docs), length=50, most_broadcast=0)  # no table is small enough
    got = got.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == repeats(docs, 50)
    assert all(n < 40 for n, every in (passed[-1], *(x for x in passed if x[1] == len(docs)))) and passed[-1][1] == len(docs)
    contexts = passed[0]  # by their anchors
    assert contexts[1] > 1000 and contexts[0] < contexts[1] / 3


def test_joined_rows_grow_as_the_input(spark, monkeypatch):
    # 20 and 100 pairs that share a passage: few anchors of the small corpus repeat, more than the limit in the large one
    rng, marked, rows = random.Random(7), substring_dedup.marked, []
    text = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))

    def counted(*a, **more):
        out = marked(*a, **more)
        rows[-1] += out.count()
        return out

    monkeypatch.setattr(substring_dedup, "marked", counted)
    for pairs in (20, 100):
        docs = []
        for k in range(pairs):
            passage = text(100)
            docs += [(2 * k, text(150) + passage), (2 * k + 1, passage + text(150))]
        rows.append(0)
        got = substring_dedup.without_repeats(frame(spark, docs), length=50, most_broadcast=300)
        got = got.select(F.col("doc_id").cast("string"), "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect())) == repeats(docs, 50)
    assert rows[1] < 6 * rows[0]


def test_frequent_keys_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 10)
    marked, kept = substring_dedup.marked, []
    monkeypatch.setattr(substring_dedup, "marked", lambda df, *a, **more: kept.append(df.count()) or marked(df, *a, **more))
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 10), (3, 11), (4, 3)) for i in range(n)], "k int, i int")
    keys = rows.where("k < 4").groupBy("k").agg(F.count("*").alias("n"))
    got = substring_dedup._among(rows, keys, ["k"], "n", False)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {1: 500, 2: 10, 3: 11} and kept == [13]


# Lines

def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    bases = ["".join(rng.choice("abé ") for _ in range(n)) for n in (10, 11, 12, 13, 40)]
    docs = []
    for d in range(30):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(bases)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice(["", "z", x[k] + "y"]) + x[k + 1 :]
            lines.append(rng.choice([x, x, "", " \t", "ab"]))
        docs.append((d, "\n".join(lines)))
    docs.append((99, None))
    order = [(d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" \t")]
    gone = {(d, i) for k, (d, i, x) in enumerate(order) if any(x == y or min(len(x), len(y)) >= 11 and within_one(x, y) for _, _, y in order[:k])}
    wanted = {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone) for d, t in docs}
    for most in (200_000, 0):  # 0: nothing is broadcast by hand
        got = line_dedup.without_repeated_lines(frame(spark, docs), counts=("n", "gone"), fuzzy_chars=11, most_broadcast=most)
        assert got.columns == ["doc_id", "text", "row", "line", "kept", "n", "gone"]
        rows = got.collect()
        assert {r.doc_id: r.text or "" for r in rows} == wanted
        assert sum(r.gone for r in rows) == len(gone)


def test_lines_of_repeated_and_empty_tables(spark):
    twice = [(1, "a line that stays\nb"), (1, "a line that stays\nb"), (2, "b\nc"), (None, "c")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.without_repeated_lines(frame(spark, twice)).collect())
    assert got == [("1", "a line that stays\nb"), ("1", "a line that stays\nb"), ("2", ""), ("None", "c")]
    assert line_dedup.without_repeated_lines(frame(spark, [])).count() == 0


# Decontamination

def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    some = lambda n: [rng.choice(["a", "b", "É", "é", "c1", "D"]) for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([12, 15, 10, 4, 7, 1])] + [(10, None), (11, "..."), (12, "É D É")]
    docs = []
    for k in range(40):
        w = some(rng.randint(0, 30))
        if rng.random() < 0.6:
            w += (rng.choice(items)[1] or "").lower().split() + some(3)
        docs.append((k, ("-" if k % 2 else "\n ").join(w)))
    docs += [(50, None), (51, ""), (None, items[0][1]), (52, " ".join(some(5000)))]
    wanted = []
    for d, t in docs:
        w, hit, met = words_of(t), set(), set()
        for item, text in items:
            x = words_of(text)
            n = min(10, len(x))
            cut = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in cut:
                    hit |= set(range(i, i + n))
                    met.add(str(item))
        wanted.append((str(d), len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most, block in ((200_000, 2000), (0, 7)):
        got = decontaminate.contamination(frame(spark, docs), bench, most_broadcast=most, block=block).drop("row")
        assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got.collect())) == sorted(wanted)
    clean = decontaminate.clean(frame(spark, docs), bench)
    assert clean.count() == sum(not x[-1] for x in wanted) and clean.columns == ["doc_id", "text", "row", "line", "kept"]
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


# Quality

def test_figures_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n\t#|é\x1c") for _ in range(rng.randint(0, 60)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.figures(t) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_cascade_order_does_not_change_verdicts(spark):
    good = " ".join(f"word{i} other{7 * i}" for i in range(60))
    docs = [(1, good), (2, None), (3, ""), (4, good.upper()), (5, " ".join(f"a{i}$$$" for i in range(80))), (6, good), (6, good)]
    got = sorted((r.doc_id, r.kept) for r in quality_rules.judge(frame(spark, docs)).collect())
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (6, True)]
    for d, t in docs:
        f = quality_rules.figures(t or "")
        assert len({quality_rules.verdict(t or "", f, order) for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1])}) == 1
    assert sorted(quality_rules.cascade_order(frame(spark, docs))) == sorted(quality_rules.RULES)
    kept = quality_rules.passing(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "row", "line", "kept"] and kept.count() == 3
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(3)
    truth, accuracy, patterns = [], (0.9, 0.8, 0.7, 0.6), Counter()
    for _ in range(5000):
        y = rng.random() < 0.3
        truth.append((y, tuple((1 if rng.random() < a else -1) if y else (1 if rng.random() < 0.1 else -1 if rng.random() < 0.6 else 0) for a in accuracy)))
        patterns[truth[-1][1]] += 1
    posterior, chance = quality_model.estimate(dict(patterns))
    assert all(abs(c[1][1] - a) < 0.1 and abs(c[0][1] - 0.1 / 0.64) < 0.1 for c, a in zip(chance, accuracy, strict=True))
    assert sum((posterior[v] > 0.5) == y for y, v in truth) / len(truth) > 0.85
    assert quality_model.estimate({})[0] == {}


def test_figures_of_a_batch_against_plain_counts():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "Idiot!", "AB", "a#b|", "x!", "mot", "mot"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += ["", "  ", " lead", "trail\n"]
    t = quality_model.Texts(texts)
    f = t.figures()
    for k, text in enumerate(texts):
        w = text.split()
        n, windows = max(1, len(w)), list(zip(w, w[1:], w[2:], strict=False))
        wanted = {
            "symbols": sum(text.count(c) for c in "#*$%&|<>") / n, "marked": sum(any(c in x for c in "#*$%&|<>") for x in w) / n, "exclamations": text.count("!") / n, "capitals": w.count("AB") / n,
            "insults": w.count("Idiot!") / n, "english": w.count("the") / n, "different": len(set(w)) / n, "insult_words": "Idiot!" in w, "repeated": sum(windows.count(x) > 1 for x in windows) / max(1, len(w) - 2),
        }
        assert t.n[k] == len(w) and all(abs(f[name][k] - x) < 1e-9 for name, x in wanted.items()), (text, wanted)
    assert not t.votes(f)[[texts.index(""), texts.index("  ")]].any()


def test_model_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels.where("doc_id % 3 > 0"))
    scored = quality_model.score(docs, model)
    held = scored.join(labels.where("doc_id % 3 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r for r in held if r.quality == 1 and r.toxic == 0]
    poor = [r for r in held if r.quality == 0]
    print("kept clean", sum(r.kept for r in clean), len(clean), "poor found", sum(not r.kept for r in poor), len(poor))
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(not r.kept for r in poor) >= 0.9 * len(poor)
    toxic = [r for r in held if r.toxic == 1]
    assert sum(not r.kept for r in toxic) >= 0.9 * len(toxic)
    for lang in {r.lang for r in toxic}:
        own = [r for r in toxic if r.lang == lang]
        print(lang, sum(not r.kept for r in own), len(own))
        assert sum(not r.kept for r in own) >= 0.6 * len(own)  # a language may have few labels at this size
    assert all(c[1][1] > c[0][1] for name, c in model["labellers"].items() if name.startswith("toxic"))
    # each score by a plain loop over the text's own words
    some = [r for r in docs.orderBy("doc_id").limit(60).collect()]
    got = {r.doc_id: r for r in scored.where("doc_id <= " + str(max(r.doc_id for r in some))).collect()}
    for r in some:
        t = quality_model.Texts([r.text or ""])
        for name in quality_model.CLASSES:
            m = model["scorers"][name]
            ids = {i for row in t.hashed().tolist() for i in row} | set(t.of_text(t.figures())[0].tolist() if t.n[0] else [])
            z = m["bias"] + sum(m["weights"].get(str(i), 0.0) for i in ids)
            assert abs(got[r.doc_id][f"p_{name}"] - 1 / (1 + math.exp(-z))) < 2e-6
    again = quality_model.score(frame(spark, [(1, None), (2, ""), (2, ""), (None, "you idiot")]), model).collect()
    assert len(again) == 4 and all(r.kept for r in again if r.doc_id is not None)


def test_model_of_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert quality_model.score(none, quality_model.fit(none, labels)).count() == 0
    some = frame(spark, [(1, "a few words"), (1, "a few words"), (2, None)])
    assert quality_model.score(some, quality_model.fit(some, labels)).where("kept").count() == 3


def test_license_scan(spark):
    docs = [
        (1, "text\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (2, "Licensed under CC BY 4.0."), (3, "We discussed the license of the driver with the office yesterday and left."),
        (4, None), (5, ""), (6, "prefix words Licensed under the Apache License, Version 2.0. and some more"), (7, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3."), (1, "All rights reserved."),
    ]
    got = sorted((r.doc_id, r.line, r.license) for r in license_scan.scan(frame(spark, docs, license=1)).collect())
    assert got == [(1, 0, "all-rights-reserved"), (1, 1, "CC-BY-NC-4.0"), (1, 2, "MIT"), (2, 0, "CC-BY-4.0"), (6, 0, "Apache-2.0"), (7, 0, "GPL-3.0")]
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_rank_keeps_what_all_templates_would_give(spark):
    """Against every template by exact wording, on the documents' own license lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.line): r.license for r in license_scan.scan(docs).collect()}
    words = {n: license_scan.wording(t) for n, t in license_scan.TEMPLATES.items()}
    wanted = {}
    for r in docs.where(F.col("text").rlike(license_scan.CANDIDATE)).collect():
        for i, line in enumerate(r.text.split("\n")):
            if re.search(license_scan.CANDIDATE, line):
                w = license_scan.wording(line)
                fits = [(100 * license_scan.word_differences(t, w) // len(t), -len(t), n) for n, t in words.items() if 100 * license_scan.word_differences(t, w) <= 12 * len(t)]
                if fits:
                    wanted[r.doc_id, i] = min(fits)[2]
    assert got == wanted and len(got) > 30


def test_license_in_long_lines(spark):
    prose = " ".join(f"word{i} and other{7 * i} things" for i in range(800))
    assert len(prose) > 20000
    names = list(license_scan.TEMPLATES)
    docs = [(k, f"{prose} {license_scan.TEMPLATES[n]} {prose}") for k, n in enumerate(names)]
    docs.append((100, f"{prose} Released under the MIT License. {prose} All rights reserved. {prose}"))
    got = sorted((r.doc_id, r.license) for r in license_scan.scan(frame(spark, docs)).collect())
    assert got == [*enumerate(names), (100, "MIT"), (100, "all-rights-reserved")]


def test_license_anchors_against_word_differences():
    rng = random.Random(11)
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 12)
    met = 0
    for _ in range(400):
        k = rng.randrange(len(scanner.words))
        words = list(scanner.words[k])
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(words) + 1)
            words[i : i + rng.randint(0, 1)] = rng.choice([[], ["x"], ["the"]])
            words = words or ["x"]
        words = ["x"] * rng.randint(0, 3) + words + ["license"] * rng.randint(0, 3)
        least = {}
        for j, n, *_ in scanner.matches(words):
            least[j] = min(n, least.get(j, n))
        exact = {j: license_scan.word_differences(t, words) for j, t in enumerate(scanner.words)}
        assert least == {j: n for j, n in exact.items() if n <= scanner.most[j]}
        met += k in least
    assert met > 100


def test_license_wrapped_over_lines(spark):
    names = list(license_scan.TEMPLATES)
    docs = []
    for n in names:
        words = license_scan.TEMPLATES[n].replace("* * *", "Jo Doe").split()
        for wide in (2, 3, 7):
            for sign in ("", " * ", "# ", "//"):
                wrapped = "\n".join(sign + " ".join(words[i : i + wide]) for i in range(0, len(words), wide))
                docs.append((len(docs), f"Some code\n{wrapped}\n\nmore of it"))
    got = sorted((r.doc_id, r.line, r.license) for r in license_scan.scan(frame(spark, docs)).collect())
    assert got == [(k, 1, names[k // 12]) for k in range(len(docs))]


def test_license_named_with_one_other_word(spark):
    docs = [(1, "Licensed under the MIT License."), (2, "Available under CC BY-SA 4.0"), (3, "We like the MIT License."), (4, "Released under the BSD License."), (5, "no rights reserved")]
    got = sorted((r.doc_id, r.license, r.word_differences) for r in license_scan.scan(frame(spark, docs)).collect())
    assert got == [(1, "MIT", 1), (2, "CC-BY-SA-4.0", 1)]


def test_clean_texts_of_other_scripts_are_kept(spark):
    forms = {"Cyrillic": "слово{}ами", "Greek": "λέξη{}", "Arabic": "كلمة{}", "Hebrew": "מילה{}", "Devanagari": "शब्द{}", "Thai": "ประโยคภาษาไทยที่ยาวมาก{}", "Chinese": "这是一个没有空格的很长的中文句子{}", "Japanese": "これはとてもながいにほんごのぶんしょうです{}"}
    docs = [(k, "USA " + " ".join(form.format(i) for i in range(80))) for k, form in enumerate(forms.values())]
    shouts = [(100, " ".join(f"WORD{i} É" for i in range(80))), (101, " ".join(f"averyverylongword{i}é" for i in range(80)))]
    assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(frame(spark, docs + shouts)).collect()) == [*((k, True) for k in range(len(forms))), (100, False), (101, False)]
    for texts, vote in ((docs, False), (shouts[:1], True)):
        t = quality_model.Texts([x for _, x in texts])
        assert ((t.votes(t.figures())[:, 5] == 1) == vote).all()


def test_license_share_saved_decides(spark):
    notice = license_scan.TEMPLATES["GPL-3.0"]
    prose = " ".join(f"word{i % 97} other{i % 89}" for i in range(2000))
    docs = [(1, notice), (2, f"{prose} {notice} {prose}"), (3, "# " + notice.replace(" ", "\n# ")), (4, "Licensed under CC BY 4.0.")]
    got = {r.doc_id: (r.license, r.saved_permille) for r in license_scan.scan(frame(spark, docs)).collect()}
    # neither the length of the line nor the breaks weaken the share
    assert got[1] == got[2] == got[3] and got[1][0] == "GPL-3.0" and got[1][1] > 700 > got[4][1] > license_scan.LEAST_SAVED
    assert sorted(r.doc_id for r in license_scan.scan(frame(spark, docs), least=700).collect()) == [1, 2, 3]
