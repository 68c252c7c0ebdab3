"""The pipeline's stages against plain versions, each on its own input."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_near_dup import brute
from test_texts import within_one, words_of

from tokenizers import Tokenizer

from tidewell.llm import quality_rules
from tidewell.llm.common import settle, table


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents").where("n_chars < 4000")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]

    passed = settle(stage["quality_rules"](spark, docs, sf_dir), "q")
    order = list(quality_rules.RULES)
    assert passed.columns == columns
    assert {r.doc_id for r in passed.collect()} == {r.doc_id for r in docs.collect() if quality_rules.verdict(r.text, quality_rules.figures(r.text), order)}

    lined = settle(stage["line_dedup"](spark, passed, sf_dir), "l")
    lines = [(r.doc_id, i, x) for r in sorted(passed.collect(), key=lambda r: r.doc_id) for i, x in enumerate(r.text.split("\n"))]
    worded = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x[2])]
    gone, seen = set(), []
    for d, i, x in worded:
        if any(x == y or min(len(x), len(y)) >= 40 and abs(len(x) - len(y)) < 2 and within_one(x, y) for y in seen):
            gone.add((d, i))
        seen.append(x)
    wanted = {}
    for d, i, x in lines:
        wanted.setdefault(d, [])
        if (d, i) not in gone:
            wanted[d].append(x)
    assert lined.columns == columns
    assert {r.doc_id: r.text for r in lined.collect()} == {d: "\n".join(x) for d, x in wanted.items()}

    near = settle(stage["near_dedup"](spark, lined, sf_dir), "n")
    assert near.columns == columns
    assert {r.doc_id for r in near.collect()} == {d for d, _, c in brute([(r.doc_id, r.text) for r in lined.collect()], 5) if d == c}

    clean = settle(stage["decontamination"](spark, near, sf_dir), "c")
    grams = {tuple(w[i : i + 10]) for r in table(spark, sf_dir, "benchmark").collect() for w in [words_of(r.text)] for i in range(max(1, len(w) - 9))}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect() if not any(tuple(w[i : i + 10]) in grams for w in [words_of(r.text)] for i in range(len(w) - 9))}

    pieces = stage["packing"](spark, clean, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}
    assert all(sum(p.length for p in pieces if p.doc_id == r.doc_id) == r.doc_tokens for r in pieces)


def written(spark, folder, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    for name in ("row", "line", "kept", "place", "h1"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_hand(docs, items):
    """The rows of the pipeline before packing, stage by stage, by plain comparisons; a row twice is one document."""
    order = list(quality_rules.RULES)
    left = {d: t for d, t in docs if quality_rules.verdict(t or "", quality_rules.figures(t or ""), order)}
    seen, lined = [], {}
    for d in sorted(left):
        stay = []
        for x in left[d].split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                gone = any(x == y or min(len(x), len(y)) >= 40 and abs(len(x) - len(y)) < 2 and within_one(x, y) for y in seen)
                seen.append(x)
                if gone:
                    continue
            stay.append(x)
        lined[d] = "\n".join(stay)
    first = {d for d, _, c in brute(list(lined.items()), 5) if d == c}
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [words_of(t)] if w for i in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    return {d: lined[d] for d in first if not hit(words_of(lined[d]))}


def test_run_against_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8)))
    text = lambda lines, size=14: "\n".join(" ".join(word() for _ in range(size)) for _ in range(lines))
    items = [("a", text(1, 25)), ("b", text(1, 11)), ("c", None), ("d", "..."), ("e", " ".join(word() for _ in range(4)))]
    docs = [(k, text(6)) for k in range(12)]
    common = text(1)
    docs += [(20 + k, f"{text(4)}\n{common if k % 2 else common[:9] + 'Z' + common[10:]}\n{text(2)}") for k in range(5)]
    base = [word() for _ in range(300)]
    docs += [(30 + k, " ".join(base[: 150 + k] + [word()] + base[151 + k :])) for k in range(4)]  # near copies
    docs += [(40, text(5) + " " + items[0][1]), (41, text(5) + "\n" + " ".join(items[1][1].split()[:10]) + "\n" + text(1)), (42, text(5) + " " + items[1][1].upper()), (43, text(5) + " " + items[4][1])]
    docs += [(50, None), (51, ""), (52, "too few words"), (53, "\n".join([text(1)] * 9)), (54, "#$ " * 90), (55, text(900, 11)), (56, text(1, 6000))]
    docs += [(0, docs[0][1]), (55, docs[-2][1])]  # repeated rows
    docs += [(60, docs[3][1]), (61, docs[3][1] + " more")]
    wanted = by_hand(docs, items)
    assert 20 <= len(wanted) < len({d for d, _ in docs}) - 8 and {55, 56} <= set(wanted)
    got = corpus_pipeline.run(spark, written(spark, tmp_path, docs, items)).collect()

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies = {d: sum(x == d for x, _ in docs) for d in wanted}
    pieces = []
    for d, t in wanted.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = [p for p in got if p.doc_id == d]
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
        covered = np.bincount(np.concatenate([np.arange(p.start, p.start + p.length) for p in own]), minlength=len(ids))
        assert (covered == copies[d]).all()
        pieces += own
    assert len(pieces) == len(got)  # nothing else
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048


def test_run_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [])).count() == 0
    docs = [(1, " ".join(f"word{i} other{7 * i}" for i in range(60))), (2, None)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, written(spark, tmp_path / "no-items", docs, [])).collect()} == {1}
