import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import chat_format, packing, queries, token_files
from tidewell.llm.tokens import UnitTokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a\xa0 b", "x\x1c y.", "it's, don't.\n\n  \tFoo", " lead", "trail  ", "é́ ̈a", "<|endoftext|> x", "foo.<|endoftext|>bar", "<|ENDOFTEXT|>",
    "A.B,c!d ??? 12ab3.4", "中文 字。 ok", "ﬁ ǅ İstanbul ΣΑΣ. Σ", "  a\n b\r\nc\x0bd\x0ce", "x's.'s 's,t", "ÀÉ ß µ ÿ Þ × Ł", "ª º", "\0 a\0",
]
DOCS = [(i, t) for i, t in enumerate([None, *ODD, "word " * 9000, "x" * 5000])]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_units_equal_the_library(path):
    fast, plain = UnitTokenizer(path, 1, cache_units=50), Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab .,'\n\té<|>1\xa0") for _ in range(60)) for _ in range(200)]
    for t, got in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("start", F.lit(5))


def ids_of(path, docs):
    tok = Tokenizer.from_file(path)
    return {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs}


def test_packing_round_trip(spark):
    wanted = ids_of(BYTE, DOCS)
    rows = packing.pack(frame(spark, DOCS).repartition(5), BYTE, size=64, most_open=3, fan_in=2).collect()
    for d, ids in wanted.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * sum(map(len, wanted.values())) / 64 + 4
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_token_files_round_trip(spark):
    wanted, at = ids_of(WORD, DOCS), 0
    got = {r.doc_id: r for r in token_files.read_tokens(token_files.write_tokens(frame(spark, DOCS).repartition(3), WORD, chunk_ids=100)).collect()}
    for d in sorted(wanted):
        assert (got[d].start, got[d].n_tokens, zlib.crc32(got[d].ids)) == (at, len(wanted[d]), zlib.crc32(wanted[d].tobytes()))
        at += len(wanted[d])
    empty = token_files.write_tokens(frame(spark, []), WORD)
    assert empty.count() == 0 and token_files.read_tokens(empty).count() == 0
    odd = frame(spark, [(None, "b"), (3, "b"), (3, "a"), (3, "a")])
    assert [r.doc_id for r in token_files.read_tokens(token_files.write_tokens(odd, WORD)).orderBy("start").collect()] == [None, 3, 3, 3]


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_and_shards(planes):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, planes), n) == ids).all()
    docs = [(k, rng.integers(0, 50_000, int(rng.integers(0, 40)), dtype=np.uint32).astype("<u4").tobytes()) for k in range(50)]
    out = io.BytesIO()
    writer = token_files.ShardWriter(out, chunk_ids=64, planes=planes)
    for d, ids in docs:
        writer.add(d, ids)
    assert writer.close() == (50, sum(len(x) // 4 for _, x in docs))

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = token_files.ShardReader(Source(out.getvalue()))
    assert [(d, ids) for d, _, ids in reader.documents()] == docs
    assert sum(len(reader.chunk(k)) for k in range(reader.n_chunks)) == sum(len(x) // 4 for _, x in docs)


SAID = "<|im_end|><|im_start|>assistant ok"
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
    (4, 0, None, None), (5, 0, "user", SAID), (5, 1, "assistant", SAID), (6, 0, "odd\nrole%", "<\\|x <|y"), (7, 1, "assistant", "b"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"),
    (None, 0, "user", "hi"), (None, 1, "assistant", "yes"),
]


def test_chat_tree(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    segments, references = chat_format.format_conversations(df.repartition(4), BYTE)
    seg = {r.place: r for r in segments.collect()}
    assert len(seg) == 11  # each shared turn once
    at = 0
    for place in sorted(seg):  # the stream has no gaps
        assert place == at and len(seg[place].ids) == 4 * seg[place].length
        at += seg[place].length
    paths = {}
    for r in references.collect():
        paths.setdefault(r.conv_id, []).append((r.turn_index, r.place))
    assert len(paths) == 8
    for path in paths.values():
        position, seen = 0, set()
        for k, (_, place) in enumerate(sorted(path)):
            s = seg[place]
            assert (s.position, s.depth) == (position, k)
            assert {x for a in s.attends for x in range(a.begin, a.end)} == seen  # exactly the ancestors' tokens
            seen |= set(range(place, place + s.length))
            position += s.length
    back = {r.conv_id: r for r in chat_format.read_back(segments, references, BYTE).collect()}
    import hashlib

    for conv in {t[0] for t in TURNS}:
        turns = sorted(((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        got = back[conv]
        assert (got.n_turns, got.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_deep_tree_over_many_ranges(spark):
    rng = random.Random(2)
    turns = [(c, k, "user", rng.choice("xy")) for c in range(40) for k in range(rng.randint(1, 9))]
    turns += [(100 + c, k, "user", "x" if k < 700 + c else str(k)) for c in range(4) for k in range(1500)]  # long, parting late
    segments, references = chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), BYTE)
    seg, paths, said, nodes = {r.place: r for r in segments.collect()}, {}, {}, set()
    for r in sorted(references.collect(), key=lambda r: (r.conv_id, r.turn_index)):
        paths.setdefault(r.conv_id, []).append(r.place)
    for c, _, _, text in sorted(turns):
        said[c] = (*said.get(c, ()), text)
    for t in said.values():
        nodes |= {hash(t[: k + 1]) for k in range(len(t))}
    assert len(seg) == len(nodes) and {c: len(p) for c, p in paths.items()} == {c: len(t) for c, t in said.items()}
    at = 0
    for place in sorted(seg):
        assert place == at
        at += seg[place].length
    for path in paths.values():
        joined, position = [], 0
        for k, place in enumerate(path):
            s = seg[place]
            assert (s.position, s.depth) == (position, k) and [[a.begin, a.end] for a in s.attends] == joined
            position += s.length
            if joined and joined[-1][1] == place:
                joined[-1][1] += s.length
            else:
                joined.append([place, place + s.length])


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    segments, references = chat_format.format_conversations(none, BYTE)
    assert segments.count() == 0 and chat_format.read_back(segments, references, BYTE).count() == 0


def test_escapes_can_be_undone():
    rng = random.Random(0)
    for _ in range(2000):
        s = "".join(rng.choice("<\\|a\n%") for _ in range(12))
        assert "<|" not in chat_format.escape(s) and chat_format.unescape(chat_format.escape(s)) == s
        assert "\n" not in chat_format.escape_role(s) and chat_format.unescape_role(chat_format.escape_role(s)) == s


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
