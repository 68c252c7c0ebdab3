"""Removal of long byte strings that occur more than once, over run-compressed indexes.

Every byte goes that is covered by a string of ``length`` bytes that also starts anywhere
else in the corpus, in the same document or another.

Which strings can match: each string of ``length`` bytes has an anchor, its 32-byte gram of
smallest hash (the leftmost of equals). Two occurrences of a string have the same anchor, so
only strings under equal anchors need to be compared. Neighbouring starts that have one
anchor form a context: the bytes they cover.
* Contexts that are equal as a whole (128-bit digest) repeat each other: all their bytes go.
  This takes in copies and the inside of shared passages, by an aggregation.
* Different contexts under one anchor go to one task, many anchors at a time. Starts whose
  surroundings at the same distance from the anchor no other context has leave at once. The
  rest is a text of bounded size: a run-length index is built of it (suffix order, Burrows-Wheeler transform as
  runs, text positions sampled at run starts and run ends with their match lengths). Its
  match lengths are streamed in text order: away from the samples each is one less than that of
  the byte before. Starts with a match of at least ``length`` are marked.
* An anchor with more than ``most_contexts`` different contexts is split: its starts are cut
  into cells by their distance from the anchor, and the key of a cell takes in the bytes
  which all strings of that cell share. That repeats, with a quarter of the width, until groups are
  small; a cell of one start is its own string, so it ends in equal contexts.

Defined cases: null text is empty; texts shorter than ``length`` stay; rows with equal doc_id
and text are occurrences of each other; a null doc_id is an id like any other; no
documents give no rows; other columns are not looked at; texts are read whole, long ones
in pieces that overlap by a string less a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow, marked, places_for, settle, shuffled, two_columns

GRAM = 32
#: A key with more rows than this is broadcast to them.
HOT = 1000
_PLACE_BITS = np.uint64(24)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = [np.uint64(x) | np.uint64(1) for x in _rng.integers(0, 2**64, 5, dtype=np.uint64)]

CONTEXTS = "doc_id long, row long, anchor long, context binary, low long, high long, place long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes from each position."""
    h = _BYTE[data]
    for k, step in enumerate(_STEP):
        m = 1 << k
        h = h[:-m] * step + h[m:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: block-wise from the left and from the right."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor in a buffer of documents: (document, low, high, place, anchor hash), places in the buffer."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    h = gram_hashes(data)
    keyed = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    place = (_sliding_least(keyed, length - GRAM + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), ends - starts)[: len(place)]
    valid = np.arange(len(place)) + length <= ends[doc]
    at = np.nonzero(valid)[0]
    if not len(at):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    new = np.r_[True, (np.diff(place[at]) != 0) | (np.diff(doc[at]) != 0)]
    low = at[new]
    high = at[np.r_[np.nonzero(new)[0][1:] - 1, len(at) - 1]]
    return doc[low], low, high, place[low], h[place[low]]


@dataclass
class RunIndex:
    """Run-length Burrows-Wheeler index of a set of strings, each ended by a symbol of its own.

    run_symbol, run_start: the transform as runs. first_place, last_place: text positions at
    the start and the end of each run, with the lengths they have in common with the
    suffix before and after them.
    """

    n: int
    run_symbol: np.ndarray
    run_start: np.ndarray
    first_place: np.ndarray
    first_match: np.ndarray
    last_place: np.ndarray
    last_match: np.ndarray

    @classmethod
    def build(cls, strings: list[bytes]) -> RunIndex:
        raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        symbol = raw.astype(np.uint16) + np.uint16(1)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        symbol[ends] = 0
        n = len(symbol)
        padded = np.r_[symbol, np.zeros(8, np.uint16)].astype(np.uint64)
        pack, inside = padded[:n] << np.uint64(48), padded[:n] != 0
        for k, bits in ((1, 32), (2, 16), (3, 0)):  # what follows an end mark doesn't count: end marks are in text order
            following = padded[k : n + k] * inside
            pack |= following << np.uint64(bits)
            inside &= following != 0
        ended = np.zeros(n, bool)  # an end mark within the next four symbols: unlike any other
        for k in range(4):
            ended[ends[ends - k >= 0] - k] = True
        order = np.argsort(pack, kind="stable")
        new = np.r_[True, (pack[order][1:] != pack[order][:-1]) | ended[order][1:] | ended[order][:-1]]
        width = 4
        while not new.all():
            # rank: the first place in the order of all with equal symbols so far
            first = np.nonzero(new)[0]
            rank = np.empty(n, np.int64)
            rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
            group = np.repeat(first, np.diff(np.r_[first, n]))
            tied = np.nonzero(~(new & np.r_[new[1:], True]))[0]
            suffix = order[tied]
            second = rank[np.minimum(suffix + width, n - 1)]
            by = np.lexsort((second, group[tied]))
            order[tied] = suffix[by]
            key, second = group[tied], second[by]
            new[tied] = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
            width *= 2
        transform = symbol[order - 1]  # before the first symbol stands the last end mark
        start = np.r_[True, transform[1:] != transform[:-1]]
        start[1:] |= (transform[1:] == 0) & (transform[:-1] == 0)  # end marks differ from each other
        run_start = np.nonzero(start)[0]
        run_end = np.r_[run_start[1:] - 1, n - 1]

        def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out, live, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
            while len(live):  # four symbols at a time, then one by one
                same = (pack[a[live] + at] == pack[b[live] + at]) & ~ended[a[live] + at] & ~ended[b[live] + at]
                out[live[same]] += 4
                live, at = live[same], at + 4
            for _ in range(3):
                x, y = symbol[a + out], symbol[b + out]
                out += (x == y) & (x != 0)
            return out

        first_match, last_match = np.zeros(len(run_start), np.int64), np.zeros(len(run_start), np.int64)
        first_match[1:] = common(order[run_start[1:]], order[run_start[1:] - 1])
        last_match[:-1] = first_match[1:]
        return cls(n, transform[run_start], run_start, order[run_start], first_match, order[run_end], last_match)

    def match_lengths(self) -> np.ndarray:
        """For each text position the longest string from there that also starts elsewhere, from the samples alone."""
        out = np.zeros(self.n, np.int64)
        for place, match in ((self.first_place, self.first_match), (self.last_place, self.last_match)):
            by = np.argsort(place)
            place, match = place[by], match[by]
            last = np.searchsorted(place, np.arange(self.n), side="right") - 1
            known = last >= 0
            out[known] = np.maximum(out[known], match[last[known]] - (np.nonzero(known)[0] - place[last[known]]))
        return out


def _marked(strings: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(string, first start, last start) of the runs of starts in ``strings`` that have a match of at least ``length``."""
    hit = RunIndex.build(strings).match_lengths() >= length
    edges = np.nonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))[0].reshape(-1, 2)
    begins = np.cumsum([0, *(len(s) + 1 for s in strings)])
    for a, b in edges.tolist():
        k = int(np.searchsorted(begins, a, side="right")) - 1
        yield k, a - int(begins[k]), b - 1 - int(begins[k])


def _digest(*parts) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _first_contexts(own: DataFrame, length: int, piece: int = 1 << 20) -> DataFrame:
    names = [c.split()[0] for c in CONTEXTS.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """(doc_id, row, offset of the piece, bytes), as many at a time as make a buffer."""
        held, size = [], 0
        for batch in batches:
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                for at in range(0, max(1, len(data) - length + 1), piece):
                    part = data[at : at + piece + length - 1]
                    held.append((doc_id, row, at, part))
                    size += len(part)
                    if size >= piece:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in pieces(batches):
            whole = b"".join(p[3] for p in held)
            sizes = np.array([len(p[3]) for p in held], np.int64)
            ends = np.cumsum(sizes)
            doc, low, high, place, anchor = anchored_runs(np.frombuffer(whole, np.uint8), ends, ends - sizes, length)
            if not len(doc):
                continue
            view = memoryview(whole)
            context = [_digest(view[a : b + length]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            shift = np.array([p[2] for p in held], np.int64)[doc] - (ends - sizes)[doc]
            ids = pa.array([p[0] for p in held], pa.int64()).take(pa.array(doc))
            rows = pa.array([p[1] for p in held], pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, rows, pa.array(anchor.view(np.int64)), pa.array(context, pa.binary()), pa.array(low + shift), pa.array(high + shift), pa.array(place + shift)], names=names)

    return own.select("doc_id", "row", "text").transform(in_arrow, run, CONTEXTS)


def _likely(df: DataFrame, by: Column, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``by`` is among ``keys``, and few others; nothing is shuffled."""
    return marked(df, by, keys, key, places=places_for(keys.count())).where("__maybe").drop("__maybe")


def _keyed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return _likely(df, F.xxhash64(*on), keys.select(F.xxhash64(*on).alias("__key")), "__key")


def _among(df: DataFrame, keys: DataFrame, on: list[str], n: str, few: bool) -> DataFrame:
    """The rows of ``df`` whose ``on`` is among ``keys``, with the columns of both; ``n`` counts a key's rows in ``df``.

    Keys of over ``HOT`` rows meet them where they are, so no task gets all rows of one; there are
    at most ``1 / HOT`` as many as rows. For the others only rows that may be among them are shuffled.
    """
    if few:
        return df.join(F.broadcast(keys), on)
    hot, rest = F.broadcast(keys.where(F.col(n) > HOT)), keys.where(F.col(n) <= HOT)
    return df.join(hot, on).unionByName(_keyed(df.join(hot.select(*on), on, "left_anti"), rest, on).join(shuffled(rest), on))


def _texts(contexts: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, row, text) of the documents that have any of the contexts, once each, and few others."""
    by = F.xxhash64(F.col("doc_id").cast("long"), "row")
    wanted = settle(contexts.select(by.alias("__key")).distinct(), "wanted")
    return settle(_likely(own, by, wanted, "__key").select("doc_id", "row", "text").dropDuplicates(["doc_id", "row"]), "texts")


def _with_text(contexts: DataFrame, texts: DataFrame) -> DataFrame:
    """One row a document that has any: its contexts as an array, and its text."""
    per = contexts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "context", "low", "high", "place")).alias("c"))
    return per.alias("p").join(texts.alias("t"), F.expr("p.doc_id <=> t.doc_id and p.row = t.row")).select("p.doc_id", "p.row", "c", F.col("text").cast("binary").alias("data"))


def _split(contexts: DataFrame, texts: DataFrame, length: int, width: int) -> DataFrame:
    """The contexts cut into cells of ``width`` starts by distance from the anchor, under keys that take in what a cell's strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        for batch in batches:
            for doc_id, row, anchor, low, high, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []  # data: the bytes from low on
                for cell in range((low - place) // width, (high - place) // width + 1):
                    a, b = max(low, place + cell * width), min(high, place + cell * width + width - 1)
                    # what all strings of the whole cell share; where a cell reaches past 0 no string starts there
                    core = data[max(0, place + min(cell * width + width - 1, 0) - low) : place + cell * width + length - low]
                    key = _digest(anchor.to_bytes(8, "little", signed=True), cell.to_bytes(4, "little", signed=True), core)
                    out.append((doc_id, row, int.from_bytes(key[:8], "little", signed=True), _digest(data[a - low : b + length - low]), a, b, place))
                yield _table(out, kinds, names)

    each = _with_text(contexts, texts).select("doc_id", "row", "data", F.explode("c").alias("c"))
    cut = each.select("doc_id", "row", "c.anchor", "c.low", "c.high", "c.place", F.expr(f"substring(data, cast(c.low as int) + 1, cast(c.high - c.low as int) + {length})").alias("data"))
    return cut.transform(in_arrow, run, CONTEXTS)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, most_contexts: int = 1000, index_bytes: int = 1 << 19, most_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, row, begin, end): bytes to remove, not merged; ``row`` is the hash of the text. Keys are broadcast whole in rounds of at most ``most_broadcast`` contexts."""
    own = two_columns(docs, key, text).withColumn("row", F.xxhash64("text"))
    contexts, texts, width, marks = settle(_first_contexts(own, length), "contexts"), None, length, []
    while True:
        few = contexts.count() <= most_broadcast
        # Most anchors occur once: they leave first, by their key alone. The few that stay have one context of one member, which the counts below leave out.
        again = settle(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
        repeated = settle(_keyed(contexts, again, ["anchor"]), "repeated")
        # Equal contexts are one class with a count and its first member; nothing below deals all members by their class.
        classes = settle(repeated.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "low", "high", "place")).alias("who")), "classes")
        equal = settle(classes.where("n > 1").select("anchor", "context", "n"), "equal")
        spans = _among(repeated, equal, ["anchor", "context"], "n", few).select("doc_id", "row", F.col("low").alias("begin"), (F.col("high") + length).alias("end"))
        marks.append(settle(spans, "marks"))
        kinds = settle(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
        mixed = settle(_among(classes, kinds, ["anchor"], "kinds", few).select("anchor", "context", "kinds", "who.*"), "mixed")
        texts = _texts(mixed, own if texts is None else texts)
        marks.append(settle(_indexed(mixed.where(F.col("kinds") <= most_contexts).drop("kinds"), texts, length, index_bytes), "marks"))
        large = settle(mixed.where(F.col("kinds") > most_contexts).drop("kinds"), "large")
        if width == 1 or large.isEmpty():
            break
        width = -(-width // 4)
        texts = _texts(large, texts)
        contexts = settle(_split(large, texts, length, width), "contexts")
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def _possible(group: list[tuple], length: int, cells: int = 8) -> Iterator[tuple]:
    """Of the contexts of one anchor, (doc_id, row, low, place, data), the starts that can have a match, with their bytes.

    Two equal strings have the anchor at one distance. Distances are cut into cells; all strings of a
    context in a cell share a core of at least seven eighths of them. Where no other
    context has that core in that cell, none of its strings there can match.
    """
    width = -(-(length - GRAM + 1) // cells)
    seen: dict[int, int] = {}
    keys = []
    for _, _, low, place, data in group:
        far, near = place - low, place - low - (len(data) - length)
        own = [(q, hash((q, data[far - q * width : far - (q + 1) * width + 1 + length]))) for q in range(near // width, far // width + 1)]
        for _, k in own:
            seen[k] = seen.get(k, 0) + 1
        keys.append(own)
    for (doc_id, row, low, place, data), own in zip(group, keys, strict=True):
        met = [q for q, k in own if seen[k] > 1]
        if met:
            far = place - low
            a, b = max(0, far - (met[-1] + 1) * width + 1), min(len(data) - length, far - met[0] * width)
            yield doc_id, row, low + a, data[a : b + length]


def _indexed(mixed: DataFrame, texts: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """Marks of strings under one anchor in different contexts, by run-length indexes of about ``index_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "row", "begin", "end"], [pa.int64()] * 4

        def groups() -> Iterator[list[tuple]]:
            group, last = [], None
            for batch in batches:
                for anchor, *context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if anchor != last:
                        if len(group) > 1:
                            yield group
                        group, last = [], anchor
                    group.append(context)
            if len(group) > 1:
                yield group

        def marks(held: list[tuple]) -> pa.RecordBatch:
            rows = []
            for k, a, b in _marked([h[3] for h in held], length):
                doc_id, row, low, _ = held[k]
                rows.append((doc_id, row, low + a, low + b + length))
            return _table(rows, kinds, names)

        held, size = [], 0
        for group in groups():
            for found in _possible(group, length):
                held.append(found)
                size += len(found[3])
            if size >= index_bytes:
                yield marks(held)
                held, size = [], 0
        if held:
            yield marks(held)

    each = _with_text(mixed, texts).select("doc_id", "row", "data", F.explode("c").alias("c"))
    cut = each.select("c.anchor", "doc_id", "row", "c.low", "c.place", F.expr(f"substring(data, cast(c.low as int) + 1, cast(c.high - c.low as int) + {length})").alias("data"))
    return cut.repartition("anchor").sortWithinPartitions("anchor").transform(in_arrow, run, "doc_id long, row long, begin long, end long")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, merged, as begin and end), kept (the remaining bytes)."""
    own = two_columns(docs, key, text).withColumn("row", F.xxhash64("text"))
    found = repeated_spans(docs, key, text, length, **options)
    spans = settle(found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("s")), "spans")
    # texts without a repeat stay where they are
    sifted = marked(own, F.col("row"), spans, "row", places=places_for(spans.count()))
    rest = sifted.where("not __maybe").select("doc_id", F.col("text").cast("binary").alias("data"), F.lit(None).cast(spans.schema["s"].dataType).alias("s"))
    joined = sifted.where("__maybe").alias("t").join(shuffled(spans).alias("s"), F.expr("t.doc_id <=> s.doc_id and t.row = s.row"), "left").select("t.doc_id", F.col("text").cast("binary").alias("data"), "s.s").unionByName(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                merged: list[dict] = []
                for s in found or ():
                    if merged and s["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                at, kept = 0, []
                for s in merged:
                    kept.append(data[at : s["begin"]])
                    at = s["end"]
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((doc_id, len(data), len(data) - len(left), merged, left))
            yield _table(rows, kinds, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.transform(in_arrow, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary")
