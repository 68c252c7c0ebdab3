"""MinHash near-duplicate detection with odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes. ``samples`` MinHash
samples of it are taken; ``rows`` of the first ones at a time make a band key, and documents that share
a key are candidates. All samples are also folded into an odd sketch: each sample flips one
bit of a bitmap. The bits set in the XOR of two sketches estimate how many samples differ,
and that most precisely for high similarities; candidates whose estimate lies several
standard errors below the limit are let go, the others are confirmed on the full sets.

No pairs are listed inside a group of copies:
1. documents with equal sets (a digest of the sorted set) are one class from the start;
2. buckets of the first bands are dealt into cells of a bounded number of classes, the
   bucket's first class in each; a task takes the pairs of a cell from the highest estimate
   down and gives out those that join what wasn't joined yet: a forest, so fewer pairs than
   classes. Confirmed links make components, which take in nearly all of a large group;
3. of all bands, buckets that still hold several components are dealt into cells by component. Two cells of
   one component are never compared. A task gives out those of its rows whose estimate with a row of another component is high enough;
4. only these rows are dealt once more, now with their full sets: the task confirms the pairs itself, each in the
   first bucket that its classes share, and gives out a forest of links. No pair leaves a task unconfirmed.
So a pair of classes that share a band key is either confirmed, refused, or connected.

Chance: with 32 bands of 4 rows two sets of similarity 0.8 share no band key with
probability (1 - 0.8^4)^32 = 5e-8; the sketch refuses a true link by a fluctuation of
over four standard errors (0.12 where one is under 0.03).

Defined cases: null or empty text has an empty set and no links; a text of fewer words than
a shingle is one shingle of all its words; repeated rows are documents of the same class; rows
of one id with different texts are documents of their own; a
null doc_id comes back with its own set as component null; no documents give no rows; other
columns are not looked at; texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WS, in_arrow, marked, settle, shuffled, two_columns
from tidewell.llm.graph import components


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), np.frombuffer(WS.encode(), np.uint8))
_BREAK = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: A random 64-bit code of each byte, and the odd base whose powers tell the places in a word apart.
_CODE = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 22
#: Shingles of a set that count as one row of a cell, so that long texts make cells of fewer rows.
_ROW = 2048


def _hashes_of_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of one piece, by array arithmetic on its bytes."""
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    length = edge[1::2] - edge[::2]
    if not len(length):
        return np.empty(0, np.uint64)
    first = np.cumsum(length) - length
    power = np.full(int(length.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    return _mix(np.add.reduceat(_CODE[b[inside]] * power[place], first) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _word_hashes(data: bytes) -> np.ndarray:
    """The same of a whole text, cut at white space into pieces, so that a very long one needs little memory besides."""
    if len(data) <= _PIECE:
        return _hashes_of_words(data)
    out, at = [], 0
    while at < len(data):
        end = m.end() if (m := _BREAK.search(data, at + _PIECE)) else len(data)
        out.append(_hashes_of_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    h = _word_hashes(text.encode().lower())  # of bytes, lower() folds A-Z alone
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


class Sketcher:
    """MinHash samples, band keys and odd sketch of a set."""

    def __init__(self, bands: int, rows: int, bits: int, samples: int = 0, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, self.n = bands, rows, bits, max(samples, bands * rows)
        self.a = (rng.integers(0, 2**32, self.n, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, self.n, dtype=np.uint32)[:, None]
        self.number = np.arange(self.n, dtype=np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        low, out = (s ^ (s >> np.uint64(32))).astype(np.uint32), None
        for at in range(0, len(low), 1024):
            x = low[None, at : at + 1024] * self.a
            x += self.b
            got = x.min(axis=1)
            out = got if out is None else np.minimum(out, got)
        return out

    def sketch(self, s: np.ndarray) -> tuple[list[int], bytes]:
        m = self.samples(s).astype(np.uint64)
        marked = _mix(m + (self.number << np.uint64(32)))
        bit = (marked % np.uint64(self.bits)).astype(np.int64)
        odd = np.packbits((np.bincount(bit, minlength=self.bits) & 1).astype(np.uint8)).tobytes()
        key = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + m[: self.bands * self.rows].reshape(self.bands, self.rows)[:, r])
        return key.view(np.int64).tolist(), odd

    def similarity(self, differing_bits: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity from the bits set in an XOR of two sketches."""
        share = np.minimum(2 * differing_bits / self.bits, 1 - 1e-9)
        differing_samples = -self.bits / 4 * np.log1p(-share)  # each differing sample flips one bit in either sketch
        return 1 - differing_samples / self.n


def _xor_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _rows_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _sets(own: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, s): the full sets of the wanted classes (rep, doc_id, row), as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for rep, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.append((rep, shingle_set(t.as_py(), shingle).tobytes()))
                size += len(out[-1][1])
                if size > 1 << 22:
                    yield _table(out, [pa.int64(), pa.binary()], ["rep", "s"])
                    out, size = [], 0
            if out:
                yield _table(out, [pa.int64(), pa.binary()], ["rep", "s"])

    likely = marked(own, F.col("row"), wanted, "row").where("__maybe").drop("__maybe")  # other texts aren't shuffled
    texts = likely.join(shuffled(wanted), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("rep", "text")
    return settle(texts.transform(in_arrow, run, "rep long, s binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield _table(out, [pa.int64(), pa.int64()], ["a", "b"])

    joined = pairs.join(shuffled(sets.select(F.col("rep").alias("b"), F.col("s").alias("y"))), "b").join(shuffled(sets.select(F.col("rep").alias("a"), F.col("s").alias("x"))), "a")
    return settle(joined.select("a", "b", "x", "y").transform(in_arrow, check, "a long, b long"), "links")


def _dealt(work: DataFrame, more: list[str], compare: Callable[[list[tuple]], list[tuple]], names: list[str]) -> DataFrame:
    """``compare`` on the rows (task, side, within, b, label, bucket, odd, size, *more) of each task; it gives rows of integers ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, task, held = [pa.int64()] * len(names), None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != task:
                    if len(held) > 1:
                        out += compare(held)
                    task, held = row[0], []
                held.append(row)
            yield _table(out, kinds, names)
        if len(held) > 1:
            yield _table(compare(held), kinds, names)

    rows = work.select("task", "side", "within", "b", "label", "bucket", "odd", "size", *more)
    return rows.repartition("task").sortWithinPartitions("task", "b").transform(in_arrow, run, ", ".join(f"{n} long" for n in names)).distinct()


def _likely(rows: list[tuple], make: Sketcher, least: float, percent: int, label: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, others, estimates): the rows of another label that a row of the task may be linked with, by sketches and sizes.

    ``within``: all rows meet; otherwise rows of one side meet those of the other. ``label`` may change meanwhile.
    """
    sketches, size, side = _rows_of([r[6] for r in rows]), np.array([r[7] for r in rows]), np.array([r[1] for r in rows])
    within = rows[0][2]
    for i in range(len(rows)):
        if within:
            other = np.nonzero(label[i + 1 :] != label[i])[0] + i + 1
        elif side[i]:
            other = np.nonzero(~side & (label != label[i]))[0]
        else:
            continue
        if len(other):
            near = make.similarity(_xor_bits(sketches[other], sketches[i]))
            # sets whose sizes differ that much can't be similar enough
            keep = (near >= least) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))
            if keep.any():
                yield i, other[keep], near[keep]


def _forest(work: DataFrame, make: Sketcher, least: float, percent: int) -> DataFrame:
    """Likely pairs (a, b) inside each task that join labels which no pair of a higher estimate has joined."""

    def compare(rows: list[tuple]) -> list[tuple]:
        node, label = [r[3] for r in rows], np.array([r[4] for r in rows])
        found = [(near, np.full(len(other), i), other) for i, other, near in _likely(rows, make, least, percent, label)]
        if not found:
            return []
        near, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        root, out = {x: x for x in label.tolist()}, []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left = len(root) - 1
        for k in np.argsort(-near, kind="stable").tolist():
            x, y = top(int(label[i[k]])), top(int(label[j[k]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(p := node[i[k]], q := node[j[k]]), max(p, q)))
                left -= 1
                if not left:
                    break
        return out

    return _dealt(work, [], compare, ["a", "b"])


def _with_partner(work: DataFrame, make: Sketcher, least: float, percent: int) -> DataFrame:
    """(bucket, b, size) of the rows that have a likely pair in their task."""

    def compare(rows: list[tuple]) -> list[tuple]:
        met = np.zeros(len(rows), bool)
        for i, other, _ in _likely(rows, make, least, percent, np.array([r[4] for r in rows])):
            met[i] = True
            met[other] = True
        return [(rows[k][5], rows[k][3], rows[k][7]) for k in np.nonzero(met)[0].tolist()]

    return _dealt(work, [], compare, ["bucket", "b", "size"])


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of each sorted array in ``others`` are in the sorted array ``one``."""
    if not len(one):
        return np.zeros(len(others), np.int64)
    every = np.concatenate(others)
    hit = np.r_[0, np.cumsum(one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every)]
    ends = np.cumsum([len(x) for x in others])
    return hit[ends] - hit[np.r_[0, ends[:-1]]]


def _linked(work: DataFrame, make: Sketcher, least: float, percent: int, block: int = 64) -> DataFrame:
    """Links (a, b) inside each task's rows (..., s, earlier), confirmed on the full sets ``s``; a forest over the labels.

    ``earlier``: the sorted lesser buckets that a class is in besides; a pair that shares one is confirmed there.
    """

    def compare(rows: list[tuple]) -> list[tuple]:
        node, label, out = [r[3] for r in rows], np.array([r[4] for r in rows]), []
        sets, earlier = [np.frombuffer(r[8], np.uint64) for r in rows], [np.array(r[9], np.int64) for r in rows]
        for i, likely, _ in _likely(rows, make, least, percent, label):
            for at in range(0, len(likely), block):
                other = likely[at : at + block]
                other = other[label[other] != label[i]]  # not joined meanwhile
                if len(other):
                    other = other[_common(earlier[i], [earlier[k] for k in other]) == 0]
                if not len(other):
                    continue
                both = _common(sets[i], [sets[k] for k in other])
                union = np.array([len(sets[k]) for k in other]) + len(sets[i]) - both
                for k in other[100 * both >= percent * union].tolist():
                    if label[k] != label[i]:
                        out.append((min(node[i], node[k]), max(node[i], node[k])))
                        label[label == label[k]] = label[i]
        return out

    return settle(_dealt(work, ["s", "earlier"], compare, ["a", "b"]), "links")


def _mixed_cells(labelled: DataFrame, cell: int, weight: str = "1") -> DataFrame:
    """(task, side, within, b, label, bucket) for buckets of several labels, dealt into cells of about ``cell`` rows, each counted by its ``weight``.

    A small label goes whole to a cell by hash, a large one over cells of its own; two cells of one label don't meet.
    """
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("bucket")
    inside = labelled.join(shuffled(mixed), "bucket")
    sizes = inside.groupBy("bucket", "label").agg(F.expr(f"cast(ceil(sum({weight})) as long)").alias("m"))
    # as many cells as the small labels' rows need: each of them meets every cell of a large label
    cells = sizes.groupBy("bucket").agg(F.expr(f"cast(greatest(1, ceil(coalesce(sum(m) filter (where m <= {cell}), 0) / {cell})) as int)").alias("cells"))
    placed = inside.join(shuffled(sizes), ["bucket", "label"]).join(shuffled(cells), "bucket").withColumn(
        "cell", F.expr(f"case when m > {cell} then concat(label, ':', pmod(xxhash64(b), cast(ceil(m / {cell}) as int))) else concat('s:', pmod(xxhash64(label), cells)) end")
    ).withColumn("alone", F.expr(f"m > {cell}"))
    corners = placed.select("bucket", "cell", "alone", F.expr("if(alone, label, -1)").alias("whose")).distinct()
    meet = corners.alias("x").join(shuffled(corners).alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cell") <= F.col("y.cell"))).where(
        "x.cell < y.cell and not (x.alone and y.alone and x.whose = y.whose) or x.cell = y.cell and not x.alone"
    ).select(F.xxhash64("x.bucket", "x.cell", "y.cell").alias("task"), F.col("x.bucket").alias("bucket"), F.expr("explode(array_distinct(array(x.cell, y.cell)))").alias("cell"), F.expr("x.cell = y.cell").alias("within"), F.col("x.cell").alias("first_cell"))
    return placed.join(shuffled(meet), ["bucket", "cell"]).select("task", F.expr("cell = first_cell").alias("side"), "within", "b", "label", "bucket")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80, bands: int = 32, rows: int = 4, samples: int = 256, bits: int = 1024, slack: float = 0.12, first_bands: int = 8, cell: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, its own included), row (hash of the text), kept."""
    own = two_columns(docs, key, text).withColumn("row", F.xxhash64("text"))
    make = Sketcher(bands, rows, bits, samples)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()], ["doc_id", "row", "n_shingles", "digest", "keys", "odd"]
        for batch in batches:
            keys, hashes, strings = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            out = []
            for doc_id, row, t in zip(keys, hashes, strings, strict=True):
                s = shingle_set(t.as_py(), shingle)
                out.append((doc_id, row, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), *make.sketch(s)) if len(s) else (doc_id, row, 0, None, None, None))
            yield _table(out, kinds, names)

    sketched = settle(own.transform(in_arrow, sketch, "doc_id long, row long, n_shingles long, digest binary, keys array<long>, odd binary"), "sketches")
    # One row a class of equal sets, named by a number that the written table fixes; the rows of one id may be in different classes.
    one = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row")).alias("who"), F.first("keys").alias("keys"), F.first("odd").alias("odd"), F.first("n_shingles").alias("size")
    )
    reps = settle(one.withColumn("rep", F.monotonically_increasing_id()), "classes")
    members = reps.select("rep", F.posexplode("keys").alias("band", "k")).select("rep", "band", F.xxhash64("band", "k").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("a")).where("n > 1")
    shared = settle(members.join(shuffled(buckets), "bucket").select("bucket", "band", "a", "n", F.col("rep").alias("b")), "buckets")
    odd_of = shuffled(reps.select(F.col("rep").alias("b"), "odd", "size"))
    wanted = settle(shared.select(F.col("b").alias("rep")).distinct().join(shuffled(reps.select("rep", "who.*")), "rep"), "wanted")
    sets = _sets(own, wanted, shingle)
    least = percent / 100 - slack

    # Buckets of the first bands, in cells by hash, the bucket's first class in each.
    begin = shared.where(F.col("band") < first_bands).withColumn("cells", F.expr(f"cast(ceil(n / {cell}) as int)"))
    dealt = begin.where("b != a").select("bucket", "b", F.expr("pmod(xxhash64(b), cells)").alias("g")).unionByName(begin.where("b = a").select("bucket", "b", F.expr("explode(sequence(0, cells - 1))").alias("g")))
    work = dealt.select(F.xxhash64("bucket", "g").alias("task"), F.lit(True).alias("side"), F.lit(True).alias("within"), "b", F.col("b").alias("label"), "bucket")
    likely = settle(_forest(work.join(odd_of, "b"), make, least, percent), "likely")
    known = settle(components(_confirmed(likely, sets, percent), "a", "b"), "components")
    labels = shuffled(known.withColumnsRenamed({"node": "b", "component": "label"}))

    # Buckets that hold several components: first the rows that have a likely partner, then the links among these.
    # A pair alone in a bucket of the first bands has been confirmed or refused.
    labelled = shared.where((F.col("band") >= first_bands) | (F.col("n") > 2)).select("bucket", "b").join(labels, "b", "left").withColumn("label", F.coalesce("label", "b"))
    met = settle(_with_partner(_mixed_cells(labelled, cell).join(odd_of, "b"), make, least, percent), "met")
    whole = sets.withColumnRenamed("rep", "b").join(odd_of, "b").join(shuffled(met.groupBy("b").agg(F.sort_array(F.collect_list("bucket")).alias("all"))), "b")
    labelled = met.join(labels, "b", "left").withColumn("label", F.coalesce("label", "b"))
    work = _mixed_cells(labelled, cell, f"greatest(1, size / {_ROW})").join(shuffled(whole), "b").withColumn("earlier", F.expr("filter(all, k -> k < bucket)"))
    links = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_linked(work, make, least, percent))
    final = components(links, "a", "b")

    placed = settle(reps.select("digest", "rep", "least").join(shuffled(final.withColumnsRenamed({"node": "rep", "component": "to"})), "rep", "left").select("digest", "least", F.coalesce("to", "rep").alias("to")), "placed")
    linked = placed.select("digest", "to").join(shuffled(placed.groupBy("to").agg(F.min("least").alias("component_id"))), "to").select("digest", "component_id")
    out = sketched.select("doc_id", "row", "n_shingles", "digest").join(shuffled(linked), "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns."""
    drop = settle(near_duplicates(docs, key, text, shingle, percent).where("not kept").select(F.col("doc_id").alias("__drop"), F.col("row").alias("__row")).distinct(), "drop")
    # texts that nothing can drop stay where they are
    sifted = marked(docs, F.xxhash64(F.coalesce(docs[text], F.lit(""))), drop, "__row")
    kept = sifted.where("not __maybe").drop("__maybe")
    rest = sifted.where("__maybe").drop("__maybe")
    return kept.unionByName(rest.join(shuffled(drop), (rest[key] == drop["__drop"]) & (F.xxhash64(F.coalesce(rest[text], F.lit(""))) == drop["__row"]), "left_anti"))
