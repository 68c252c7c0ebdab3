"""Quality and toxicity classifiers from weak labels.

Heuristic labellers vote on every text, for or against a class, or abstain; they overlap and
err. Expectation maximisation over the counts of all documents' vote patterns estimates
what each labeller says in either class, and with that the posterior of each pattern.
Posteriors are soft labels of a linear scorer over hashed features of the text; labelled
documents have their label instead. The scorer then judges every document, also where no
labeller spoke.

A batch is read by Arrow: it splits the texts and numbers the different words, so that
Python sees each word once a batch and counts are array arithmetic.

Bounds, all parameters: the scorer is trained on at most about ``labelled_docs`` labelled and
``train_docs`` other documents, chosen by a hash of the id, and has at most ``most_features``
weights a class, which are chosen by counts of all features of these documents. Vote patterns
are at most 3 to the number of labellers. All other passes cover every document and text.

Defined cases: null or empty text has no features and no votes, and is kept (score of the bias
alone, at most 0.5); repeated rows are scored alike; null ids are scored like others; of
several labels of an id the one that says more (toxic, poor) counts; with no documents or no
labels the labellers alone teach the scorer; other columns are not looked at; texts are
read whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow, settle, two_columns
from tidewell.llm.tokens import by_bytes

#: Common English insults, and English function words that hardly occur in other languages.
INSULTS = frozenset("idiot moron stupid loser pathetic worthless scum trash disgusting clown imbecile jerk creep dumb filthy vermin".split())
ENGLISH = frozenset("the and of that with this are was which from have".split())
CLASSES = ("poor", "toxic")
_MARKS = ".,;:!?\"'()[]"
_SYMBOLS = "#*$%&|<>"
_KINDS = ("poor: marks", "poor: marked words", "poor: repetition", "poor: few different words", "poor: exclamations", "poor: capitals", "toxic: insult", "toxic: several insults", "toxic: share of insults")
_POOR = 6


_CODE = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _bytes_of(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins and the last one ends."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


def _sums_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)][ends])


def _hashes(strings: pa.StringArray, kind: int) -> np.ndarray:
    """32-bit hashes, over 0; 0 for empty strings."""
    if not len(strings):
        return np.zeros(0, np.int64)
    data, ends = _bytes_of(strings)
    size = np.diff(ends)
    power = np.full(int(size.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    h = _sums_of(_CODE[data] * power[np.arange(len(data)) - np.repeat(ends[:-1], size)], ends) + np.uint64(kind)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(size > 0, (h >> np.uint64(32)).astype(np.int64) | 1, 0)


class Texts:
    """A batch of texts as numbered words: ``index`` (a word's number), ``doc`` (its text), ``words``, ``n`` (words of each text)."""

    def __init__(self, texts: list[str]):
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        numbered = lists.flatten().dictionary_encode()
        self.index, self.words = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary
        self.n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.length = pc.utf8_length(self.words).to_numpy(zero_copy_only=False)
        self.plain = pc.utf8_lower(pc.utf8_trim(self.words, _MARKS))
        if (self.length == 0).any():  # outer white space
            keep = self.length[self.index] > 0
            self.index, self.doc = self.index[keep], self.doc[keep]
            self.n = np.bincount(self.doc, minlength=len(texts))

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """For each text the sum of a figure of its words."""
        return np.bincount(self.doc, of_word[self.index], len(self.n))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) once each."""
        both = np.unique(self.doc * max(1, len(self.words)) + self.index)
        return both // max(1, len(self.words)), both % max(1, len(self.words))

    def repeated(self) -> np.ndarray:
        """For each text the share of its 3-word windows that it has more than once."""
        if len(self.index) < 3:
            return np.zeros(len(self.n))
        i = self.index.astype(np.uint64)
        inside = self.doc[2:] == self.doc[:-2]
        key = ((i[:-2] * np.uint64(0x9E3779B97F4A7C15) + i[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + i[2:]) * np.uint64(0x94D049BB133111EB) + self.doc[2:].astype(np.uint64)
        _, inverse, count = np.unique(key[inside], return_inverse=True, return_counts=True)
        again = np.bincount(self.doc[2:][inside], count[inverse] > 1, len(self.n))
        return again / np.maximum(1, self.n - 2)

    def figures(self) -> dict[str, np.ndarray]:
        """Shares by text: symbols, words with symbols, exclamation marks, capital words; insults and English words."""
        data, ends = _bytes_of(self.words) if len(self.words) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        marks = _sums_of(np.isin(data, np.frombuffer(_SYMBOLS.encode(), np.uint8)).astype(np.int64), ends)
        letters, upper = (f(self.words).to_numpy(zero_copy_only=False) for f in (pc.utf8_is_alpha, pc.utf8_is_upper))
        of = [marks, marks > 0, _sums_of((data == ord("!")).astype(np.int64), ends), upper & (self.length > np.where(letters, 1, 2))]
        of += [pc.is_in(self.plain, pa.array(sorted(x), pa.string())).to_numpy(zero_copy_only=False) for x in (INSULTS, ENGLISH)]
        n = np.maximum(1, self.n)
        names = ("symbols", "marked", "exclamations", "capitals", "insults", "english")
        found = {name: self.sums(x) / n for name, x in zip(names, of, strict=True)}
        doc, word = self.pairs()
        found["different"] = np.bincount(doc, minlength=len(n)) / n
        found["insult_words"] = np.bincount(doc, of[4][word], len(n))
        found["repeated"] = self.repeated()
        return found

    def votes(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """(texts, labellers): 1 for the class, -1 against it, 0 abstains. A text without words has no votes."""
        def by_limits(x, yes, no):
            return (x > yes).astype(np.int8) - (x < no)

        english = f["english"] > 0.05
        some = np.where(f["insult_words"] > 0, 1, np.where(english, -1, 0))
        votes = np.stack([
            by_limits(f["symbols"], 0.3, 0.02), by_limits(f["marked"], 0.25, 0.05), by_limits(f["repeated"], 0.5, 0.1),
            np.where(self.n >= 50, (f["different"] < 0.25).astype(np.int8) - (f["different"] > 0.5), 0),
            by_limits(f["exclamations"], 0.3, 0.02), np.where(self.n >= 10, (f["capitals"] >= 0.5).astype(np.int8) - (f["capitals"] < 0.1), 0),
            some, np.where(f["insult_words"] > 2, 1, np.where(english & (self.n >= 100) & (f["insult_words"] == 0), -1, 0)), np.where(f["insults"] > 0.01, 1, np.where(english & (f["insults"] == 0), -1, 0)),
        ], axis=1).astype(np.int8)
        return votes * (self.n > 0)[:, None]

    def hashed(self) -> np.ndarray:
        """(words, 3): hashes of a word and, where it is longer, of its first five and four letters; 0 where it has none."""
        length = pc.utf8_length(self.plain).to_numpy(zero_copy_only=False)
        return np.stack([_hashes(self.plain, 1), *[np.where(length > n, _hashes(pc.utf8_slice_codeunits(self.plain, 0, n), n), 0) for n in (5, 4)]], axis=1)

    def of_text(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """(texts, figures): hashes of each figure's range."""
        limits = {"symbols": (0.02, 0.1, 0.3), "marked": (0.05, 0.25), "exclamations": (0.02, 0.1, 0.3), "capitals": (0.1, 0.5), "repeated": (0.1, 0.5), "different": (0.25, 0.5)}
        return np.stack([crc32(name.encode(), 1) // 8 * 8 + np.searchsorted(x, f[name]) for name, x in limits.items()], axis=1).astype(np.int64)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of each vote pattern; and (labellers, classes, 2): the chances of a vote against and for the class, by expectation maximisation.

    Who abstains says nothing: only votes count.
    """
    if not patterns:
        return {}, np.empty((0, 2, 2))
    votes = np.array(list(patterns), int)
    n = np.array(list(patterns.values()), float)
    said = np.stack([votes == v for v in (-1, 1)], axis=2).astype(float)
    p = np.where((votes > 0).any(axis=1), 0.9, 0.05)  # votes against are cheap: most kinds of unwanted texts show in few ways
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        chance = np.einsum("cp,plv->lcv", weight, said) + 0.1
        chance /= chance.sum(axis=2, keepdims=True)
        spoken = np.abs(votes).sum(axis=1) > 0
        prior = ((weight * spoken).sum(axis=1) + 1) / ((n * spoken).sum() + 2)
        log = np.log(prior) + np.einsum("plv,lcv->pc", said, np.log(chance))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
    return dict(zip(patterns, p.tolist(), strict=True)), chance


def train(docs: np.ndarray, columns: np.ndarray, y: np.ndarray, weight: np.ndarray, features: int, epochs: int = 150, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer; (docs, columns): the features of each row. The bias takes in a limit that few negatives pass."""
    n, w, square, bias = len(y), np.zeros(features), np.full(features, 1e-6), -1.0
    if not n:
        return w, bias
    share = max(float((weight * y).sum()), 1) / max(float(weight.sum()), 1)
    balance = weight * np.where(y > 0.5, min(20.0, 0.5 / share), 1.0)
    for _ in range(epochs):  # full gradients, scaled for each feature
        z = np.bincount(docs, w[columns], n) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.bincount(columns, error[docs], features) + decay * w
        square += g * g
        w -= rate * g / np.sqrt(square)
        bias = min(-1.0, bias - rate * 4 * error.sum())  # without evidence a text is not rejected
    z = np.bincount(docs, w[columns], n) + bias
    sure = weight > 0.8
    negative = z[sure & (y < 0.1)]
    limit = max(0.0, float(np.quantile(negative, 0.999)) + 0.1) if len(negative) else 0.0
    return w, bias - limit


def _about(docs: DataFrame, total: int, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` of ``total`` rows, by a hash of the id."""
    return docs if total <= most else docs.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / total))


def _joined(votes: np.ndarray) -> list[str]:
    return ["".join("-0+"[v + 1] for v in row) for row in votes.tolist()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", toxic: str = "toxic", quality: str = "quality", labelled_docs: int = 12_000, train_docs: int = 3_000, most_features: int = 6000) -> dict:
    """The scorers by class (poor, toxic): bias and weights by feature; and what each labeller says in either class."""
    own = two_columns(docs, key, text)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}
        for batch in batches:
            strings = batch.column(0).to_pylist()
            for a, b in by_bytes(strings):
                t = Texts(strings[a:b])
                votes = t.votes(t.figures())
                for name, some in zip(CLASSES, (votes[:, :_POOR], votes[:, _POOR:]), strict=True):
                    for pattern in _joined(some):
                        found[name, pattern] = found.get((name, pattern), 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_pydict({"name": pa.array([k[0] for k in keys], pa.string()), "pattern": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counts = own.select("text").transform(in_arrow, vote, "name string, pattern string, n long").groupBy("name", "pattern").agg(F.sum("n").alias("n")).collect()  # at most 3^labellers rows
    posterior, chances = {}, {}
    for name, kinds in zip(CLASSES, (_KINDS[:_POOR], _KINDS[_POOR:]), strict=True):
        found, chance = estimate({tuple("-0+".index(c) - 1 for c in r["pattern"]): r["n"] for r in sorted(counts, key=lambda r: r["pattern"]) if r["name"] == name})
        posterior[name] = {"".join("-0+"[v + 1] for v in k): p for k, p in found.items()}
        chances |= dict(zip(kinds, chance.tolist(), strict=True)) if len(chance) else {}

    marked = labels.select(F.col(label_key).alias("id"), F.col(toxic).cast("double").alias("toxic"), (1 - F.col(quality)).cast("double").alias("poor")).where("id is not null and toxic is not null and poor is not null")
    some = _about(marked, marked.count(), labelled_docs, "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("poor").alias("poor"))  # about labelled_docs rows: broadcast
    with_label = own.join(F.broadcast(some), own.doc_id == some["id"]).select("text", "poor", "toxic")
    rows = with_label.unionByName(_about(own, own.count(), train_docs).select("text", F.lit(None).cast("double").alias("poor"), F.lit(None).cast("double").alias("toxic")))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, given = batch.column(0).to_pylist(), [batch.column(k).to_pylist() for k in (1, 2)]
            for a, b in by_bytes(strings):
                t = Texts(strings[a:b])
                f = t.figures()
                votes, of_word, of_text = t.votes(f), t.hashed(), t.of_text(f)
                doc, word = t.pairs()
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                out = []
                patterns = _joined(votes[:, :_POOR]), _joined(votes[:, _POOR:])
                for k in range(b - a):
                    ids = np.unique(np.r_[of_word[word[cut[k] : cut[k + 1]]].reshape(-1), of_text[k]]) if t.n[k] else np.zeros(0, np.int64)
                    row = [ids[ids != 0].tolist()]
                    for c, name in enumerate(CLASSES):
                        label = given[c][a + k]
                        p = posterior[name].get(patterns[c][k], 0.0) if label is None else label
                        row += [p, abs(2 * p - 1) if label is not None or patterns[c][k].strip("0") else 0.0]  # nothing is said of it
                    out.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.list_(pa.int64()), *[pa.float64()] * 4), strict=True)], names=["ids", "poor", "poor_weight", "toxic", "toxic_weight"])

    described = settle(rows.transform(in_arrow, describe, "ids array<long>, poor double, poor_weight double, toxic double, toxic_weight double"), "described")
    told = described.agg(*[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(f"{c}_weight")), F.sum(f"{c}_weight")), F.lit(0.0)).alias(c) for c in CLASSES]).first()
    seen = described.select(F.explode("ids").alias("id"), *CLASSES, *[f"{c}_weight" for c in CLASSES]).groupBy("id").agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"{c}_weight") * (F.col(c) - told[c])).alias(c) for c in CLASSES]
    ).where("n >= 5")
    chosen = {}
    for c in CLASSES:  # most_features rows at most
        best = seen.select("id", (F.col(c) * F.col(c) / (F.col("n") + 5)).alias("worth")).orderBy(F.desc("worth"), "id").limit(most_features).collect()
        chosen[c] = np.array(sorted(r["id"] for r in best), np.int64)

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row only the chosen features, by number."""
        for batch in batches:
            lists = batch.column(0)
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            arrays = []
            for c in CLASSES:
                at = np.minimum(np.searchsorted(chosen[c], ids), max(0, len(chosen[c]) - 1))
                keep = chosen[c][at] == ids if len(chosen[c]) else np.zeros(len(ids), bool)
                offsets = np.r_[0, np.cumsum(keep)][np.r_[0, ends]]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at[keep].astype(np.int64))))
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[1:]], names=["poor_ids", "toxic_ids", "poor", "poor_weight", "toxic", "toxic_weight"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        found = {}
        for c in CLASSES:
            if table is None:
                found[c] = {"bias": -1.0, "weights": {}}
                continue
            lists = table[f"{c}_ids"].combine_chunks()
            columns, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            w, bias = train(np.repeat(np.arange(len(size)), size), columns, table[c].to_numpy(), table[f"{c}_weight"].to_numpy(), len(chosen[c]))
            found[c] = {"bias": bias, "weights": {str(i): x for i, x in zip(chosen[c].tolist(), w.tolist(), strict=True) if abs(x) > 1e-3}}
        yield pa.RecordBatch.from_pydict({"model": pa.array([json.dumps(found)], pa.string())})

    few = described.transform(in_arrow, selected, "poor_ids array<long>, toxic_ids array<long>, poor double, poor_weight double, toxic double, toxic_weight double")
    found = few.repartition(1).transform(in_arrow, learn, "model string").first()  # the chosen features of a bounded sample
    return {"scorers": json.loads(found["model"]), "labellers": chances}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_poor, p_toxic, kept (both under a half); no shuffle. The model has at most ``most_features`` weights a class."""
    scorers = []
    for name in CLASSES:
        weights = sorted((int(i), w) for i, w in model["scorers"][name]["weights"].items())
        scorers.append((model["scorers"][name]["bias"], np.array([i for i, _ in weights], np.int64), np.array([w for _, w in weights])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, strings = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(strings):
                t = Texts(strings[a:b])
                of_word, of_text = t.hashed(), t.of_text(t.figures())
                p = []
                for bias, ids, w in scorers:
                    z = np.full(b - a, bias)
                    if len(ids):
                        at = np.minimum(np.searchsorted(ids, of_word), len(ids) - 1)
                        known = ids[at] == of_word
                        use = known.any(axis=1)[t.index]  # places of words with any feature that counts
                        doc, word = t.doc[use], t.index[use]
                        pairs = np.unique((doc[:, None] * len(ids) + at[word])[known[word]])  # each feature once a text
                        z += np.bincount(pairs // len(ids), w[pairs % len(ids)], b - a)
                        at = np.minimum(np.searchsorted(ids, of_text), len(ids) - 1)
                        z += np.where((ids[at] == of_text) & (t.n > 0)[:, None], w[at], 0).sum(axis=1)
                    p.append(np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(p[0]), pa.array(p[1]), pa.array((p[0] < 0.5) & (p[1] < 0.5))], names=["doc_id", "p_poor", "p_toxic", "kept"])

    return two_columns(docs, key, text).transform(in_arrow, run, "doc_id long, p_poor double, p_toxic double, kept boolean")
