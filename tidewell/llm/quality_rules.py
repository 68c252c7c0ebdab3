"""Quality rules as a short-circuit cascade.

Words are runs without ASCII white space. Base figures are counted for every whole text; the
rules beyond the base look at a text one after another and stop at the first that rejects
it. Their order comes from a bounded sample: each rule's seconds a document and share of
rejected documents are measured, and rules run by rejections per second. The verdict is the
same in any order.

Capitals are weighed against the letters of every alphabet, and long words don't count
against scripts that are written without spaces.

Defined cases: null or empty text has no words and fails the base; a repeated row is judged
as often as it occurs; no documents give no rows; other columns, whatever their names,
are kept by ``passing`` and not looked at by ``judge``; texts of any length are read whole.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WS, in_arrow, two_columns
from tidewell.llm.tokens import by_bytes

SYMBOLS = "#*$%&|<>"
#: Thai, Lao, Myanmar, Khmer; CJK signs, kana, ideographs and full-width forms. Korean uses spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff]+")
FIGURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) > 2_000_000:  # three of them no longer fit in 63 bits
        _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        keys = pairs[:-1] * np.int64(len(seen)) + ids[2:]
    else:
        keys = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def cheap_figures(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines of a whole text: all that the rules look at."""
    lines = [x for x in text.split("\n") if x.strip(WS)]
    return len(words), len(text) - sum(map(text.count, WS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def figures(text: str) -> tuple[int, int, int, int, int]:
    """The same and n_repeat_words."""
    words = text.encode().split()
    return *cheap_figures(text, words), repeated_words(words)


#: A rule sees the text and its figures and says whether it rejects. All limits are shares of whole texts.
Rule = Callable[[str, tuple[int, ...]], bool]


def many_symbols(text: str, f: tuple) -> bool:
    return 100 * f[2] > 30 * f[0]


def many_equal_lines(text: str, f: tuple) -> bool:
    return 5 * f[3] > 4 * sum(1 for x in text.split("\n") if x.strip(WS))


def without_spaces(text: str, f: tuple) -> bool:
    """Whether over half of a text's word characters belong to scripts that don't part words by spaces."""
    return not text.isascii() and 2 * sum(map(len, _UNSPACED.findall(text))) > f[1]


def odd_word_length(text: str, f: tuple) -> bool:
    return f[1] < 2 * f[0] or (f[1] > 14 * f[0] and not without_spaces(text, f))


def many_exclamations(text: str, f: tuple) -> bool:
    return 100 * text.count("!") > 30 * f[0]


def mostly_capitals(text: str) -> bool:
    """Whether ASCII capitals are over half of the ASCII letters and the letters of other alphabets."""
    upper, lower = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    return upper > lower and (text.isascii() or upper > lower + sum(c.isalpha() for c in text if c > "\x7f"))


def shouted(text: str, f: tuple) -> bool:
    return mostly_capitals(text)


def few_letters(text: str, f: tuple) -> bool:
    digits = sum(map(text.count, "0123456789"))
    return 100 * (digits + f[2]) > 50 * f[1]


RULES: dict[str, Rule] = {r.__name__: r for r in (many_symbols, many_equal_lines, odd_word_length, many_exclamations, shouted, few_letters)}


LEAST_WORDS = 50


def base_failed(f: tuple) -> bool:
    return f[0] < LEAST_WORDS or 100 * f[4] > 50 * f[0]


def cascade_order(docs: DataFrame, text: str = "text", sample_docs: int = 2000, seed: int = 7) -> list[str]:
    """Rule names by rejections per second on a sample of about ``sample_docs`` documents (the bound of what is timed).

    The timings are summed on the executors; one row a rule comes back.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                f = figures(t)
                if base_failed(f):
                    continue
                n += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    hits[name] += rule(t, f)
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "seconds": [spent[r] for r in RULES], "rejected": pa.array([hits[r] for r in RULES], pa.int64()), "seen": pa.array([n] * len(RULES), pa.int64())})

    total = docs.count()
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(min(1.0, sample_docs / max(1, total)), seed)
    rows = some.transform(in_arrow, measure, "rule string, seconds double, rejected long, seen long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n")).collect()
    worth = {r["rule"]: ((r["r"] + 0.5) / (r["n"] + 1)) / ((r["s"] + 1e-9) / (r["n"] + 1)) for r in rows}
    return sorted(RULES, key=lambda name: (-worth.get(name, 0.0), name))


def verdict(text: str, f: tuple, order: list[str]) -> bool:
    return not base_failed(f) and not any(RULES[name](text, f) for name in order)


def passes(text: str, order: list[str]) -> bool:
    """The same verdict with no more work than it takes: few words end it, repeated words, the dearest count, come last."""
    words = text.encode().split()
    if len(words) < LEAST_WORDS:
        return False
    f = cheap_figures(text, words)
    return not any(RULES[name](text, f) for name in order) and not base_failed((*f, repeated_words(words)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 2000) -> DataFrame:
    """Figures and verdict of every document; no shuffle."""
    order = cascade_order(docs, text, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 6 + (pa.bool_(),) * 2
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts):
                rows = [(k, *(f := figures(t)), base_failed(f), verdict(t, f, order)) for k, t in zip(keys[a:b], texts[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FIGURES.split(", ")])

    return two_columns(docs, key, text).transform(in_arrow, run, FIGURES)


def passing(docs: DataFrame, text: str = "text", sample_docs: int = 2000) -> DataFrame:
    """The rows of ``docs`` whose text passes base and cascade, with all their columns; no shuffle."""
    order, at = cascade_order(docs, text, sample_docs), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [passes(t.as_py() or "", order) for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)
