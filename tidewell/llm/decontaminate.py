"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded. A window is
``span`` consecutive words of a benchmark item, or a whole item of fewer words. From the
hashes of k-word grams the smallest in each window of words is kept. A window that occurs
in a document has the same smallest gram there, so every shared span of at least the window's
length shares a fingerprint, and only about two in ``span - k + 2`` hashes are kept.

Steps: fingerprints of all documents and of the benchmark's windows; documents that share
one are candidates; the words of candidates, in blocks that overlap by a window, are
compared with the windows themselves, which extends and confirms the hits word for word.
The benchmark's side of a join is broadcast only after its rows were counted; beyond
``most_broadcast`` rows both sides are shuffled.

Defined cases: null or empty text has no words and is clean; an item without words matches
nothing; rows with equal doc_id and text are judged alike and all returned; an empty
benchmark makes every document clean; no documents give no rows; other columns are not
looked at; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import let, settle, two_columns

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words as they stand, not folded."""
    return F.array_remove(F.split(text, _BETWEEN), "")


def folded(word: Column) -> Column:
    """Only A-Z in lower case; ``lower`` does that faster where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def fingerprints(hashes: Column, length: int, k: int) -> Column:
    """Distinct smallest k-gram hashes of all windows of ``length`` words; none if there are fewer words."""
    k = min(k, length)
    n, per_window = F.size(hashes), length - k + 1
    grams = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))
    least = let(grams, lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), n - (length - 1)), lambda i: F.array_min(F.slice(g, i, per_window)))))
    return F.when(n >= length, least).otherwise(F.array().cast("array<bigint>"))


def _windows(benchmark: DataFrame, item: str, text: str, span: int, k: int) -> DataFrame:
    """Distinct (item_id, length, window text, fp)."""
    own = benchmark.select(F.col(item).alias("item_id"), F.transform(words(F.coalesce(F.col(text), F.lit(""))), folded).alias("w")).where("size(w) > 0")
    own = own.withColumn("length", F.least(F.size("w"), F.lit(span)))
    cut = own.select("item_id", "length", F.explode(F.expr("transform(sequence(1, size(w) - length + 1), i -> slice(w, i, length))")).alias("w"))
    gram = F.expr(f"array_min(transform(sequence(1, length - least({k}, length) + 1), i -> xxhash64(transform(slice(w, i, least({k}, length)), x -> xxhash64(x)))))")
    return settle(cut.select("item_id", "length", F.array_join("w", " ").alias("window"), gram.alias("fp")).distinct(), "windows")


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block: int = 2000, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and ``row``, the hash of the text."""
    windows = _windows(benchmark, item, item_text, span, k)
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # 1 to span at most
    own = two_columns(docs, key, text).withColumn("row", F.xxhash64("text"))

    hashed = own.select("doc_id", "row", let(words(F.col("text")), lambda w: F.transform(w, lambda x: F.xxhash64(folded(x)))).alias("h"))
    found = let(F.col("h"), lambda h: F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[fingerprints(h, n, k) for n in sorted(lengths)])))
    base = settle(hashed.select("doc_id", "row", F.size("h").cast("long").alias("n_words"), found.alias("fps")), "fingerprints")

    wanted = _small(windows.select("fp").distinct(), most_broadcast)
    candidates = settle(base.select("doc_id", "row", F.explode("fps").alias("fp")).join(wanted, "fp").select("doc_id", "row").distinct(), "candidates")
    texts = own.alias("o").join(_small(candidates, 5 * most_broadcast).alias("c"), F.expr("o.doc_id <=> c.doc_id and o.row = c.row"), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "row"])

    blocks = texts.select("doc_id", "row", F.transform(words(F.col("text")), folded).alias("w")).select(
        "doc_id", "row", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - 1, 0), {block}), b -> struct(b as at, slice(w, b + 1, {block + span - 1}) as w))")).alias("b")
    )
    starts = F.expr("concat(array(), " + ", ".join(
        f"if(size(b.w) >= {n}, transform(sequence(1, least(size(b.w) - {n - 1}, {block})), i -> struct({n} as length, b.at + i - 1 as at, array_join(slice(b.w, i, {n}), ' ') as window)), array())" for n in sorted(lengths)
    ) + ")") if lengths else F.expr("array(struct(1 as length, 0 as at, '' as window))")
    places = blocks.select("doc_id", "row", F.explode(starts).alias("p")).select("doc_id", "row", "p.*")
    hits = settle(places.join(_small(windows.select("window", "item_id"), most_broadcast), "window").select("doc_id", "row", "at", "length", "item_id"), "hits")

    covered = hits.select("doc_id", "row", "at", "length").distinct().select("doc_id", "row", F.explode(F.expr("sequence(at, at + length - 1)")).alias("at")).distinct().groupBy("doc_id", "row").agg(F.count("*").alias("n_hit"))
    items = hits.select("doc_id", "row", "item_id").distinct().groupBy("doc_id", "row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    marks = covered.alias("x").join(items.alias("y"), F.expr("x.doc_id <=> y.doc_id and x.row = y.row")).select("x.doc_id", "x.row", "n_hit", "n_items", "items")
    out = base.alias("b").join(marks.alias("m"), F.expr("b.doc_id <=> m.doc_id and b.row = m.row"), "left")
    return out.select(
        "b.doc_id", "b.row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    marked = contamination(docs, benchmark, key, text, **options).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
    return docs.join(marked, docs[key].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__row")), "left_anti")
