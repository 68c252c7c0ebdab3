"""Line dedup with an edit bound of one character, in DataFrame operations only.

A line goes if an earlier one, by (doc_id, line number), is equal to it or, for lines of at
least ``fuzzy_chars`` characters, within one insertion, deletion or substitution. Lines
without a word stay.

Equal lines: occurrences are aggregated by a 128-bit hash. Near lines, by deletion
neighbourhoods: all variants of a line with one character deleted are emitted as hashed keys.
A substitution at a place leaves two lines equal after deletion there; an insertion makes
one line a variant of the other. So the earliest line of a (variant, place) group is within
the bound of every other line of it, and the earliest owner of a variant is within the bound of
the line that equals the variant: each line needs one witness a group, and no pairs are
listed. Witnesses are confirmed by ``levenshtein`` on the texts.

Only lines that can have a partner emit variants: with one edit, either the first or the
last half of the shorter line stands unchanged in the other. Lines none of whose halves occurs
in a different line are left out, which loses no partner.

Defined cases: null text is empty and comes back null; an empty text stays; rows with equal
doc_id and text are one document that occurs more than once, and get the same lines;
null doc_ids come first; no documents give no rows; all other columns are kept; texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle, two_columns

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(own: DataFrame) -> DataFrame:
    """(doc_id, row, i, line, h1, h2) of all lines with a word."""
    cut = own.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike(_HAS_WORD))
    return cut.select("doc_id", "row", "i", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _near(own: DataFrame, occurrences: DataFrame, firsts: DataFrame, fuzzy_chars: int, most_broadcast: int) -> DataFrame:
    """Distinct (h1, h2) of lines that have an earlier line at one edit."""
    halves = occurrences.where(F.col("halves").isNotNull()).select("h1", "h2", F.explode("halves").alias("half"))
    mixed = settle(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("half"), "halves")
    wanted = settle(halves.join(_small(mixed, most_broadcast), "half").select("h1", "h2").distinct(), "wanted")
    texts = _lines(own).join(_small(wanted, most_broadcast), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = settle(texts.join(firsts, ["h1", "h2"]).select("h1", "h2", "line", "first"), "near-lines")

    deleted = texts.select("h1", "h2", "first", F.posexplode(F.expr("transform(sequence(1, char_length(line)), i -> xxhash64(concat(substr(line, 1, i - 1), substr(line, i + 1))))")).alias("at", "variant"))
    own_line = F.struct("first", "h1", "h2").alias("own")
    deleted = settle(deleted.select("variant", "at", own_line), "variants")
    whole = texts.select(F.xxhash64("line").alias("variant"), own_line)

    # Few variants occur twice: they are counted by key alone, and only their lines go on.
    twice = settle(deleted.groupBy("variant", "at").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    met = deleted.join(_small(twice, most_broadcast), ["variant", "at"])
    by_place = met.groupBy("variant", "at").agg(F.min("own").alias("witness"))
    substituted = met.join(by_place, ["variant", "at"]).select("own", "witness")
    longer = deleted.join(_small(whole.withColumnRenamed("own", "other"), most_broadcast), "variant")  # a whole line is one row
    shorter = longer.groupBy("variant").agg(F.min("own").alias("witness"), F.first("other").alias("own")).select("own", "witness")
    pairs = substituted.unionByName(longer.select("own", F.col("other").alias("witness"))).unionByName(shorter).where("witness.first < own.first").distinct()

    a = pairs.select(F.col("own.h1").alias("h1"), F.col("own.h2").alias("h2"), F.col("witness.h1").alias("w1"), F.col("witness.h2").alias("w2")).distinct()
    both = a.join(texts.select("h1", "h2", F.col("line").alias("x")), ["h1", "h2"]).join(texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("line").alias("y")), ["w1", "w2"])
    return both.where(F.levenshtein("x", "y", 1) >= 0).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", fuzzy_chars: int = 40, most_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, row, drop): for each document that loses lines, their numbers from 0. ``row``: the hash of the text."""
    own = two_columns(docs, key, text).withColumn("row", F.xxhash64("text"))
    n, m = F.char_length("line"), F.expr("char_length(line) div 2")
    less = F.expr("(char_length(line) - 1) div 2")

    def half(size):
        return F.xxhash64(F.lit(1), size, F.left("line", size)), F.xxhash64(F.lit(2), size, F.right("line", size))

    halves = F.when(n >= fuzzy_chars, F.when(m == less, F.array(*half(m))).otherwise(F.array(*half(m), *half(less))))
    occurrences = settle(_lines(own).select("doc_id", "row", "i", "h1", "h2", halves.alias("halves")), "lines")
    firsts = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "i")).alias("first"))
    near = settle(_near(own, occurrences, firsts, fuzzy_chars, most_broadcast), "near").withColumn("near", F.lit(True))
    judged = firsts.join(near, ["h1", "h2"], "left")
    gone = occurrences.join(judged, ["h1", "h2"]).where(F.col("near") | (F.struct("doc_id", "i") > F.col("first")))
    return gone.groupBy("doc_id", "row").agg(F.collect_set("i").alias("drop"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None, **options) -> DataFrame:
    """``docs`` with the lines of ``text`` that stay; ``counts``: names for two more columns, lines and dropped lines."""
    drops = dropped_lines(docs, key, text, **options).withColumnsRenamed({"doc_id": "__id", "row": "__row", "drop": "__drop"})
    joined = docs.join(drops, docs[key].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__row")), "left")
    column = f"`{text}`"
    kept = F.expr(
        f"if(__drop is null, {column}, element_at(transform(array(split({column}, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), __drop), i -> element_at(l, i + 1)), '\\n')), 1))"
    )
    more = {} if counts is None else {
        counts[0]: F.size(F.split(F.coalesce(docs[text], F.lit("")), "\n")).cast("long"), counts[1]: F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
    }
    return joined.select(*[kept.alias(text) if c == text else docs[c] for c in docs.columns], *[v.alias(k) for k, v in more.items()])
