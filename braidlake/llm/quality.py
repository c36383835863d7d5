"""Quality rules in DataFrame operations only: counts of symbols and repeats, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. Two multinomials over the buckets are
counted: one over a trusted target (labelled good, not toxic), one over the whole raw corpus. A document's score is the
mean over its n-grams of log p_target - log p_raw, its own n-gram left out of both counts; a document is kept if no base rule fails and its score reaches a fixed
threshold, so every document is judged alike, whatever else is in the corpus run.

The bucket weights are one row of fixed length. All trusted ids count, whatever their number: texts meet them once, in a
merge join, to be counted, and counts are over all n-grams of all documents, trusted or raw, added up per task before they
are shuffled. Texts are then scored where they lie, as a trusted document and as another, and only the figures meet the
trusted ids to say which holds.

Defined results: a null or empty text has no words and fails; without trusted documents all weights are 0 and only the
base rules decide; rows that repeat are judged each; a null doc_id is never trusted; very long texts are one row's arrays;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 16
#: Raw n-grams that each bucket is taken to hold beforehand; the target gets its share of them, so few n-grams weigh little.
SMOOTHING = 20.0
THRESHOLD = -0.1
WINDOW, FEWEST, REPEATED_PERCENT = 8, 20, 30


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of words that occur twice or more in the text, the first occurrence included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))

    def starts(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["at"]))

    def covered(found: Column) -> Column:
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"))
        return F.aggregate(found, zero, step)["n"]

    pairs = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(let(pairs(w), starts), covered))
    return F.when(F.size(words) < window, 0).otherwise(let(windows, count)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def buckets(words: Column) -> Column:
    """The bucket of every word and of every pair of neighbours, by the hash of their words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pair = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
    grams = let(hashes, lambda h: F.when(F.size(h) < 2, h).otherwise(F.concat(h, pair(h))))
    return F.transform(grams, lambda g: F.pmod(g, F.lit(BUCKETS)).cast("int"))


def with_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))


def weights(docs: DataFrame, trusted: DataFrame, ws: Workspace) -> DataFrame:
    """One row: the log ratio of every bucket, for other and for trusted documents. trusted: distinct doc_ids."""
    spark = docs.sparkSession
    marked = docs.hint("merge").join(trusted.select("doc_id", F.lit(1).alias("good")), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    grams = marked.select("good", F.explode(buckets(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    counts = ws.table(spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0), "counts")
    total = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    r, t = total["r"] or 0, total["t"] or 0
    prior = SMOOTHING * t / max(1, r)

    def ratio(own: int) -> Column:
        """Log ratio for an n-gram of a document: without its own count, which is in the target too if it is trusted."""
        raw = F.log((F.greatest(F.col("raw") - 1, F.lit(0)) + SMOOTHING) / (r + SMOOTHING * BUCKETS))
        target = F.log((F.greatest(F.col("target") - own, F.lit(0)) + prior) / (t + prior * BUCKETS))
        return (target - raw if t else F.lit(0.0)).alias("w")

    sorted_ = lambda own: F.sort_array(F.collect_list(F.struct("b", ratio(own))))["w"]
    return ws.table(counts.agg(sorted_(0).alias("w"), sorted_(1).alias("w_trusted")), "weights", keep=True)


def base_rules(docs: DataFrame) -> DataFrame:
    """The base columns of (doc_id, text, words)."""
    n = F.size("words").cast("long")
    docs = docs.select(
        "doc_id", "words", n.alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def scored(docs: DataFrame, weights_row: DataFrame) -> DataFrame:
    """Replaces words by the length-normalised log-likelihood ratios of a document that is not trusted and of one that is.
    The weights are a subquery's one value, read once."""
    total = lambda b, w: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(w, x))
    grams = F.greatest(F.lit(1), 2 * F.size("words") - 1)
    docs = docs.select("*", *[weights_row.select(w).scalar().alias(f"__{w}__") for w in ("w", "w_trusted")])
    both = let(buckets(F.col("words")), lambda b: F.array(total(b, F.col("__w__")), total(b, F.col("__w_trusted__"))))
    return docs.withColumn("__scores__", F.transform(both, lambda x: x / grams)).drop("__w__", "__w_trusted__", "words")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, base_failed, score and kept for every document."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    with Workspace(docs.sparkSession, "quality") as ws:
        trusted = ws.table(good, "trusted", keep=True)
        table = weights(docs.select("doc_id", "text"), trusted, ws)
    judged = scored(base_rules(with_words(docs)), table)
    judged = judged.hint("merge").join(trusted.withColumn("__trusted__", F.lit(1)), "doc_id", "left")
    judged = judged.withColumn("score", F.get("__scores__", F.coalesce("__trusted__", F.lit(0))))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", kept.alias("kept"))
