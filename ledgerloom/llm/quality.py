"""Quality rules: base counts of a text, and the hashed n-gram log-likelihood ratio of a trusted target to the corpus.

Two multinomials over hashed word 1- and 2-grams are counted over whole tables: one from the trusted documents (those
labelled of good quality), one from all documents. A text's score is the sum over its n-grams of the logarithm of the
two probabilities' ratio, divided by their number. Every text with a score below one threshold is rejected, as is every
text that fails the base rules (too few words, too many words in repeated windows). DataFrame functions only.

Words are runs of anything but ASCII white space. Null and empty texts have no words and fail the base rules. Without
any trusted document there is no target, the score is 0 and the base rules alone decide. Rows are judged one by one, so
repeated rows and ids, null ids and further columns are harmless; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD_GAP, checked_broadcast, let, stash

BUCKETS = 1 << 14
#: Added to every bucket's count; the target's share of it follows the corpus.
SMOOTHING = 1.0
#: A text is kept down to a mean log-ratio (nats an n-gram) of -MARGIN, less what a target of few n-grams costs any text:
#: NOISE * BUCKETS / (n-grams of the target).
MARGIN, NOISE = 0.04, 1.2
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = r"[#*$%&|<>]"
SPACE = " \t\n\x0b\f\r"
#: Bits of a sort key that hold a word's place; longer texts are sorted whole.
PLACE_BITS = 24


def words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def neighbours(hashes: Column, k: int) -> Column:
    """Hashes of the k-word windows, from an array of word hashes that is a column or a lambda variable."""
    each = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, k))))
    return F.slice(each, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0)))


def repeated_words(windows: Column, k: int) -> Column:
    """Words that lie in a window which occurs twice or more. windows: a column that later steps may read repeatedly."""
    mask = (1 << PLACE_BITS) - 1

    def equal_beside(array: Column, key) -> Column:
        return F.filter(array, lambda x, i: (key(x) == key(F.get(array, i + 1))) | ((i > 0) & (key(x) == key(F.get(array, F.greatest(i - 1, F.lit(0)))))))

    keys = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    likely = let(keys, lambda s: F.transform(equal_beside(s, lambda x: F.shiftright(x, PLACE_BITS)), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")))
    places = F.when(F.size(windows) > mask, F.sequence(F.lit(0), F.size(windows) - 1)).otherwise(likely)
    exact = F.sort_array(F.transform(places, lambda p: F.struct(F.get(windows, p).alias("h"), p.alias("p"))))
    twice = let(exact, lambda s: equal_beside(s, lambda x: x["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*(x["p"] + j for j in range(k)))))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered).cast("long")


def hashed(docs: DataFrame) -> DataFrame:
    """(row: the input row, text, words, hashes: of the words)."""
    own = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    split = own.select("row", "text", words(F.col("text")).alias("words"))
    return split.select("row", "text", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def buckets(hashes: Column) -> Column:
    """The hashed 1-grams and 2-grams of a text."""
    to = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(hashes, to), F.transform(neighbours(hashes, 2), to))


def fold(text: Column) -> Column:
    """The half in which a text is counted; equal texts are in one half, and so are judged by the same counts."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


@dataclass
class Model:
    """tables: t_half, t_ratio (the log-ratio of every bucket), one row a half."""

    tables: DataFrame
    threshold: float


def fit(docs: DataFrame, trusted: DataFrame) -> Model:
    """Log-ratios of the buckets and the threshold, from counts over all documents; trusted holds the doc_id of trusted documents.

    Documents are counted in two halves by their text, and each half gets its table from the other one's counts, so that
    no text is measured by itself, copies score alike, and labelled and unlabelled texts do, however few are labelled.
    The two tables are two rows of a written table, broadcast by judge.
    """
    own = checked_broadcast(stash(trusted.select(F.col("doc_id").alias("t_id")).where("t_id is not null").distinct(), "trusted"))
    each = hashed(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), fold(F.col("text")).alias("half"), buckets(F.col("hashes")).alias("grams"))
    # explode would add a filter on the grams' size, which is pushed below and computes them all again
    grams = F.explode_outer("grams").alias("bucket")
    marked = each.join(own, F.col("doc_id") == F.col("t_id"), "left").select(F.col("t_id").isNotNull().cast("long").alias("t"), "half", grams)
    counts = stash(marked.where("bucket is not null").groupBy("bucket", "half").agg(F.count("*").alias("raw"), F.sum("t").alias("target")), "grams")
    spark = docs.sparkSession
    sums = {1 - r["half"]: (r["t"], r["r"]) for r in counts.groupBy("half").agg(F.sum("target").alias("t"), F.sum("raw").alias("r")).collect()}
    target, raw = ([sums.get(h, (0, 0))[i] for h in (0, 1)] for i in (0, 1))
    every = spark.range(2 * BUCKETS).select((F.col("id") % BUCKETS).cast("int").alias("bucket"), F.floor(F.col("id") / BUCKETS).cast("int").alias("t_half"))
    both = every.join(counts.withColumn("t_half", 1 - F.col("half")), ["bucket", "t_half"], "left")  # two rows a bucket
    ratio = F.when(F.col("t_half") == 0, log_ratio(target[0], raw[0])).otherwise(log_ratio(target[1], raw[1]))
    listed = F.sort_array(F.collect_list(F.struct("bucket", ratio.alias("ratio"))))
    tables = both.groupBy("t_half").agg(F.transform(listed, lambda x: x["ratio"]).alias("t_ratio"))
    return Model(stash(tables, "ratios"), -(MARGIN + NOISE * BUCKETS / max(1.0, min(target))))


def log_ratio(all_target: int, all_raw: int) -> Column:
    """Of a bucket with the counts target and raw; the target is smoothed towards the corpus."""
    if not all_target:
        return F.lit(0.0)
    prior = SMOOTHING * BUCKETS
    chance = (F.coalesce("raw", F.lit(0)) + SMOOTHING) / (all_raw + prior)
    return F.round(F.log((F.coalesce("target", F.lit(0)) / chance + prior) / (all_target + prior)), 5)


def summed(grams: str, ratio: Column) -> Column:
    return F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(ratio, b))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """row (the input row), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = hashed(docs).select(
        "row",
        fold(F.col("text")).alias("half"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        neighbours(F.col("hashes"), WINDOW).alias("windows"),
        buckets(F.col("hashes")).alias("grams"),
    )
    total = summed("grams", F.col("t_ratio"))
    scored = counted.join(F.broadcast(model.tables), F.col("half") == F.col("t_half"), "left").select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("windows"), WINDOW).alias("n_repeat_words"),
        F.coalesce(F.round(F.try_divide(total, F.size("grams")), 6), F.lit(0.0)).alias("llr"),
        # never null; keeps a filter on the verdict from being pushed below, where each lambda would split the text again
        F.monotonically_increasing_id().alias("seen"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = ~F.col("base_failed") & (F.col("llr") >= model.threshold) & (F.col("seen") >= 0)
    return scored.withColumn("base_failed", failed).withColumn("kept", verdict).drop("seen")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge docs against the documents among them that labels call good (quality 1)."""
    return judge(docs, fit(docs, labels.where("quality = 1")))
