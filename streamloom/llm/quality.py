"""Quality rules [native]: hashed n-gram log-likelihood ratio.

Words and adjacent word pairs are hashed into BUCKETS. Two multinomials over
the buckets are counted: the raw corpus (every document) and the trusted
target (documents labelled good). A document's score is the sum over its
n-grams of log(p_target / p_raw), divided by their number, and a document is
kept if that mean reaches THRESHOLD: no random draw, every document decided.
Simple base rules (too short, too repetitive) come first.

The weights are BUCKETS numbers whatever the corpus size, so they ride in the
plan as one constant. The raw multinomial covers all rows and the trusted one
all documents labelled good. Their ids are broadcast if they are BROADCAST_IDS
at most (about 16 bytes each); more are joined by a shuffle of the labelled
documents' hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

BUCKETS = 1 << 14
BROADCAST_IDS = 500_000
THRESHOLD = -0.12
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
_BLANKS = "\\t\\n\\u000B\\u000C\\r "


def with_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, text, words (runs of anything but ASCII white space), hashes (64 bits a word); the whole row as ``carry``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct("*").alias(carry)] if carry else []))
        .withColumn("bare", F.expr(f"trim(BOTH '{_BLANKS}' FROM text)"))
        .withColumn("words", F.expr(r"if(bare = '', array(), split(bare, '[ \\t-\\r]+'))"))
        .drop("bare")
        .withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    )


def base_features(worded: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    n_repeat_words counts the words inside 5-word windows that occur twice or
    more in the text. Window hashes are compared within one text only; texts
    without a repeated window (nearly all) skip the sorting.
    """
    k = WINDOW_WORDS
    window = ", ".join(f"hashes[i + {j}]" for j in range(k))
    out = (
        worded.withColumn("n_words", F.expr("cast(size(words) as bigint)"))
        .withColumn("word_chars", F.expr("aggregate(words, 0L, (a, w) -> a + length(w))"))
        .withColumn("n_symbols", F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)"))
        .withColumn("lines", F.expr(r"filter(split(text, '\n', -1), l -> l rlike '[^ \\t-\\r]')"))
        .withColumn("n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)"))
        .withColumn("windows", F.expr(f"if(n_words < {k}, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - {k}), i -> xxhash64({window})))"))
        .withColumn("ordered", F.expr("if(size(array_distinct(windows)) = size(windows), null, array_sort(transform(windows, (h, i) -> struct(h as h, i as i))))"))
        .withColumn(
            "starts",
            F.expr(
                "if(ordered is null, null, array_sort(transform(filter(ordered, (x, p) ->"
                " (p > 0 and get(ordered, p - 1).h = x.h) or (p + 1 < size(ordered) and get(ordered, p + 1).h = x.h)), x -> x.i)))"
            ),
        )
        .withColumn(
            "n_repeat_words",
            F.expr(
                f"if(starts is null, 0L, aggregate(starts, struct(0L as n, -1 as upto),"
                f" (a, s) -> struct(a.n + (s + {k} - greatest(s, a.upto + 1)) as n, s + {k - 1} as upto), a -> a.n))"
            ),
        )
        .drop("lines", "windows", "ordered", "starts")
    )
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def _bigram(i: str, j: str) -> str:
    return f"pmod(xxhash64({i}, {j}), {BUCKETS}L)"


def bucket_counts(worded: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, n_raw, n_target over all documents; those whose doc_id is in ``trusted`` (doc_id) are the target.

    Counts are combined in each task before the shuffle.
    """
    ids = materialise(trusted.select(F.col("doc_id").alias("__t")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    grams = F.expr(
        f"concat(transform(hashes, h -> pmod(h, {BUCKETS}L)),"
        f" if(size(hashes) < 2, cast(array() as array<bigint>), transform(sequence(0, size(hashes) - 2), i -> {_bigram('hashes[i]', 'hashes[i + 1]')})))"
    )
    rows = worded.join(ids, F.col("doc_id") == F.col("__t"), "left").select(F.col("__t").isNotNull().alias("good"), F.explode(grams).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n_raw"), F.count(F.when(F.col("good"), 1)).alias("n_target"))


def log_ratios(counts: DataFrame) -> list[float]:
    """log(p_target / p_raw) of every bucket, add-one smoothed; BUCKETS numbers come to the driver."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["n_raw"], r["n_target"]
    if not sum(target):
        return [0.0] * BUCKETS  # no trusted text: the method has no evidence against any document
    n_raw, n_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / n_target) - math.log((r + 1) / n_raw) for r, t in zip(raw, target)]


def mean_log_ratio(weights: list[float]) -> Column:
    w = "cast(split('" + ",".join(repr(round(x, 9)) for x in weights) + "', ',') as array<double>)"
    pair = f"if(i + 1 < size(hashes), get(w, cast({_bigram('hashes[i]', 'hashes[i + 1]')} as int)), 0D)"
    total = f"aggregate(sequence(0, size(hashes) - 1), 0D, (a, i) -> a + get(w, cast(pmod(hashes[i], {BUCKETS}L) as int)) + {pair})".replace("get(w,", f"get({w},")
    return F.expr(f"if(size(hashes) = 0, 0D, {total} / (2 * size(hashes) - 1))")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled good."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def score_documents(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, the base features, base_failed, llr, kept.

    Nulls and texts without a word have no words, fail the base rules and get
    llr 0. Repeated rows are counted and scored as often as they occur. With no
    trusted document every llr is 0 and the base rules alone decide.
    """
    worded = with_words(docs, id_col, text_col)
    weights = log_ratios(bucket_counts(worded.select("doc_id", "hashes"), trusted))
    scored = base_features(worded).withColumn("llr", mean_log_ratio(weights))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr"
    )


def keep_good(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; a score equal to the threshold is kept."""
    weights = log_ratios(bucket_counts(with_words(docs, id_col, text_col).select("doc_id", "hashes"), trusted))
    scored = base_features(with_words(docs, id_col, text_col, carry="__row"))
    verdict = ~F.col("base_failed") & (mean_log_ratio(weights) >= threshold)
    # the row number keeps the filter where it is: pushed below, it would repeat every feature's expression
    judged = scored.select("__row", verdict.alias("__kept"), F.monotonically_increasing_id().alias("__n"))
    return judged.filter("__kept and __n >= 0").select("__row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
