"""Toxicity by multiple-instance learning: sentences explain the document's label.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words; the document's is their noisy-or with a leak,
1 - (1 - leak) * prod(1 - p_sentence). Only document labels are given; the
gradient through the noisy-or tells which sentences earn the label, so the
trained model also locates them.

Trained on at most TRAIN_TOXIC toxic and TRAIN_OTHER other labelled documents
(documented bounds), weighted back to the shares that all labelled documents
have. Their features are counted by a Spark aggregate; only features with enough
evidence, and of each document the sentences that hold one, come to the driver,
so its memory does not grow with the length of texts. Sentences without such a
feature are alike: a document keeps their number. Scoring is one pass without a
shuffle: words are hashed by numpy and looked up in a table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .wordhash import WordHasher, batches_of, joined, letter_table

TRAIN_TOXIC = 2500
TRAIN_OTHER = 5500
#: a word needs this much evidence (likelihood ratio statistic of document labels with and without it) to get a weight
MIN_EVIDENCE = 15.0
ROUNDS = 300
LEARNING_RATE = 0.3
L1 = 1e-5
THRESHOLD = 0.3
#: besides the word itself its first bytes are features, so inflected and compounded forms share what is learned
PREFIXES = (4, 5, 6)
#: bytes that end a sentence
ENDS = b".!?\n"


class Bags:
    """Hashed words and sentences of a batch of texts."""

    def __init__(self):
        self.hasher = WordHasher(letter_table())
        self.ends = np.zeros(256, dtype=bool)
        self.ends[list(ENDS)] = True

    def of(self, texts: list[str]):
        """(feature hashes, sentence of each, document of each sentence, (start, end) bytes of each sentence in its text).

        Sentences are numbered over the batch; every text has at least one. The
        line feed that ``joined`` puts after each text ends its last sentence.
        """
        buf, offsets = joined(texts)
        starts, ends, *hashes = self.hasher.words(buf, PREFIXES)
        stops = np.flatnonzero(self.ends[buf])
        # only a sentence with a word counts; a text without words keeps one empty sentence
        raw = np.searchsorted(stops, starts)
        document = np.searchsorted(offsets, starts, side="right") - 1
        sentences, index = np.unique(raw, return_inverse=True)
        doc_of = document[np.searchsorted(raw, sentences)] if len(raw) else np.zeros(0, np.int64)
        begin = np.where(sentences > 0, stops[np.maximum(sentences - 1, 0)] + 1, 0) if len(raw) else np.zeros(0, np.int64)
        begin = np.maximum(begin, offsets[doc_of])
        end = np.minimum(stops[sentences] + 1, offsets[doc_of + 1] - 1) if len(raw) else np.zeros(0, np.int64)
        longer = [np.flatnonzero(ends - starts > k) for k in PREFIXES]
        index = np.concatenate([index, *[index[x] for x in longer]])
        hashes = (np.concatenate([hashes[0], *[h[x] for h, x in zip(hashes[1:], longer)]]) >> np.uint64(32)).astype(np.uint32)
        return hashes, index, doc_of, (begin - offsets[doc_of], end - offsets[doc_of])


class Model:
    """words: sorted 32-bit feature hashes; weights; bias of a sentence; leak of a document."""

    def __init__(self, words, weights, bias: float, leak: float):
        self.words, self.weights, self.bias, self.leak = words, weights, bias, leak
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[words & np.uint32(0xFFFF)] = True

    def sentence_logits(self, hashes, index, n: int):
        hit = np.flatnonzero(self.sieve[hashes & np.uint32(0xFFFF)])
        z = np.full(n, self.bias)
        if len(self.words) and len(hit):
            at = np.minimum(np.searchsorted(self.words, hashes[hit]), len(self.words) - 1)
            good = self.words[at] == hashes[hit]
            # a word counts once a sentence, however often it is said
            pair = np.unique(index[hit[good]].astype(np.int64) * len(self.words) + at[good])
            z += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], minlength=n)[:n]
        return z

    def score(self, z, doc_of, n_docs: int):
        """Noisy-or of the sentences of each document; a document without words keeps the leak."""
        log_not = np.bincount(doc_of, -np.logaddexp(0.0, z), minlength=n_docs)[:n_docs]
        return np.clip(1.0 - (1.0 - self.leak) * np.exp(log_not), 0.0, 1.0)


def fit(bags: list[tuple], *, rounds: int = ROUNDS, l1: float = L1) -> Model:
    """bags: (label, weight, features, sentence of each from 0, number of sentences without a feature) of each training document."""
    empty = Model(np.zeros(0, np.uint32), np.zeros(0), -50.0, 0.0)
    if not bags:
        return empty
    y = np.array([b[0] for b in bags], dtype=float)
    weight = np.array([b[1] for b in bags], dtype=float)
    weight /= weight.sum()
    if y.min() == y.max():
        empty.leak = float(y @ weight)
        return empty
    bare = np.array([b[4] for b in bags], dtype=float)
    sizes = [int(b[3].max()) + 1 if len(b[3]) else 0 for b in bags]
    first = np.concatenate(([0], np.cumsum(sizes)))
    n_sentences = int(first[-1])
    doc_of = np.repeat(np.arange(len(bags)), sizes)
    words, column = np.unique(np.concatenate([b[2] for b in bags]), return_inverse=True)
    sentence = np.concatenate([b[3] + a for b, a in zip(bags, first)]).astype(np.int64)
    pair = np.unique(sentence * max(1, len(words)) + column)
    sentence, column = pair // max(1, len(words)), pair % max(1, len(words))
    w, g2 = np.zeros(len(words)), np.full(len(words), 1e-8)
    bias, leak_logit = -6.0, float(np.log(0.02 / 0.98))
    b2 = k2 = 1e-8
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
    for _ in range(rounds):
        z = bias + np.bincount(sentence, w[column], minlength=n_sentences)
        leak = sigmoid(leak_logit)
        none = (1.0 - leak) * np.exp(np.bincount(doc_of, -np.logaddexp(0.0, z), minlength=len(bags)) - bare * np.logaddexp(0.0, bias))
        total = np.clip(1.0 - none, 1e-9, 1.0)
        # d loss / d (-log none): 1 for label 0, -(none / total) for label 1
        pull = np.where(y > 0, -none / total, 1.0) * weight
        gz = pull[doc_of] * sigmoid(z)
        gw = np.bincount(column, gz[sentence], minlength=len(words))
        g2 += gw * gw
        step = LEARNING_RATE / np.sqrt(g2)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        gb, gk = gz.sum() + (pull * bare).sum() * sigmoid(bias), (pull * leak).sum()
        b2 += gb * gb
        k2 += gk * gk
        bias -= LEARNING_RATE * gb / np.sqrt(b2)
        leak_logit -= LEARNING_RATE * gk / np.sqrt(k2)
    used = w != 0
    return Model(words[used], w[used], float(bias), float(sigmoid(leak_logit)))


def training_documents(docs: DataFrame, labels: DataFrame, limits: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id as text, text, toxic) of at most ``limits`` toxic and other labelled documents, in hash order of their ids,
    none that is held out, written; and how many have each label. A document labelled twice is toxic if one label says so."""
    usable = (
        labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = [usable.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in zip((1, 0), limits)]
    chosen = first[0].union(first[1]).withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # one row an id, however often the documents repeat it, keeps what is learned from bounded
    return materialise(rows.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min(F.struct("toxic", "text")).alias("m")).select("doc_id", "m.text", "m.toxic")), counts


def features_with_evidence(rows: DataFrame, least: float = MIN_EVIDENCE) -> np.ndarray:
    """The sorted 32-bit features whose documents differ enough in their labels from the others; every feature is counted exactly."""

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        bags = Bags()
        for batch in batches:
            seen = [(np.unique(bags.of([text or ""])[0]), toxic) for text, toxic in zip(batch["text"], batch["toxic"])]
            features = np.concatenate([f for f, _ in seen])
            names, index = np.unique(features, return_inverse=True)
            labels = np.repeat([t for _, t in seen], [len(f) for f, _ in seen])
            yield pd.DataFrame({"feature": names.astype(np.int64), "df": np.bincount(index, minlength=len(names)), "toxic": np.bincount(index, labels, minlength=len(names)).astype(np.int64)})

    sums = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, positives = float(sums["n"]), float(sums["toxic"] or 0)
    if not 0 < positives < n:
        return np.zeros(0, np.uint32)
    counted = rows.select("text", "toxic").mapInPandas(count, "feature bigint, df bigint, toxic bigint").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))

    def log_likelihood(k, m):
        q = F.least(F.greatest(k / F.greatest(m, F.lit(1e-12)), F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(q) + (m - k) * F.log(1 - q)

    rest = log_likelihood(positives - F.col("toxic"), n - F.col("df"))
    statistic = 2 * (log_likelihood(F.col("toxic"), F.col("df")) + rest - log_likelihood(F.lit(positives), F.lit(n)))
    return np.sort(np.array([r["feature"] for r in counted.filter(statistic >= least).select("feature").collect()], dtype=np.uint32))


def training_bags(docs: DataFrame, labels: DataFrame, limits: tuple[int, int], id_col: str, text_col: str) -> list[tuple]:
    """What ``fit`` learns from: (label, weight, features, sentence of each, sentences without one) of each training document."""
    rows, counts = training_documents(docs, labels, limits, id_col, text_col)
    weights = {t: counts.get(t, 0) / max(1, min(counts.get(t, 0), n)) for t, n in zip((1, 0), limits)}
    features = features_with_evidence(rows)

    def hashed(batches: Iterator) -> Iterator:
        import pandas as pd

        bags = Bags()
        for batch in batches:
            out = []
            for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"]):
                h, s, doc_of, _ = bags.of([text or ""])
                good = np.isin(h, features)
                held, index = np.unique(s[good], return_inverse=True)
                out.append((doc_id, int(toxic), h[good].astype("<u4").tobytes(), index.astype("<i4").tobytes(), max(1, len(doc_of)) - len(held)))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "words", "sentences", "bare"])

    made = rows.mapInPandas(hashed, "doc_id string, toxic int, words binary, sentences binary, bare bigint")
    return [(t, weights[t], np.frombuffer(w, "<u4"), np.frombuffer(s, "<i4"), n) for _, t, w, s, n in sorted(map(tuple, made.collect()))]


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, score, worst (start and end of the likeliest sentence), in bytes of the text's UTF-8.

    Nulls and texts without words score the leak and have a null worst
    sentence. Repeated rows score alike; of equal sentences the first is named.
    """
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        bags = Bags()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            scores, begins, ends, best = [], [], [], []
            for a, b in batches_of(texts):
                hashes, index, doc_of, (begin, end) = bags.of(texts[a:b])
                z = model.sentence_logits(hashes, index, len(doc_of))
                scores.append(model.score(z, doc_of, b - a))
                top = np.full(b - a, -1, dtype=np.int64)
                order = np.lexsort((-np.arange(len(z)), z))  # the last one set is the largest, of equals the first
                top[doc_of[order]] = order
                for k in top:
                    begins.append(int(begin[k]) if k >= 0 else None)
                    ends.append(int(end[k]) if k >= 0 else None)
                    best.append(float(1.0 / (1.0 + np.exp(-z[k]))) if k >= 0 else None)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].to_numpy(), "score": np.concatenate(scores) if scores else [], "worst_start": pd.array(begins, "Int64"), "worst_end": pd.array(ends, "Int64"), "worst_score": pd.array(best, "Float64")}
            )

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, "doc_id string, score double, worst_start bigint, worst_end bigint, worst_score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def toxicity(docs: DataFrame, labels: DataFrame, *, limits: tuple[int, int] = (TRAIN_TOXIC, TRAIN_OTHER), threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, worst_start, worst_end, worst_score per row of ``docs``.

    Labels of rows whose crc32(doc_id as text) mod 4 is 2 (a null doc_id counts
    as '') are never learned. Without labels every score is 0.
    """
    model = fit(training_bags(docs, labels, limits, id_col, text_col))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return score_texts(docs, model, id_col=id_col, text_col=text_col).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score"
    )


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
