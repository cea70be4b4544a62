"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF of hashed character 1- to 3-grams of the lower-cased text
(anything but letters counts as one blank). Document frequencies cover every
learnable document. The weights are trained by follow-the-regularised-leader
(FTRL-proximal) with an elastic-net penalty on at most TRAIN_DOCS documents (a
documented bound; their sparse vectors, not their texts, come to the driver).
They are shared out evenly over the languages, so a rare one is learned too,
and the biases are set back to the shares of all learnable documents. A
temperature fitted on a fifth of them calibrates the probabilities.

Scoring is one pass without a shuffle: a batch's grams are hashed by numpy and
looked up in one small table (BUCKETS rows, a column a language).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

BUCKETS = 1 << 15
TRAIN_DOCS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: term frequencies are shares of all grams; this brings them to the order of 1
SCALE = 20.0
#: code points worked on at once
CHUNK = 1 << 20
UNKNOWN = "und"


def _tables():
    import numpy as np

    letters = np.zeros(1 << 16, dtype=bool)
    letters[[c for c in range(1 << 16) if chr(c).isalpha()]] = True
    return letters


class Grams:
    """Hashed character grams of batches of texts."""

    def __init__(self):
        self.letters = _tables()

    def codes(self, text: str):
        """Lower-cased code points; every run of other characters is one blank (0)."""
        import numpy as np

        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = c < (1 << 16)
        good = np.where(low, self.letters[np.where(low, c, 0)], True)
        if not low.all():
            odd = np.unique(c[~low])
            good &= ~np.isin(c, [x for x in odd if not chr(x).isalpha()])
        c = np.where(good, c, np.uint32(0))
        if not len(c):
            return c
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return c[keep]

    def buckets(self, c):
        """The buckets of all 1-, 2- and 3-grams starting in c (padded by blanks); three arrays alike in length."""
        import numpy as np

        p = np.concatenate((c, np.zeros(2, dtype=np.uint32))) * np.uint32(0x9E3779B1)
        one = p[:-2]
        two = (one ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + p[1:-1]
        three = (two ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + p[2:]
        shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
        return [(((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift).astype(np.int32) for x in (one, two, three)]

    def of(self, text: str):
        """(bucket arrays) of one text in pieces of bounded size; none if it has no letter."""
        import numpy as np

        c = self.codes(text)
        if not c.any():
            return
        for a in range(0, len(c), CHUNK):
            part = c[a : a + CHUNK + 2]
            got = self.buckets(part)
            n = min(CHUNK, len(c) - a)
            yield np.concatenate([g[:n] for g in got])


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(lang_col).cast("string").alias("lang")] if lang_col else []),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0).alias("held_out"),
    )
    return rows


def document_frequencies(rows: DataFrame):
    """(df array of BUCKETS, number of documents): each task sends one count a bucket into the aggregate."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        grams, df, n = Grams(), np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen = np.zeros(BUCKETS, dtype=bool)
                for g in grams.of(text or ""):
                    seen[g] = True
                df += seen
                n += 1
        found = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(found, -1), "n": np.append(df[found], n)})

    df = np.zeros(BUCKETS, dtype=np.int64)
    total = 0
    for r in rows.select("text").mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, total


def quotas(counts: dict[str, int], limit: int) -> dict[str, int]:
    """How many documents of each language are learned from: equal shares of ``limit``, and what small languages leave goes to the others."""
    out, left = {}, limit
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - k))
        left -= out[lang]
    return out


def training_vectors(rows: DataFrame, limit: int):
    """([(language, buckets, counts)] of at most ``limit`` documents, {language: learnable documents}).

    Of each language the first ids in hash order are taken. Rows beyond about
    twice a language's quota are dropped by their hash before they are ranked,
    so no task ranks more than a few thousand.
    """
    import numpy as np

    ids = rows.select("doc_id", "lang").filter("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    ids = materialise(ids.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 11) / F.lit(float(1 << 53))))
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    quota = quotas(counts, limit)
    if not quota:
        return [], counts
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(x, q, min(1.0, (2 * q + 50) / counts[x])) for x, q in quota.items()], "lang string, quota int, most double"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ids.join(wanted, "lang").filter("h <= most").withColumn("k", F.row_number().over(order)).filter("k <= quota").select("doc_id")

    def vectors(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        grams = Grams()
        for batch in batches:
            out = []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                counts = np.zeros(BUCKETS, dtype=np.int64)
                for g in grams.of(text or ""):
                    counts += np.bincount(g, minlength=BUCKETS)
                b = np.flatnonzero(counts)
                if len(b):
                    out.append((str(doc_id), lang, b.astype("<i4").tobytes(), counts[b].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "buckets", "counts"])

    picked = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "lang")
    made = picked.mapInPandas(vectors, "doc_id string, lang string, buckets binary, counts binary")
    # one row an id, however often the documents repeat it, keeps what is collected bounded
    found = sorted(map(tuple, made.groupBy("doc_id").agg(F.min(F.struct("lang", "buckets", "counts")).alias("m")).select("doc_id", "m.*").collect()))
    return [(lang, np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for _, lang, b, c in found], counts


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(vectors, idf, counts=None, *, epochs: int = EPOCHS, seed: int = 5):
    """(languages, weights BUCKETS x languages, biases, temperature); ``counts`` has how many documents each language really has."""
    import numpy as np

    langs = sorted({v[0] for v in vectors})
    index = {x: i for i, x in enumerate(langs)}
    data = [(b, (c / c.sum() * idf[b] * SCALE), index[lang]) for lang, b, c in vectors]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held = max(1, len(data) // 5) if len(data) >= 10 else 0
    calibration, fit = [data[i] for i in order[:held]], [data[i] for i in order[held:]]
    k = len(langs)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(rows):
        zr = z[rows]
        return np.where(np.abs(zr) <= L1, 0.0, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            b, x, y = fit[i]
            rows, x1 = np.append(b, BUCKETS), np.append(x, 1.0)
            w = weights(rows)
            p = softmax(x1 @ w)
            p[y] -= 1.0
            g = x1[:, None] * p[None, :]
            more = n[rows] + g * g
            z[rows] += g - (np.sqrt(more) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = more
    w = weights(np.arange(BUCKETS + 1))
    temperature = 1.0
    sample = np.bincount([y for *_, y in data], minlength=k) / max(1, len(data))
    share = np.array([float((counts or {}).get(x, 0)) for x in langs])
    share = share / share.sum() if share.all() and k else sample
    bias = w[BUCKETS] + np.log(share / sample) if k else w[BUCKETS]
    if calibration and k > 1:
        logits = np.array([x @ w[b] + bias for b, x, _ in calibration])
        ys = np.array([y for *_, y in calibration])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        as_in_all = (share / sample)[ys]
        loss = [np.average(-np.log(np.maximum(softmax(logits / t)[np.arange(len(ys)), ys], 1e-12)), weights=as_in_all) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return langs, w[:BUCKETS], bias, temperature


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    lang_pred is a language seen in training, 'und' (score 0) if the text is
    null or has no letter, or if there was nothing to learn from. Rows whose
    crc32(doc_id as text) mod 5 is 0 (a null doc_id counts as '') are never
    learned from. ids may be of any type that a string can be cast back to. Repeated rows and ties get equal predictions (of equal
    scores the language first in order wins).
    """
    import numpy as np

    rows = learnable(docs, id_col, text_col, lang_col)
    usable = rows.filter("not held_out and lang is not null and text is not null")
    df, total = document_frequencies(usable)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    vectors, counts = training_vectors(usable, train_docs)
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    if vectors:
        langs, w, bias, temperature = train(vectors, idf, counts)
        scores = np.ascontiguousarray((w * idf[:, None] * SCALE).T.astype(np.float32))
    else:
        langs, scores, bias, temperature = [], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0

    def predict(batches: Iterator) -> Iterator:
        import numpy as np

        grams = Grams()
        for batch in batches:
            preds, probs = [], []
            for text in batch["text"]:
                total, n = np.zeros(len(langs)), 0
                for g in grams.of(text or ""):
                    total += [float(s[g].sum(dtype=np.float64)) for s in scores]
                    n += len(g)
                if not n or not langs:
                    preds.append(UNKNOWN)
                    probs.append(0.0)
                    continue
                p = softmax((total / n + bias) / temperature)
                best = int(np.argmax(p))
                preds.append(langs[best])
                probs.append(float(min(1.0, p[best])))
            batch["lang_pred"], batch["score"] = preds, probs
            yield batch[["doc_id", "held_out", "lang_pred", "score"]]

    plain = rows.select("doc_id", "held_out", "text")
    as_text = plain.withColumn("doc_id", F.col("doc_id").cast("string"))  # nulls stay nulls in pandas
    out = as_text.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
