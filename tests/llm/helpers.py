"""Small awkward tables and brute-force versions."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: columns whose names an operator might use inside
CLASHING = ("uid", "words", "bytes", "html", "name", "level", "block", "label", "n")


def awkward(spark, extra=True):
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (None, "alpha beta", None, "b", None),
        (5, " \t\n ", "en", None, 4),
        (6, "x" * 50_000, "en", "b", 50_000),
        (7, "long text with many words " * 3000, "en", "a", None),
        (8, "eins zwei drei\x00vier fünf — sechs 𝒳 sieben", "de", "c", 9),
        (9, "<|endoftext|> in a text", "en", "c", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit(f"extra {c}"))
    return df


def corpus(seed=0, n=60):
    """Random texts with exact copies, near copies and a shared passage."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 6, 9, 12, 60, 120]))]
            texts.append(" ".join(passage + words if rng.random() < 0.3 else words))
    return [(i * 3 % 101 + i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, k=5):
    w = WORD.findall(lower_ascii(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, sets):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]
