"""The n-gram Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, components, corpus, shingle_set

from streamloom.llm import components as component_steps
from streamloom.llm import jaccard
from streamloom.llm.components import components as distributed


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    return Counter(zip([d for d, _ in rows], map(len, sets), components([d for d, _ in rows], sets)))


def found(df, **options):
    return Counter(map(tuple, jaccard.jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize("seed, options", [(0, {}), (1, {"cell_classes": 3}), (2, {"cell_shingles": 200, "bucket_bytes": 300}), (3, {"cell_classes": 1, "hub_classes": 2})])
def test_components_equal_all_pairs(spark, seed, options):
    df = spark.createDataFrame(corpus(seed, 120), SCHEMA).repartition(5)
    assert found(df, **options) == expected([(r["doc_id"], r["text"]) for r in df.collect()])


def test_awkward_rows(spark, monkeypatch):
    df = awkward(spark)
    want = expected([(r["doc_id"], r["text"]) for r in df.collect()])
    assert found(df) == want
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)  # survivors by a shuffled join
    assert found(df) == want
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    kept = jaccard.keep_representatives(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, None, 5, 6, 7, 8, 9])


def test_rows_without_ids_are_kept_apart(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, text), (None, text), (None, "another text that has nothing to do with it"), (None, ""), (None, None)], "doc_id bigint, text string")
    assert Counter(r["text"] for r in jaccard.keep_representatives(df).collect()) == Counter([text, "another text that has nothing to do with it", "", None])


def test_borderline_pairs_around_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k, n in enumerate((5, 6, 7, 8, 9, 11, 12, 13, 30, 57)):
        own = words[k * 7 : k * 7 + n + 4]
        rows.append((len(rows), " ".join(own)))
        for cut in range(1, n // 2):
            rows.append((len(rows), " ".join(own[cut:])))
            rows.append((len(rows), " ".join(own[:-cut])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == expected(rows)


def test_a_large_family_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, cell_classes=40) == expected(rows)


def test_boundary_and_subsets():
    for n in range(1, 13):
        for a in range(-(-3 * n // 4), n + 1):  # the smaller partner's size
            least = -(-3 * (a + n) // 7)
            assert any(c <= least for c in jaccard.subset_sizes(n)) and -(-6 * a // 7) in jaccard.subset_sizes(n)
    assert jaccard.choose_boundary({}, 9) == 0 and jaccard.choose_boundary({4: (10, 10)}, 9) == 0 and jaccard.choose_boundary({4: (10, 5000), 30: (9, 9)}, 9) >= 5
    assert jaccard.largest_light(0) == 0 and jaccard.light_cost(jaccard.largest_light(1000)) <= 1000 * jaccard.prefix_length(jaccard.largest_light(1000))
    assert len(jaccard.subset_keys(np.arange(7), 7)) == jaccard.light_cost(7) and len(jaccard.subset_keys(np.arange(5), 7)) < jaccard.light_cost(7)


def test_the_cost_makes_small_sets_with_long_lists_light(spark, monkeypatch):
    """A common beginning of seven words and one of its own: their lists are long, and one short text links with all."""
    rng = random.Random(4)
    rows = [(i, f"the quick brown fox jumps over it w{i}") for i in range(300)] + [(900, "the quick brown fox jumps over it")]
    rows += [(1000 + i, " ".join(f"u{i}x{rng.randrange(40)}" for j in range(60))) for i in range(20)] + [(2000, "a quick brown fox jumps over it w1")]
    chosen = []
    choose = jaccard.choose_boundary
    monkeypatch.setattr(jaccard, "choose_boundary", lambda by_size, largest: chosen.append(choose(by_size, largest)) or chosen[-1])
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == expected(rows) and got[(299, 4, 0)] == 1
    assert chosen[0] > 4  # sets of four shingles are in no list: their links come from subsets alone


@pytest.mark.parametrize("boundary", [0, 4, 8])
def test_any_boundary_gives_the_same_result(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "choose_boundary", lambda by_size, largest: boundary)
    words = "a b c d e f g h i j k l m n".split()
    rows = [(i, " ".join(words[a:b])) for i, (a, b) in enumerate((a, b) for a in range(4) for b in range(a + 4, 15))]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


def test_distributed_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = dict(map(tuple, distributed(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert distributed(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(
    "edges",
    [[(5, 1), (6, 1), (1, 7)], [(1, 2), (2, 3)], [(3, 1), (3, 2)], [(1, 1), (4, 2), (2, 4), (4, 2)], [(9, 8), (8, 7), (7, 9), (2, 9)]],
    ids=["star", "chain", "two smaller neighbours", "loops and repeated edges", "cycle"],
)
def test_components_of_small_graphs(spark, edges):
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(tuple, distributed(spark.createDataFrame(edges, "a bigint, b bigint")).collect())) == [(x, root[x]) for x in nodes]


def test_small_steps_of_the_search_for_components_write_few_files(spark, monkeypatch):
    files, write = [], component_steps.materialise

    def counted(df, keep=False):
        out = write(df, keep)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(component_steps, "materialise", counted)
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, ["64", "false"]):
            spark.conf.set(k, v)
        got = distributed(spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")).collect()
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(301)]
    assert files and max(files) <= max(spark.sparkContext.defaultParallelism, 64 // 8)
