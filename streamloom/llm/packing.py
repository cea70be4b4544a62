"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised once (Arrow batches), cut into pieces of at most
``capacity`` tokens, and only the pieces' lengths are packed. Full pieces are
a sequence each. The rest is dealt by hash into blocks of about ``block_items``
pieces. Every block is evolved by several islands (separate tasks with other
seeds); between epochs the islands of a block pass their elite round a ring by
one small shuffle. A chromosome is a list of bins (the groups): crossover
injects the other parent's best-filled bins whole, dissolves the bins that
hold duplicates of what came in, and best-fits the displaced pieces; mutation
dissolves some badly filled bins. Islands start from packings in shaken orders
and evolve for GENERATIONS an epoch, or until a packing meets the lower bound:
that is proven optimal. In the last epoch plain best-fit decreasing joins the
crowd of an island that is not there yet, so no block is packed worse than so.

Blocks keep every task bounded. What blocking wastes is won back by levels:
bins with more than ``slack`` free tokens of all blocks are pooled, dealt anew
(whole bins, so the old packing is among the parents and no level can make it
worse) and evolved again, until one block holds them or the pool hardly shrinks.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

CAPACITY = 2048
END_ID = 0
BLOCK_ITEMS = 16_384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 60
POPULATION = 6
#: another level must pool at most this share of the pieces before it
SHRINK = 0.9
SLACK = 0
VOCABULARY = "byte_bpe_50k.json"
#: the same vocabulary as ranks: a faster reader of it that gives the same ids
RANKS = "byte_bpe_50k.tiktoken"
#: runs without white space beyond this go to the reference tokenizer, which is not quadratic in them
LONG_RUN = 20_000


class Encoder:
    """ids of the byte-level BPE vocabulary, as tokenizers gives them with add_special_tokens=False."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        self.run = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
        self.slow = None

    def encode(self, text: str):
        import numpy as np

        if "<|" in text or (len(text) >= LONG_RUN and self.run.search(text)):
            if self.slow is None:
                import os

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, s + capacity) for s in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every row's ids then END_ID, cut to pieces."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        encoder = Encoder(vocabulary, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encoder.encode(text), np.uint32(END_ID)).astype("<u4")
                for piece, (a, b) in enumerate(piece_bounds(len(ids), capacity)):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": object} if id_type not in ("bigint", "int") or batch["doc_id"].isna().any() else {})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- one block: plain Python on lists of bins --------------------------------------------------


def lower_bound(lengths: list[int], capacity: int) -> int:
    """The larger of the volume bound and the bounds that pair large pieces with medium ones."""
    best = -(-sum(lengths) // capacity)
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    volume = [0] * (capacity + 2)
    number = [0] * (capacity + 2)
    for x in range(capacity, -1, -1):
        volume[x], number[x] = volume[x + 1] + x * count[x], number[x + 1] + count[x]
    half = capacity // 2
    for k in range(1, half + 1):
        huge = number[capacity - k + 1]
        large = number[half + 1] - huge
        free = large * capacity - (volume[half + 1] - volume[capacity - k + 1])
        medium = volume[k] - volume[half + 1]
        best = max(best, huge + large + max(0, -(-(medium - free) // capacity)))
    return best


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Puts items, in the given order, each into the fullest bin that can hold it; changes bins and free.

    Bins are kept by their free space; a bit mask finds the smallest free space
    that suffices in one step.
    """
    by_free: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(free):
        if f:
            by_free.setdefault(f, []).append(b)
            mask |= 1 << f
    for i in items:
        x = lengths[i]
        found = mask >> x
        if found:
            f = x + (found & -found).bit_length() - 1
            stack = by_free[f]
            b = stack.pop()
            if not stack:
                mask ^= 1 << f
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[b] = f = f - x
        if f:
            stack = by_free.setdefault(f, [])
            if not stack:
                mask |= 1 << f
            stack.append(b)


def fitness(free: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square fill): larger is better."""
    return -len(free), sum((capacity - f) ** 2 for f in free) / max(1, len(free))


def crossover(a, b, lengths, capacity, rng):
    """Injects the best-filled bins of b, whole, into a; what they displace is best-fitted."""
    (bins_a, free_a), (bins_b, free_b) = a, b
    order = sorted(range(len(bins_b)), key=free_b.__getitem__)
    want = max(1, int(len(order) * rng.uniform(0.2, 0.6)))
    lo = rng.randrange(max(1, len(order) - want) // 2 + 1)
    inject = order[lo : lo + want]
    inside = set()
    for k in inject:
        inside.update(bins_b[k])
    bins = [list(bins_b[k]) for k in inject]
    free = [free_b[k] for k in inject]
    displaced = []
    for k, own in enumerate(bins_a):
        if inside.isdisjoint(own):
            bins.append(list(own))
            free.append(free_a[k])
        else:
            displaced += [i for i in own if i not in inside]
    displaced.sort(key=lengths.__getitem__, reverse=True)
    best_fit(displaced, lengths, bins, free, capacity)
    return bins, free


def mutate(a, lengths, capacity, rng):
    """Dissolves the emptiest bins and a few others; best-fits their pieces in a shaken order."""
    bins, free = a
    order = sorted(range(len(bins)), key=free.__getitem__, reverse=True)
    n = max(2, len(bins) // 50)
    gone = set(order[:n]) | set(rng.sample(range(len(bins)), min(len(bins), n)))
    kept = [list(bins[k]) for k in range(len(bins)) if k not in gone]
    left = [free[k] for k in range(len(bins)) if k not in gone]
    items = [i for k in gone for i in bins[k]]
    shake = rng.choice((0.1, 0.3, 0.9))
    items.sort(key=lambda i: lengths[i] * rng.uniform(1 - shake, 1 + shake), reverse=True)
    best_fit(items, lengths, kept, left, capacity)
    return kept, left


def from_assignment(assignment, lengths, capacity):
    by_label: dict[int, list[int]] = {}
    for i, label in enumerate(assignment):
        by_label.setdefault(label, []).append(i)
    bins = list(by_label.values())
    return bins, [capacity - sum(lengths[i] for i in b) for b in bins]


def to_assignment(bins, n: int) -> list[int]:
    out = [0] * n
    for b, own in enumerate(bins):
        for i in own:
            out[i] = b
    return out


def evolve(lengths: list[int], capacity: int, parents: list[list[int]], seed: int, generations: int, population: int, best_fit_joins: bool = True) -> tuple[list[int], int]:
    """The best packing an island finds, as the bin of each piece, and the generations it took; deterministic in its arguments."""
    n = len(lengths)
    if not n:
        return [], 0
    rng = random.Random(seed)
    bound = lower_bound(lengths, capacity)
    crowd = [from_assignment(p, lengths, capacity) for p in parents]

    def packed(noise: float):
        order = sorted(range(n), key=(lambda i: lengths[i] * rng.uniform(1 - noise, 1 + noise)) if noise else lengths.__getitem__, reverse=True)
        bins: list[list[int]] = []
        free: list[int] = []
        best_fit(order, lengths, bins, free, capacity)
        return bins, free

    score = lambda s: fitness(s[1], capacity)
    met = lambda: any(len(s[0]) <= bound for s in crowd)
    while len(crowd) < population and not met():
        crowd.append(packed(rng.uniform(0.05, 0.5)))
    if best_fit_joins and not met():
        crowd.append(packed(0.0))
    ran = 0
    while ran < generations and not met():
        crowd.sort(key=score, reverse=True)
        a, b = rng.sample(crowd[: max(2, len(crowd) // 2)], 2) if len(crowd) > 1 else (crowd[0], crowd[0])
        children = [crossover(a, b, lengths, capacity, rng), mutate(crowd[0], lengths, capacity, rng)]
        crowd = sorted(crowd + children, key=score, reverse=True)[:population]
        ran += 1
    return to_assignment(max(crowd, key=score)[0], n), ran


# --- blocks and islands on Spark ----------------------------------------------------------------


def _evolved(rows: DataFrame, capacity: int, epoch: int, generations: int, population: int, last: bool) -> DataFrame:
    """rows: block, island, lengths, parents (assignments) -> the same with parents = [elite], its bins, and the generations that ran."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for block, island, lengths, parents in zip(batch["block"], batch["island"], batch["lengths"], batch["parents"]):
                lengths = [int(x) for x in lengths]
                parents = [[int(x) for x in p] for p in parents]
                best, ran = evolve(lengths, capacity, parents, hash((int(block), int(island), epoch)), generations, population, last)
                out.append((block, island, lengths, [best], max(best, default=-1) + 1, ran))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "parents", "bins", "generations"])

    return rows.mapInPandas(run, "block bigint, island int, lengths array<int>, parents array<array<bigint>>, bins int, generations int")


def _packed_blocks(items: DataFrame, n_blocks: int, *, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """items: uid, length, block, bin (null or an old packing) -> uid, length, block, bin, offset, free."""
    blocks = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("length", "uid", "bin"))).alias("m"))
    blocks = materialise(
        blocks.select("block", F.expr("transform(m, x -> x.uid)").alias("uids"), F.expr("transform(m, x -> cast(x.length as int))").alias("lengths"), F.expr("transform(m, x -> x.bin)").alias("old"))
    )
    parents = F.expr("if(old[0] is null, cast(array() as array<array<bigint>>), array(old))")
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", parents.alias("parents"))
    tasks = max(1, min(2048, n_blocks * islands))
    for epoch in range(epochs):
        state = _evolved(state.repartition(tasks, "block", "island"), capacity, epoch, generations, population, epoch + 1 == epochs)
        if epoch + 1 < epochs:
            ring = state.groupBy("block").agg(F.first("lengths").alias("lengths"), F.array_sort(F.collect_list(F.struct("island", F.col("parents")[0].alias("elite")))).alias("elites"))
            state = ring.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", "elites").select(
                "block", "island", "lengths", F.expr(f"array_distinct(array(elites[island].elite, elites[(island + {islands - 1}) % {islands}].elite))").alias("parents")
            )
    best = state.groupBy("block").agg(F.min(F.struct("bins", "island", F.col("parents")[0].alias("elite"))).alias("best"))

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for block, uids, lengths, elite in zip(batch["block"], batch["uids"], batch["lengths"], batch["elite"]):
                fill: dict[int, int] = {}
                offsets = []
                for b, x in zip(elite, lengths):
                    offsets.append(fill.get(b, 0))
                    fill[b] = offsets[-1] + int(x)
                yield pd.DataFrame({"uid": uids, "length": lengths, "block": int(block), "bin": elite, "offset": offsets, "free": [capacity - fill[b] for b in elite]})

    return blocks.join(best.select("block", "best.elite"), "block").select("block", "uids", "lengths", "elite").mapInPandas(place, "uid bigint, length bigint, block bigint, bin bigint, offset bigint, free bigint")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, slack: int = SLACK, **tokeniser) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document of its own, also if it repeats another;
    a null or empty text is the single END_ID. Other columns are not read. An
    empty table gives no rows. Pieces lie in a sequence without gaps from 0.
    """
    pieces = materialise(tokenised_pieces(docs, capacity=capacity, **tokeniser).withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("length") == capacity).selectExpr("uid", "-1 - uid as sequence_id", "0L as offset")
    items = pieces.filter(F.col("length") < capacity).select("uid", "length", F.lit(None).cast("bigint").alias("bin"), F.col("uid").alias("deal"))
    placed = [full]
    n, before, level = items.count(), None, 0
    while n:
        n_blocks = -(-n // block_items)
        dealt = items.withColumn("block", F.pmod(F.xxhash64("deal", F.lit(level)), F.lit(n_blocks))).select("uid", "length", "block", "bin")
        packed = materialise(_packed_blocks(dealt, n_blocks, capacity=capacity, islands=islands, epochs=epochs, generations=generations, population=population))
        # 24 bits for the bin in its block are enough: a block has about block_items pieces
        sequence = F.expr(f"shiftleft({level + 1}L, 56) + shiftleft(block, 24) + bin")
        last = n_blocks == 1 or (before is not None and n > SHRINK * before)
        packed = packed.withColumn("sequence_id", sequence)
        placed.append((packed if last else packed.filter(F.col("free") <= slack)).select("uid", "sequence_id", "offset"))
        if last:
            break
        items = packed.filter(F.col("free") > slack).select("uid", "length", F.col("sequence_id").alias("bin"), F.col("sequence_id").alias("deal"))
        n, before, level = items.count(), n, level + 1
    where = placed[0]
    for part in placed[1:]:
        where = where.union(part)
    return pieces.join(where, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
