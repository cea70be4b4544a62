"""N-gram Jaccard join: a size-aware heavy-light join of 5-word shingle sets.

Two sets link if 100 * |A n B| >= 75 * |A u B|. Then each holds at least 75 %
of its shingles in common with another document. The steps:

1. Shared shingles. Every task hashes its documents (numpy), combines equal
   shingles of a block of documents, and sends each distinct one once, packed
   to a few bytes, to the bucket of its hash. A bucket answers which were sent
   by more than one block. So every document learns how many of its shingles
   occur elsewhere; fewer than 75 % means that it links with nothing. This is
   a lossless filter, and what it sends grows linearly with the input.
2. Copies. Documents with the same set become one class.
3. Keys of the classes' sets, rare shingles first (by their number of classes):
   light sets, of at most ``boundary`` shingles, enumerate their subsets of
   the fixed sizes that a link must share; heavy sets are looked up in the
   inverted lists of the shingles in their prefix (the n - ceil(0.75 n) + 1
   rarest: two linked sets share one of them). The boundary is the one of
   least cost by the measured lengths of the lists that sets of each size read.
4. Hubs: of each key's classes the one with the least number is its hub. Every
   class is compared with the HUBS least hubs of its keys first, in tasks of
   bounded size, which joins most near copies without listing their pairs.
5. Cells: the classes of one least hub are a cell (several, if they are many).
   Two cells meet in a task if they share a key whose classes are not yet all
   joined, and only classes with such a key go there. In a task a class is
   compared only with key-sharing classes that its component has not reached.
   Every comparison is exact on the whole sets.
6. Components of the links found, spread to the copies.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialise, numbered, table, temporary
from .components import components
from .wordhash import WordHasher, batches_of, blank_table, joined, mix

WIDTH = 5
#: shingles in a block of documents, and documents in it (two bytes number them)
BLOCK_SHINGLES = 1 << 19
BLOCK_DOCS = 60_000
#: survivors of the filter up to which their ids are broadcast (8 bytes each) rather than joined by a shuffle
BROADCAST_IDS = 1_000_000
#: UTF-8 bytes of text whose shingles share a bucket of step 1
BUCKET_BYTES = 8 << 20
#: classes, and shingles, of a cell, and of a task that compares with one hub
CELL_CLASSES = 200
CELL_SHINGLES = 1_000_000
HUB_CLASSES = 250
#: hubs that a class is compared with before cells meet
HUBS = 4

_STEP = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width, self.hasher = width, WordHasher(blank_table(lower_ascii=True))

    def of(self, texts: list[str]):
        """(hash, index of its text) of every shingle, repeated ones too, in text order."""
        buf, offsets = joined(texts)
        starts, _, words = self.hasher.words(buf)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        count = np.bincount(doc, minlength=len(texts))
        n, k = len(words), self.width
        full = np.zeros(0, dtype=np.uint64)
        owner = np.zeros(0, dtype=np.int64)
        if n >= k:
            full = np.zeros(n - k + 1, dtype=np.uint64)
            for j in range(k):
                full += words[j : n - k + 1 + j] * _STEP[j]
            whole = doc[: n - k + 1] == doc[k - 1 :]
            full, owner = mix(full[whole]), doc[: n - k + 1][whole]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):  # the whole sequence of words is the one shingle
            first = np.concatenate(([0], np.cumsum(count)))
            extra = [np.sum(words[first[d] : first[d + 1]] * _STEP[: count[d]], dtype=np.uint64) + np.uint64(count[d]) for d in short]
            full, owner = np.concatenate([full, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([owner, short])
        return full, owner

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        out = []
        for a, b in batches_of(texts):
            h, owner = self.of(texts[a:b])
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[new], owner[new]
            cut = np.searchsorted(owner, np.arange(b - a + 1))
            out += [h[cut[i] : cut[i + 1]] for i in range(b - a)]
        return out


# --- step 1: how many shingles of each document occur elsewhere ---------------------------------


def _pack(fp: np.ndarray, doc: np.ndarray) -> bytes:
    """Sorted 32-bit fingerprints and 16-bit document numbers in about 4.3 bytes each."""
    d = np.diff(fp.astype(np.int64), prepend=0)
    return (d & 0xFFFF).astype("<u2").tobytes() + doc.astype("<u2").tobytes() + zlib.compress((d >> 16).astype("<u2").tobytes(), 1)


def _unpack(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = np.frombuffer(raw, "<u2", n).astype(np.int64)
    doc = np.frombuffer(raw, "<u2", n, 2 * n)
    high = np.frombuffer(zlib.decompress(raw[4 * n :]), "<u2").astype(np.int64)
    return np.cumsum(low + (high << 16)), doc


def shared_counts(docs: DataFrame, buckets: int, parts: int, width: int = WIDTH) -> DataFrame:
    """docs: uid, doc_id, text -> uid, doc_id, n_shingles, n_shared (shingles that another document may hold).

    ``buckets`` grows with the text, so that a bucket fits a Python worker and
    its 32-bit fingerprints hardly collide; they are dealt evenly to ``parts`` tasks.

    n_shared never counts too few; by collisions of fingerprints it may count a
    few too many, which only weakens the filter.
    """

    def send(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        shingler = Shingler(width)
        part, blocks = TaskContext.get().partitionId(), itertools.count()
        columns = ["bucket", "block", "n", "packed", "docs"]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        uids: list = []
        ids: list = []
        size = 0

        def flush():
            nonlocal held, uids, ids, size
            block = (part << 32) | next(blocks)
            h = np.concatenate([x[0] for x in held])
            doc = np.concatenate([x[1] for x in held])
            m = len(uids)
            order = np.argsort(h, kind="stable")  # equal hashes stay in document order
            h, doc = h[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            n_set = np.bincount(doc, minlength=m)
            first = np.ones(len(h), dtype=bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            repeated = (np.bincount(group) > 1)[group] if len(h) else np.zeros(0, bool)
            local = np.bincount(doc[repeated], minlength=m)
            # of a shingle that several documents of the block hold, one entry goes out, for nobody (number m)
            doc = np.where(repeated, m, doc)[first]
            h = h[first]
            # h * buckets / 2**32 keeps the order of h: its upper part is the bucket, its lower 32 bits the fingerprint there
            spread = (h >> np.uint64(32)) * np.uint64(buckets) + (((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32))
            bucket = (spread >> np.uint64(32)).astype(np.int64)
            fp = spread & np.uint64(0xFFFFFFFF)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(k, block, int(b - a), _pack(fp[a:b], doc[a:b]), None) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            meta = np.array(uids, dtype="<i8").tobytes() + n_set.astype("<i8").tobytes() + local.astype("<i8").tobytes()
            rows.append((block % buckets, block, -m, meta, [None if x is None else str(x) for x in ids]))
            held, uids, ids, size = [], [], [], 0
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of(texts):
                for a, b in ((x, min(b, x + BLOCK_DOCS)) for x in range(a, b, BLOCK_DOCS)):
                    if uids and len(uids) + b - a > BLOCK_DOCS:
                        yield flush()
                    h, owner = shingler.of(texts[a:b])
                    held.append((h, owner + len(uids)))
                    uids += batch["uid"].iloc[a:b].tolist()
                    ids += batch["doc_id"].iloc[a:b].tolist()
                    size += len(h)
                    if size >= BLOCK_SHINGLES:
                        yield flush()
        if uids:
            yield flush()

    def answer(batches: Iterator) -> Iterator:
        import pandas as pd

        for bucket in _groups(batches, ["bucket"]):
            sent = bucket[bucket["n"] > 0]
            parts = [_unpack(n, p) for n, p in zip(sent["n"], sent["packed"])]
            out = [(r.block, r.n, r.packed, r.docs) for r in bucket[bucket["n"] <= 0].itertuples()]
            if parts:
                every = np.sort(np.concatenate([p[0] for p in parts]))
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                for block, (fp, doc) in zip(sent["block"], parts):
                    if len(twice):
                        at = np.minimum(np.searchsorted(twice, fp), len(twice) - 1)
                        found = np.bincount(doc[twice[at] == fp])
                        if found.any():
                            out.append((block, 0, zlib.compress(found.astype("<i4").tobytes(), 1), None))
            yield pd.DataFrame(out, columns=["block", "n", "packed", "docs"])

    def total(batches: Iterator) -> Iterator:
        import pandas as pd

        for block in _groups(batches, ["block"]):
            meta = block[block["n"] < 0].iloc[0]
            m = -meta["n"]
            uid, n_set, shared = (np.frombuffer(meta["packed"], "<i8", m, 8 * m * i) for i in range(3))
            shared = shared.copy()
            for raw in block.loc[block["n"] == 0, "packed"]:
                found = np.frombuffer(zlib.decompress(raw), "<i4")[:m]  # without the entries for nobody
                shared[: len(found)] += found
            yield pd.DataFrame({"uid": uid, "doc_id": list(meta["docs"]), "n_shingles": n_set, "n_shared": shared})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(send, "bucket int, block bigint, n int, packed binary, docs array<string>")
    answered = sent.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInPandas(answer, "block bigint, n int, packed binary, docs array<string>")
    totals = answered.repartition("block").sortWithinPartitions("block").mapInPandas(total, "uid bigint, doc_id string, n_shingles bigint, n_shared bigint")
    return totals.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _groups(batches: Iterator, keys: list[str]) -> Iterator:
    """Frames of equal keys from batches that come sorted by them; one group is in memory at a time."""
    import pandas as pd

    held: list = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys]
        change = np.flatnonzero((values.iloc[1:].to_numpy() != values.iloc[:-1].to_numpy()).any(axis=1)) + 1 if len(batch) > 1 else np.zeros(0, int)
        for a, b in zip(np.concatenate(([0], change)), np.concatenate((change, [len(batch)]))):
            part = batch.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


# --- step 2: sets and classes --------------------------------------------------------------------


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    """uid, text -> uid, n, s1, s2 (128 bits that name the set), hashes."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        shingler = Shingler(width)
        for batch in batches:
            texts, uids = batch["text"].tolist(), batch["uid"].tolist()
            for a, b in batches_of(texts):  # small frames: a set takes more room than its text
                out = []
                for uid, s in zip(uids[a:b], shingler.sets(texts[a:b])):
                    lo, hi = mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                    out.append((uid, len(s), int(lo.astype(np.int64)), int(hi.astype(np.int64)), s.astype("<i8")))
                yield pd.DataFrame(out, columns=["uid", "n", "s1", "s2", "hashes"])

    return docs.select("uid", "text").mapInPandas(run, "uid bigint, n int, s1 bigint, s2 bigint, hashes array<bigint>")


# --- step 3: keys ---------------------------------------------------------------------------------


def subset_sizes(n: int) -> list[int]:
    """Sizes c such that a set of n shingles and a linked set, the smaller having a, share at least c = ceil(6 a / 7)."""
    return sorted({-(-6 * a // 7) for a in range(-(-3 * n // 4), n + 1)})


def prefix_length(n: int) -> int:
    return n - (-(-3 * n // 4)) + 1


def light_cost(n: int) -> int:
    """How many subsets a light set of n shingles enumerates."""
    return sum(comb(n, c) for c in subset_sizes(n))


def largest_light(longest_list: int) -> int:
    """No boundary beyond this can be of least cost: there, reading even the longest list for each prefix shingle is cheaper."""
    n = 0
    while light_cost(n + 1) <= prefix_length(n + 1) * longest_list:
        n += 1
    return n


def choose_boundary(by_size: dict[int, tuple[int, int]], largest: int) -> int:
    """The size up to which enumerating subsets costs least; ``by_size`` has of each size the number of sets and of the entries in the lists they read.

    A light set that may link with a heavy one (from 3/4 of the least heavy size) reads its lists too.
    """
    best = (0, 0)
    for boundary in range(1, largest + 1):
        light = sum(light_cost(n) * sets for n, (sets, _) in by_size.items() if n <= boundary)
        spared = sum(entries for n, (_, entries) in by_size.items() if 4 * n < 3 * (boundary + 1))
        best = min(best, (light - spared, boundary))
    return best[1]


def subset_keys(hashes: np.ndarray, n: int) -> list[int]:
    """One 64-bit key for each subset of the fixed sizes that a set of n shingles, of which ``hashes`` occur elsewhere, may share."""
    h = [int(x) for x in mix(hashes.astype(np.uint64))]
    mask = (1 << 64) - 1
    out = []
    for c in subset_sizes(n):
        out += [(sum(s) * 0x9E3779B97F4A7C15 + c) & mask for s in itertools.combinations(h, c)]
    return np.array(out, dtype=np.uint64).astype(np.int64).tolist()


def class_keys(classes: DataFrame) -> DataFrame:
    """classes: rep, n, hashes -> rep, keys: what linked sets share at least one of."""
    postings = classes.select("rep", "n", F.explode("hashes").alias("h"))
    # written, so that the join reads two plain shuffles and a very common shingle is split
    df = materialise(postings.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    common = postings.join(df, "h").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("common"))
    # the shingles that only this class holds come first in the prefix and are in no list
    left = F.expr("(n - cast(ceil(0.75 * n) as int) + 1) - (n - size(common))")
    able = materialise(common.withColumn("left", left).filter("left > 0"))
    largest = largest_light(df.agg(F.max("df")).first()[0] or 0)
    sizes = able.filter(F.col("n") <= largest).groupBy("n").agg(F.count("*").alias("sets"), F.sum(F.expr("aggregate(slice(common, 1, left), 0L, (a, x) -> a + x.df)")).alias("entries"))
    boundary = choose_boundary({r["n"]: (r["sets"], r["entries"]) for r in sizes.collect()}, largest)  # a row a small size
    lists = able.filter(4 * F.col("n") >= 3 * (boundary + 1)).select("rep", F.expr("transform(slice(common, 1, left), x -> x.h)").alias("keys"))
    if not boundary:
        return lists

    def enumerate_(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["keys"] = [subset_keys(np.asarray(h), n) for h, n in zip(batch["hashes"], batch["n"])]
            yield batch[["rep", "keys"]]

    light = able.filter(F.col("n") <= boundary).select("rep", "n", F.expr("transform(common, x -> x.h)").alias("hashes")).mapInPandas(enumerate_, "rep bigint, keys array<bigint>")
    return lists.union(light).groupBy("rep").agg(F.flatten(F.collect_list("keys")).alias("keys"))


# --- steps 4 and 5: links -------------------------------------------------------------------------


def linked(a: int, b: int, both):
    return 100 * both >= 75 * (a + b - both)


def links_of(base: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Of each other set whether it links with ``base``; sets are sorted, distinct and not empty."""
    sizes = np.array([len(s) for s in others], dtype=np.int64)
    flat = np.concatenate(others)
    hit = base[np.minimum(np.searchsorted(base, flat), len(base) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return linked(len(base), sizes, both)


def _sorted_set(hashes) -> np.ndarray:
    return np.sort(np.asarray(hashes, dtype=np.int64))


def hub_links(classes: DataFrame, members: DataFrame) -> DataFrame:
    """members: rep, hub, n_tasks (tasks that share the hub's members) -> (a, b): members that link with their hub."""
    task = F.pmod(F.xxhash64("rep"), F.col("n_tasks")).alias("task")
    hubs = members.select(F.col("hub").alias("rep"), "n_tasks").distinct().join(classes.select("rep", "hashes"), "rep")
    hubs = hubs.select(F.col("rep").alias("hub"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tasks") - 1)).alias("task"), F.lit(-1).cast("bigint").alias("rep"), "hashes")
    rows = hubs.union(members.filter("rep <> hub").join(classes.select("rep", "hashes"), "rep").select("hub", task, "rep", "hashes"))

    def link(batches: Iterator) -> Iterator:
        import pandas as pd

        for part in _groups(batches, ["hub", "task"]):
            if len(part) < 2:
                continue
            good = links_of(_sorted_set(part["hashes"].iloc[0]), [np.asarray(h, dtype=np.int64) for h in part["hashes"].iloc[1:]])
            yield pd.DataFrame({"a": part["rep"].to_numpy()[1:][good], "b": int(part["hub"].iloc[0])})

    return rows.repartition("hub", "task").sortWithinPartitions("hub", "task", "rep").mapInPandas(link, "a bigint, b bigint")


def cell_links(reps, cells, comps, sets: list[np.ndarray], keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (of reps) that join the components of classes which share a key; of two cells only links between them."""
    m = len(reps)
    both_cells = len(set(cells)) > 1
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    group = np.unique(comps, return_inverse=True)[1].copy()
    flat = np.concatenate(keys)
    owner = np.repeat(np.arange(m), [len(k) for k in keys])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out: list[tuple[int, int]] = []
    for d in range(m):
        lo, hi = np.searchsorted(flat, keys[d], "left"), np.searchsorted(flat, keys[d], "right")
        near = np.unique(np.concatenate([owner[x:y] for x, y in zip(lo, hi)])) if len(lo) else np.zeros(0, np.int64)
        near = near[near > d]
        if both_cells:
            near = near[cells[near] != cells[d]]
        near = near[4 * np.minimum(sizes[near], sizes[d]) >= 3 * np.maximum(sizes[near], sizes[d])]
        near = near[group[near] != group[d]]
        while len(near):
            some = near[: max(1, int(np.searchsorted(np.cumsum(sizes[near]), 4_000_000)))]
            near = near[len(some) :]
            for k in some[links_of(sets[d], [sets[i] for i in some])]:
                if group[k] != group[d]:
                    out.append((int(reps[d]), int(reps[k])))
                    group[group == group[k]] = group[d]
            near = near[group[near] != group[d]]
    return out


def class_links(classes: DataFrame, keys: DataFrame, cell_classes: int = CELL_CLASSES, cell_shingles: int = CELL_SHINGLES, hub_classes: int = HUB_CLASSES) -> DataFrame:
    """(a, b): edges whose components are those of all links between classes."""
    posted = materialise(keys).select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    lists = materialise(posted.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("key", "hub"))
    posted = materialise(posted.join(lists, "key").select("rep", "key", "hub"))
    hubs = posted.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("hub")), 1, HUBS).alias("hubs"))
    hubs = materialise(hubs.join(classes.select("rep", "n"), "rep"))
    parts = lambda limit: F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum("n") / cell_shingles)).cast("bigint")
    asking = hubs.select("rep", "n", F.explode("hubs").alias("hub"))
    tasks = materialise(few(asking.groupBy("hub").agg(parts(hub_classes).alias("n_tasks"))))
    first = materialise(hub_links(classes, materialise(asking.join(tasks, "hub").select("rep", "hub", "n_tasks"))))
    least = hubs.select("rep", "n", F.col("hubs")[0].alias("hub"))
    sizes = materialise(few(least.groupBy("hub").agg(parts(cell_classes).alias("n_cells"))))
    members = least.join(sizes, "hub").select("rep", F.xxhash64("hub", F.pmod(F.xxhash64("rep"), F.col("n_cells"))).alias("cell"))
    joined = members.join(components(first), F.col("rep") == F.col("node"), "left").select("rep", "cell", F.coalesce("root", "rep").alias("comp"))
    tagged = materialise(posted.select("rep", "key").join(materialise(joined), "rep"))
    open_ = materialise(few(tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")))
    tagged = materialise(tagged.join(open_, "key"))
    # of each open key its cells, and whether all its classes there are of one component
    others = materialise(tagged.groupBy("key", F.col("cell").alias("other")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    meet = tagged.join(others, "key").filter("not (lo = comp and hi = comp)")
    meet = meet.select("rep", "cell", "comp", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j")).distinct()
    open_keys = tagged.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    dealt = meet.join(open_keys, "rep").join(classes.select("rep", "hashes"), "rep")

    def link(batches: Iterator) -> Iterator:
        import pandas as pd

        for part in _groups(batches, ["i", "j"]):
            if len(part) > 1:
                sets = [_sorted_set(h) for h in part["hashes"]]
                found = cell_links(part["rep"].to_numpy(), part["cell"].to_numpy(), part["comp"].to_numpy(), sets, [np.asarray(k, dtype=np.int64) for k in part["keys"]])
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    second = dealt.select("i", "j", "rep", "cell", "comp", "hashes", "keys").repartition("i", "j").sortWithinPartitions("i", "j", "rep").mapInPandas(link, "a bigint, b bigint")
    return first.union(materialise(second))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, **cells) -> DataFrame:
    """Per row of ``docs``: uid, doc_id, n_shingles, class_id, component_id, root.

    uid is the column ``uid_col`` of ``docs``, else a number given to the rows
    of a written copy; class_id is the least uid with the same set; root is
    a uid that names the component;
    component_id is the smallest doc_id reachable by links, the row's own
    included (a null doc_id is passed over unless all are null). Null texts and
    texts without words have no shingles and link with nothing. Repeated rows
    link with each other. Other columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    with temporary(spark):
        rows = docs.select(*([F.col(uid_col).alias("uid")] if uid_col else []), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        rows = rows if uid_col else numbered(rows)
        least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(4 * least_parts, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
        every = materialise(shared_counts(rows, buckets, -(-buckets // 4), width))
        alive = every.filter("n_shingles > 0 and 4 * n_shared >= 3 * n_shingles").select("uid")
        n_alive = alive.count()
        alive = F.broadcast(alive) if n_alive <= BROADCAST_IDS else alive
        sets = materialise(_with_sets(rows.join(alive, "uid", "left_semi"), width))
        # written, so that the join reads two plain shuffles and a large group of copies is split
        copies = materialise(few(sets.groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep"))))
        member = materialise(sets.select("uid", "n", "s1", "s2").join(copies, ["n", "s1", "s2"]).select("uid", "rep"))
        classes = materialise(sets.join(member.filter("uid = rep").select("uid"), "uid", "left_semi").selectExpr("uid as rep", "n", "hashes"))
        links = components(class_links(classes, class_keys(classes), **cells))
        reached = member.join(links, F.col("rep") == F.col("node"), "left").select("uid", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("__root"))
        out = every.join(reached, "uid", "left").select("uid", "doc_id", "n_shingles", F.coalesce("class_id", "uid").alias("class_id"), F.coalesce("__root", "uid").alias("__root"))
        out = materialise(out, keep=True)
        # written, so that the join reads two plain shuffles and a large component is split
        least = materialise(few(out.groupBy("__root").agg(F.min("doc_id").alias("component_id"))), keep=True)
    return out.join(least, "__root").select("uid", "doc_id", "n_shingles", "class_id", "component_id", F.col("__root").alias("root"))


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the smallest doc_id stays.

    Of rows with that doc_id the first one stays; in a component of null doc_ids the first row.
    """
    docs = numbered(docs, "__uid")
    found = jaccard_components(docs, id_col=id_col, uid_col="__uid", **options)
    first = materialise(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("uid").alias("first")))
    gone = found.join(first, F.col("first") == F.col("uid"), "left_anti").select(F.col("uid").alias("__uid"))
    return docs.join(gone, "__uid", "left_anti").drop("__uid")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, range(1, greatest(len(w) - 4, 1) + 1) t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(any_value(x.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes x ON x.doc_id = d.doc_id
GROUP BY d.doc_id
"""
