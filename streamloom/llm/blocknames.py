"""Exact deduplication by deterministic block naming [native].

Every text is cut into fixed-size blocks of UTF-8 bytes. The distinct blocks
are sorted over all partitions by a 64-bit key (those that share a key, by
content) and numbered: a block's integer name. Adjacent names are then paired,
the distinct pairs sorted and numbered in turn, until each document has one
name. No name depends on how rows are partitioned. Two documents get the same (levels, name) exactly if their texts
are the same bytes: a name stands for one content, never for a hash of it.

Only the first step moves text, once, after a map-side distinct, so a text
that a third of all rows share is shuffled once per map task. The same key
leads a block's name back to its documents; keys that stand for more than one
content are found by counting and those blocks go by their content instead. All later levels move integers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_names, materialise, numbered, table, temporary, text_or_empty

BLOCK_BYTES = 8192


def document_names(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None, block_bytes: int = BLOCK_BYTES, route: str = "xxhash64({})") -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, text_sha256, levels, name.

    uid is the column ``uid_col`` of ``docs``, else a number taken here.
    Equal (levels, name) means byte-equal texts and the other way round; names
    follow the order of the blocks, not the partitions. A null text counts as
    empty; other columns of ``docs`` are not read. An empty table gives no
    rows. ``route`` is the SQL of the route key; any function of the block is
    right, a poor one only moves more blocks by content.
    """
    size = F.expr(f"greatest(1, cast(ceil(octet_length(bytes) / {block_bytes}) as int))")
    cut = f"substring(bytes, i * {block_bytes} + 1, {block_bytes})"
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()

    def cut_up(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        src = rows.select(uid.alias("uid"), F.col(id_col).alias("doc_id"), F.encode(text_or_empty(text_col), "utf-8").alias("bytes")).withColumn("n_blocks", size)
        heads = src.select("uid", "doc_id", F.sha2("bytes", 256).alias("text_sha256"), "n_blocks", F.expr(f"transform(sequence(0, n_blocks - 1), i -> {route.format(cut)})").alias("routes"))
        return materialise(heads), src.select("uid", F.posexplode(F.expr(f"transform(sequence(0, n_blocks - 1), i -> {cut})")).alias("idx", "block"))

    heads, blocks = cut_up(docs)
    # in the order of their route keys; a key of several contents names none, these blocks are named by content below
    keys = materialise(blocks.select("block").distinct().groupBy(F.expr(route.format("block")).alias("route")).agg(F.count("*").alias("contents")))
    # written, so that the join below reads two plain shuffles: the planner then splits a route that many rows share
    routed = materialise(dense_names(keys, ["route"]))
    shared = routed.filter("contents > 1").select("route")
    collide = not shared.isEmpty()
    if collide and not uid_col:  # blocks and heads must agree on the numbers of rows
        docs, uid = numbered(docs.select(id_col, text_col), "__uid"), F.col("__uid")
        heads, blocks = cut_up(docs)
    rows = heads.select("uid", F.posexplode("routes").alias("idx", "route"))
    if not collide:
        rows = rows.join(routed, "route").select("uid", "idx", "name")
    else:
        by_content = blocks.selectExpr("uid", "idx", "block", f"{route.format('block')} as route").join(shared, "route", "left_semi")
        again = materialise(dense_names(by_content.select("block").distinct(), ["block"], by="xxhash64(block)").selectExpr("block", "-1 - name as name"))
        rows = rows.join(routed.filter("contents = 1"), "route").select("uid", "idx", "name").union(by_content.join(again, "block").select("uid", "idx", "name"))
    most = heads.agg(F.max("n_blocks")).first()[0] or 1
    sizes = heads.select("uid", "n_blocks")
    level, done = 0, []
    while most > 1:
        rows = materialise(rows.join(sizes, "uid") if level == 0 else rows)
        done.append(rows.filter(f"n_blocks <= {2**level} and n_blocks > {2**level // 2}").selectExpr("uid", f"{level} as levels", "name"))
        pairs = materialise(
            rows.filter(f"n_blocks > {2**level}")
            .groupBy("uid", F.expr("idx div 2").cast("int").alias("idx"), "n_blocks")
            .agg(F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"), F.max(F.expr("if(idx % 2 = 1, name, null)")).alias("b"))
        )
        named = materialise(dense_names(pairs.select("a", "b").distinct(), ["a", "b"]))
        rows = pairs.alias("p").join(named.alias("q"), F.expr("p.a = q.a and p.b <=> q.b")).selectExpr("p.uid", "p.idx", "q.name", "p.n_blocks")
        most = (most + 1) // 2
        level += 1
    done.append(rows.selectExpr("uid", f"{level} as levels", "name"))
    final = done[0]
    for part in done[1:]:
        final = final.union(part)
    return heads.select("uid", "doc_id", "text_sha256").join(final, "uid")


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text the one with the largest doc_id stays (a null
    doc_id counts as the smallest; among rows repeated with the same doc_id the
    one with the largest uid stays).
    """
    with temporary(docs.sparkSession):
        named = materialise(document_names(docs, **options), keep=True)
        groups = materialise(named.groupBy("levels", "name").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("group_size")), keep=True)
    return named.join(groups, ["levels", "name"]).select(
        "uid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, from a written copy of it."""
    docs = numbered(docs, "__uid")
    gone = exact_duplicates(docs, uid_col="__uid", **options).filter("not kept").select(F.col("uid").alias("__uid"))
    return docs.join(gone, "__uid", "left_anti").drop("__uid")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
