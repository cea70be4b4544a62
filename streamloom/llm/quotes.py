"""Chat formatting by quotation linking [native].

A message's lines have a quote level: the number of leading '>' marks. Runs of
lines of one level are quoted passages; each is normalised (lower case, white
space collapsed) and hashed whole, by paragraph and by line. The same units of
the unquoted parts of all messages are hashed, and a quoted unit joins the
latest earlier message of its conversation that holds it: a sorted pass over
(conversation, hash, span of turns) and one over the spans, never all pairs and
never all messages of a passage in one task. A message replies to the one that most
characters of its shallowest linked quotes come from (deeper ones were quoted
by that message; of ties the later one), else to the message before it. Quotes and their attribution lines are cut out, and
messages are ordered so that each comes after the one it answers: by depth in
the reply tree, then by turn.

Depths are found by pointer doubling over explicit replies only; between them
depth grows by one a message. Ranks in a conversation are taken in two steps
(in spans of turns, then over spans), so that a conversation that holds a
third of all rows is not sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: turns (or depths) to a span in the two-step ranks
SPAN = 4096
MARKS = r"^(?:[ \t]*+>)++[ \t]?"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote\s*:|am\b.*\bschrieb\b.*:|le\b.*\ba écrit\s*:|el\b.*\bescribió\s*:|-{2,}\s*original message\s*-{2,})\s*$"
#: how an attribution line ends: tested first, so that a line of any length costs linear time
ATTRIBUTION_END = r"[:-]\s*$"


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _units(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passage (lines joined by line feeds) -> keys, hash, size: the whole passage, its paragraphs, its lines."""
    units = F.array_union(F.array(F.col("passage")), F.array_union(F.split("passage", r"\n\s*\n"), F.split("passage", "\n")))
    out = rows.select(*keys, F.explode(F.array_distinct(F.transform(units, _normal))).alias("unit")).filter("unit <> ''")
    return out.select(*keys, F.sha2("unit", 256).alias("hash"), F.length("unit").alias("size"))


def parse_messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """uid, conv_id, turn, role, body (the text without quotes), quotes (array of level, passage)."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\r\n?", "\n")
    rows = messages.select(
        F.monotonically_increasing_id().alias("uid"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text")
    )
    level = lambda line: F.when(line.rlike(MARKS), F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))).otherwise(0)
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("line")))
    # an attribution line counts as quoted if the next line is
    quoted = F.transform(
        "lines",
        lambda x, i: F.struct(
            F.when((x["level"] == 0) & x["line"].rlike(ATTRIBUTION_END) & x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0), F.lit(-1)).otherwise(x["level"]).alias("level"), x["line"].alias("line")
        ),
    )
    start = F.expr("struct(cast(array() as array<struct<level: int, line: string>>) as runs, struct(-2 as level, '' as line) as run)")

    def gather(acc, x):
        same = acc["run"]["level"] == x["level"]
        longer = F.struct(x["level"].alias("level"), F.concat(acc["run"]["line"], F.lit("\n"), x["line"]).alias("line"))
        return F.when(same, F.struct(acc["runs"].alias("runs"), longer.alias("run"))).otherwise(F.struct(F.array_append(acc["runs"], acc["run"]).alias("runs"), x.alias("run")))

    runs = F.aggregate("lines", start, gather, lambda acc: F.array_append(acc["runs"], acc["run"]))
    plain = F.expr("text not rlike '(?m)^[ \\\\t]*>'")
    rows = rows.withColumn("lines", F.when(plain, F.lit(None)).otherwise(lines)).withColumn("lines", F.when(plain, F.lit(None)).otherwise(quoted)).withColumn("runs", F.when(plain, F.lit(None)).otherwise(runs))
    unquoted = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["line"]), "\n")
    body = F.regexp_replace(F.when(plain, F.col("text")).otherwise(unquoted), r"^\s++|(?<!\s)\s++$", "")
    quotes = F.when(plain, F.expr("cast(array() as array<struct<level: int, line: string>>)")).otherwise(F.filter("runs", lambda r: (r["level"] > 0) & (F.trim(r["line"]) != "")))
    return rows.select("uid", "conv_id", "turn", "role", body.alias("body"), F.transform(quotes, lambda r: F.struct(r["level"].alias("level"), r["line"].alias("passage"))).alias("quotes"))


def ranked(rows: DataFrame, part: list[str], order: list[str], by: str, name: str) -> DataFrame:
    """Adds ``name``: 0-based rank in ``part`` by ``order``, whose first column is ``by``; two steps over spans of ``by``."""
    spans = rows.withColumn("__span", F.floor(F.col(by) / SPAN))
    counts = spans.groupBy(*part, "__span").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*part).orderBy(F.col("__span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*part, "__span").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    spans = spans.withColumn("__in", F.row_number().over(inside) - 1)
    same = [spans[c].eqNullSafe(counts[c]) for c in [*part, "__span"]]
    joined = spans.join(counts, same).drop(*[counts[c] for c in [*part, "__span"]])
    return joined.withColumn(name, F.col("__in") + F.col("__before")).drop("__span", "__in", "__before")


def reply_links(parsed: DataFrame) -> DataFrame:
    """parsed: uid, conv_id, rank, body, quotes -> conv_id, rank, parent: explicit replies."""
    quoted = parsed.select("conv_id", "rank", F.explode("quotes").alias("q")).select("conv_id", "rank", "q.level", "q.passage")
    quoted = _units(quoted, ["conv_id", "rank", "level"]).groupBy("conv_id", "hash", "rank").agg(F.max("size").alias("size"), F.min("level").alias("level"))
    quoted = materialise(quoted)
    wanted = materialise(quoted.select("conv_id", "hash").distinct())
    originals = _units(parsed.select("conv_id", "rank", F.col("body").alias("passage")), ["conv_id", "rank"]).select("conv_id", "hash", "rank").distinct()
    originals = originals.join(wanted, originals["conv_id"].eqNullSafe(wanted["conv_id"]) & (originals["hash"] == wanted["hash"]), "left_semi")
    both = originals.select("conv_id", "hash", "rank", F.col("rank").alias("original"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("level")).union(quoted.select("conv_id", "hash", "rank", F.lit(None).cast("bigint").alias("original"), "size", "level"))
    both = materialise(both.withColumn("span", F.floor(F.col("rank") / SPAN)))
    inside = Window.partitionBy("conv_id", "hash", "span").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("conv_id", "hash", "span").agg(F.max("original").alias("top")).withColumn("before", F.max("top").over(before))
    tops = tops.select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), F.col("span").alias("s"), "before")
    found = both.withColumn("inside", F.max("original").over(inside)).filter("size is not null")
    found = found.join(tops, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("span") == F.col("s")))
    found = found.withColumn("parent", F.coalesce("inside", "before")).filter("parent is not null")
    weights = found.groupBy("conv_id", "rank", "level", "parent").agg(F.sum("size").alias("weight"))
    return weights.groupBy("conv_id", "rank").agg(F.max(F.struct(-F.col("level"), "weight", "parent")).alias("best")).select("conv_id", "rank", F.col("best.parent").alias("parent"))


def _segments(rows: DataFrame) -> DataFrame:
    """rows: conv_id, rank, linked -> adds segment: the latest rank up to this one that is linked, else 0."""
    spans = rows.withColumn("__span", F.floor(F.col("rank") / SPAN))
    own = F.when(F.col("linked"), F.col("rank"))
    tops = spans.groupBy("conv_id", "__span").agg(F.max(own).alias("__top"))
    before = Window.partitionBy("conv_id").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__before", F.max("__top").over(before)).drop("__top")
    upto = Window.partitionBy("conv_id", "__span").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("__here", F.max(own).over(upto))
    same = spans["conv_id"].eqNullSafe(tops["conv_id"]) & (spans["__span"] == tops["__span"])
    return spans.join(tops, same).drop(tops["conv_id"], tops["__span"]).withColumn("segment", F.coalesce("__here", "__before", F.lit(0))).drop("__span", "__here", "__before")


def segment_depths(starts: DataFrame) -> DataFrame:
    """starts: conv_id, segment, next (an earlier segment), step -> conv_id, segment, depth; pointer doubling."""
    state = materialise(starts)
    while not state.filter("next > 0").isEmpty():
        hop = state.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("next").alias("further"), F.col("step").alias("more"))
        joined = state.join(hop, state["conv_id"].eqNullSafe(hop["c"]) & (state["next"] == hop["s"]), "left")
        state = materialise(joined.select("conv_id", "segment", F.coalesce("further", F.lit(0)).alias("next"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")))
    return state.select("conv_id", "segment", F.col("step").alias("depth"))


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row of ``messages``: conv_id, turn, role, text, n_quotes, quote_level, parent_turn, depth, position, chat.

    text is without quotes, quote_level the deepest level quoted (0: none),
    parent_turn the turn replied to (null for a conversation's first message),
    position the 0-based place in the reply-ordered conversation, chat the
    message as '<|role|>' + text. Null conv_ids form one conversation; null
    turns come first in it; of repeated turns the rows stay apart, in row order.
    A null text is empty. Other columns are not read.
    """
    parsed = materialise(parse_messages(messages, conv_col, turn_col, role_col, text_col))
    rows = materialise(ranked(parsed, ["conv_id"], ["turn", "uid"], "turn", "rank"))
    # written, so that the join reads a plain table and a conversation with very many messages is split
    quoting = materialise(rows.filter(F.size("quotes") > 0).select("conv_id").distinct())
    links = materialise(reply_links(quoting.join(rows.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")))
    if links.isEmpty():
        out = rows.withColumn("parent", F.when(F.col("rank") > 0, F.col("rank") - 1)).withColumn("depth", F.col("rank")).withColumn("position", F.col("rank"))
    else:
        l2 = links.select(F.col("conv_id").alias("c"), F.col("rank").alias("r"), F.col("parent").alias("linked_to"))
        joined = rows.join(l2, rows["conv_id"].eqNullSafe(F.col("c")) & (rows["rank"] == F.col("r")), "left").drop("c", "r")
        placed = materialise(_segments(joined.withColumn("linked", F.col("linked_to").isNotNull())))
        at = placed.select(F.col("conv_id").alias("c"), F.col("rank").alias("r"), F.col("segment").alias("next"))
        starts = placed.filter("linked").select("conv_id", "rank", "linked_to").join(at, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("linked_to") == F.col("r")))
        depths = segment_depths(starts.select("conv_id", F.col("rank").alias("segment"), "next", (F.col("linked_to") - F.col("next") + 1).alias("step")))
        d2 = depths.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("depth").alias("base"))
        deep = placed.join(d2, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left").drop("c", "s")
        deep = deep.withColumn("depth", F.coalesce("base", F.lit(0)) + F.col("rank") - F.col("segment"))
        deep = deep.withColumn("parent", F.coalesce("linked_to", F.when(F.col("rank") > 0, F.col("rank") - 1)))
        out = ranked(deep, ["conv_id"], ["depth", "rank"], "depth", "position")
    turns = rows.select(F.col("conv_id").alias("c"), F.col("rank").alias("r"), F.col("turn").alias("parent_turn"))
    out = out.join(turns, out["conv_id"].eqNullSafe(F.col("c")) & (F.col("parent") == F.col("r")), "left")
    return out.select(
        "conv_id", "turn", "role", F.col("body").alias("text"), F.size("quotes").cast("bigint").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("quote_level"), "parent_turn", F.col("depth").cast("bigint").alias("depth"),
        F.col("position").cast("bigint").alias("position"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body")).alias("chat"),
    )


def op6_quote_linking(spark, sf_dir: str) -> DataFrame:
    """All columns of link_quotes; parent_turn is -1 where there is none."""
    return link_quotes(table(spark, sf_dir, "conversations")).withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))


_DUCK_MARKS = r"^(?:[ \t]*>)+"
OP6_SQL = rf"""
WITH RECURSIVE messages AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS rank
  FROM conversations
), split AS (
  SELECT conv_id, rank, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM messages
), marked AS (
  SELECT conv_id, rank, i, regexp_replace(line, '{_DUCK_MARKS}[ \t]?', '') AS line,
         length(regexp_replace(regexp_extract(line, '{_DUCK_MARKS}'), '[^>]', '', 'g')) AS level
  FROM split
), lines AS (
  SELECT conv_id, rank, i, line,
         CASE WHEN level = 0 AND regexp_matches(line, '{ATTRIBUTION}') AND lead(level) OVER w > 0 THEN -1 ELSE level END AS level
  FROM marked WINDOW w AS (PARTITION BY conv_id, rank ORDER BY i)
), changes AS (
  SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, rank ORDER BY i) THEN 0 ELSE 1 END AS change FROM lines
), numbered AS (
  SELECT *, sum(change) OVER (PARTITION BY conv_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM changes
), runs AS (
  SELECT conv_id, rank, run, level, string_agg(line, chr(10) ORDER BY i) AS passage FROM numbered GROUP BY conv_id, rank, run, level
), bodies AS (
  SELECT conv_id, rank, regexp_replace(coalesce(string_agg(passage, chr(10) ORDER BY run) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS body,
         count(*) FILTER (level > 0 AND trim(passage) <> '') AS n_quotes, coalesce(max(level) FILTER (level > 0 AND trim(passage) <> ''), 0) AS quote_level
  FROM runs GROUP BY conv_id, rank
), pieces AS (
  SELECT conv_id, rank, level, passage FROM runs WHERE level > 0 AND trim(passage) <> ''
  UNION ALL SELECT conv_id, rank, 0, body FROM bodies
), parts AS (
  SELECT conv_id, rank, level, unnest(list_concat([passage], string_split_regex(passage, '\n\s*\n'), string_split(passage, chr(10)))) AS part FROM pieces
), units AS (
  SELECT DISTINCT conv_id, rank, level, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS unit FROM parts
), quoted AS (
  SELECT conv_id, rank, unit, min(level) AS level FROM units WHERE level > 0 AND unit <> '' GROUP BY conv_id, rank, unit
), found AS (
  SELECT q.conv_id, q.rank, q.level, q.unit, max(o.rank) AS parent
  FROM quoted q JOIN units o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.unit = o.unit AND o.level = 0 AND o.rank < q.rank
  GROUP BY q.conv_id, q.rank, q.level, q.unit
), weights AS (
  SELECT conv_id, rank, level, parent, sum(length(unit)) AS weight FROM found GROUP BY conv_id, rank, level, parent
), links AS (
  SELECT conv_id, rank, arg_max(parent, (-level, weight, parent)) AS parent FROM weights GROUP BY conv_id, rank
), tree AS (
  SELECT m.conv_id, m.rank, coalesce(l.parent, CASE WHEN m.rank > 0 THEN m.rank - 1 END) AS parent
  FROM messages m LEFT JOIN links l ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.rank = l.rank
), depths AS (
  SELECT conv_id, rank, 0::BIGINT AS depth FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.conv_id, t.rank, d.depth + 1 FROM tree t JOIN depths d ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.parent = d.rank
)
SELECT m.conv_id, m.turn, m.role, b.body AS text, b.n_quotes, b.quote_level::INT AS quote_level, coalesce(p.turn, -1) AS parent_turn, d.depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY d.depth, m.rank) - 1 AS position, '<|' || coalesce(m.role, '') || '|>' || chr(10) || b.body AS chat
FROM messages m
JOIN bodies b ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.rank = b.rank
JOIN depths d ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.rank = d.rank
JOIN tree t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.rank = t.rank
LEFT JOIN messages p ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.rank = t.parent
"""
