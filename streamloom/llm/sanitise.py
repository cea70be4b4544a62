"""Personal data by information-theoretic sanitisation [native].

Base spans are found by fixed patterns (email, ip, card, phone) with checks.
Each distinct value is a protected entity e with information content
IC(e) = -log2 p(e). A term t of the same documents, at any distance and outside
base spans, discloses it by
PMI(t, e) = log2(p(t, e) / (p(t) p(e))): all of IC(e) if t never occurs without
e. Terms whose PMI / IC reaches GENERALISE become spans of their own wherever
they occur; from REMOVE on they are removed from the sanitised text, below it
generalised to a placeholder. A pair needs SUPPORT units that hold both, and
n_both * PMI must exceed log2 of the number of units by EVIDENCE bits: about as
often would one of all terms meet an entity so often by chance.

Probabilities are shares of slots: of all distinct terms of all units. p(t) is
the share of the slots that t fills, p(e) that of the slots of units with e, and
p(t, e) that of t in units with e, so that long documents, which hold many terms
and many entities, prove no more than their length lets expect.

Every count is over the whole corpus, in units: of the documents with an entity
that recurs, a unit is a document with all its exact and near copies, so copies
of one document prove nothing; any other document is a unit of its own. Near
copies share one of the KEYS smallest hashes of three-word shingles with the
first document that has it, and are estimated to be NEAR alike from the SKETCH
smallest. This is the only estimate: a copy that is missed counts as a unit.

One pass finds base values and the distinct terms of each document, and writes
them with the text and a row number; everything after reads that copy. Entities
that occur in exactly the same units are counted as one, so a list of addresses
that is repeated costs as much as one address. All steps run on every input.

Patterns are possessive and anchored to the start of a run, so very long runs
cost linear time and no recursion; matches are the same as those of the plain
patterns. Positions come from the gaps between matches. Pairs are counted
with map-side combining; an entity on a third of all rows is not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, temporary
from .components import components

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without a match of this has none of the kind
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}", "phone": r"\+[0-9]"}
#: words, and numbers, dates and codes: a joiner belongs to a term if a part with a digit follows
TERM = r"[\p{L}\p{N}]++(?:[-./:_](?=\p{L}*+\p{N})[\p{L}\p{N}]++)*+"
#: the characters a term has at least
LEAST = 3
SUPPORT = 3
EVIDENCE = 10.0
#: near copies: hashes looked up and compared, and the estimated Jaccard similarity from which on they are one unit
KEYS = 8
SKETCH = 32
NEAR = 0.3
GENERALISE = 0.7
REMOVE = 0.9
#: rows (and elements of their arrays) up to which a counted table is broadcast
BROADCAST_ROWS = 200_000
#: matches that are gathered in one array before it is added to the others
RUN = 128
_SPANS = "cast(array() as array<struct<s: int, e: int, v: string>>)"


def positions(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches: start, end (exclusive, code points), text.

    They are gathered in runs of RUN, since appending copies an array: a text
    with n matches costs n * RUN and not n * n.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr(_SPANS).alias("run"), F.expr("cast(array() as array<array<struct<s: int, e: int, v: string>>>)").alias("out"))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("v"))

    def step(acc, p):
        s = acc["at"] + p["g"]
        e = s + F.length(p["v"])
        span = F.struct(s.alias("s"), e.alias("e"), p["v"].alias("v"))
        full = F.size(acc["run"]) >= RUN
        return F.struct(
            e.alias("at"), F.when(full, F.array(span)).otherwise(F.array_append(acc["run"], span)).alias("run"),
            F.when(full, F.array_append(acc["out"], acc["run"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pairs, start, step, lambda acc: F.flatten(F.array_append(acc["out"], acc["run"])))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(v), "")
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(v))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(_digits(v))).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of spans that pass its check."""
    none = F.expr(_SPANS)

    def of(kind: str) -> Column:
        good = F.filter(positions(text, PATTERNS[kind]), lambda m: _passes(kind, m["v"]))
        return F.when(text.rlike(HINTS[kind]), good).otherwise(none)

    return {kind: of(kind) for kind in KINDS}


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    long_ = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), lambda w: F.length(w) >= LEAST)
    return F.array_distinct(F.transform(long_, F.lower))


def _without(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans as a space."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(m["s"] - acc["at"], F.lit(0))), F.lit(" "))
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), more.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["s"].cast("string"), m["e"].cast("string")))


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, text, one span array per kind, base (kind:start:end list), entities (kind:value), terms (outside base spans)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for k, spans in base_spans(F.col("text")).items():
        rows = rows.withColumn(k, spans)
    entities = F.concat(*[F.transform(k, lambda m, k=k: F.concat(F.lit(f"{k}:"), F.lower(m["v"]))) for k in KINDS])
    rows = rows.withColumn("base", F.concat(*[_joined(k, F.col(k)) for k in KINDS])).withColumn("entities", F.array_distinct(entities))
    bare = F.when(F.size("base") > 0, _without(F.col("text"), F.array_sort(F.concat(*KINDS)))).otherwise(F.col("text"))
    return rows.withColumn("terms", _terms(bare))


def near_copies(docs: DataFrame) -> DataFrame:
    """docs: uid, text -> uid, unit: the smallest uid of its exact and near copies."""
    words = docs.select("uid", F.split(F.lower("text"), r"\s++").alias("words"))
    shingles = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    sketches = materialise(words.select("uid", F.slice(F.sort_array(F.array_distinct(shingles)), 1, SKETCH).alias("sketch")))
    posted = sketches.select("uid", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    # what is an aggregate is written, so that joins read plain shuffles and a very common key is split
    hubs = materialise(posted.groupBy("key").agg(F.min("uid").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub"))
    edges = materialise(posted.join(hubs, "key").filter("uid <> hub").select("uid", "hub").distinct())
    both = edges.join(sketches, "uid").join(sketches.select(F.col("uid").alias("hub"), F.col("sketch").alias("other")), "hub")
    least = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    alike = F.size(F.array_intersect(F.array_intersect(least, F.col("sketch")), F.col("other"))) >= NEAR * F.size(least)
    found = components(both.filter(alike).select(F.col("uid").alias("a"), F.col("hub").alias("b")))
    return docs.select("uid").join(found, F.col("uid") == F.col("node"), "left").select("uid", F.coalesce("root", "uid").alias("unit"))


def _broadcast(df: DataFrame, elements: str = "1") -> DataFrame:
    """``df``, which is written, as a broadcast if its counted rows (or ``elements`` of them) are few enough."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(elements))).first()[0] or 0) <= BROADCAST_ROWS else df


def disclosing_terms(base: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """base: uid, text, entities, terms (written) -> term, disclosure: the largest PMI / IC over entities; and the empty term."""
    mentions = base.select("uid", F.explode("entities").alias("entity"))
    # an entity in fewer documents has no pair with enough support
    recurring = materialise(mentions.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("entity"))
    mentions = materialise(mentions.join(_broadcast(recurring), "entity"))
    holders = materialise(mentions.select("uid").distinct())
    few = _broadcast(holders)
    units = materialise(near_copies(base.join(few, "uid", "left_semi").select("uid", "text")))
    n = float(max(1, base.count() - holders.count() + units.select("unit").distinct().count()))

    held = materialise(mentions.join(units, "uid").select("unit", "entity").distinct())
    of_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("unit")).alias("x"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("y"))
    # entities of the same units have the same counts with every term
    classes = materialise(of_entity.filter(F.col("n_entity") >= support).groupBy("n_entity", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "n_entity"))
    held = materialise(held.join(_broadcast(classes), "entity").select("unit", "entity"))
    of_unit = materialise(base.join(few, "uid", "left_semi").select("uid", F.explode("terms").alias("term")).join(units, "uid").select("unit", "term").distinct())
    sizes = materialise(of_unit.groupBy("unit").agg(F.count("*").alias("slots")))
    of_entity = materialise(held.join(sizes, "unit").groupBy("entity").agg(F.sum("slots").alias("slots")))
    pairs = of_unit.join(held, "unit").groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    pairs = materialise(pairs.join(_broadcast(of_entity), "entity"))
    all_slots = (base.join(few, "uid", "left_anti").agg(F.sum(F.size("terms"))).first()[0] or 0) + (sizes.agg(F.sum("slots")).first()[0] or 0)
    all_slots = float(max(1, all_slots))

    # with a term that no text holds, so that no step is skipped where there is no pair
    none = base.sparkSession.range(1).select(F.lit("").alias("term"))
    terms = _broadcast(materialise(pairs.select("term").distinct().union(none)))
    alone = base.join(few, "uid", "left_anti").select(F.explode("terms").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    together = of_unit.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    n_term = materialise(alone.union(together).groupBy("term").agg(F.sum("n").alias("n_term")))
    pmi = F.log2(F.col("n_both") * all_slots / (F.col("n_term") * F.col("slots")))
    ic = -F.log2(F.col("slots") / F.lit(all_slots))
    scored = pairs.join(n_term, "term").withColumn("pmi", pmi).filter(F.col("n_both") * F.col("pmi") >= F.log2(F.lit(n)) + EVIDENCE)
    scored = scored.withColumn("disclosure", F.when(ic > 0, F.least(F.lit(1.0), F.col("pmi") / ic)).otherwise(F.lit(0.0)))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= threshold).union(none.select("term", F.lit(0.0)))


def _term_spans(base: DataFrame, terms: DataFrame) -> DataFrame:
    """uid, found: array<struct<s, e, v>> of the disclosing terms in each text, outside base spans, known: these terms with their strength."""
    # a document without such a term is done after the first join; positions are only computed for the others
    hits = base.select("uid", F.explode("terms").alias("term")).join(_broadcast(terms), "term").groupBy("uid").agg(F.collect_list(F.struct("term", "disclosure")).alias("known"))
    hits = _broadcast(materialise(hits), "size(known)")
    rows = base.select("uid", "text", F.concat(*KINDS).alias("taken")).join(hits, "uid")
    # positions by a running sum over a document's matches: linear in its length, and only the terms looked for go on
    found = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    cut = F.arrays_zip(F.slice(F.transform(F.split("text", TERM, -1), F.length), F.lit(1), F.size(found)).alias("gap"), found.alias("v"))
    each = rows.select("uid", F.posexplode(cut).alias("i", "m")).select("uid", "i", "m.v", (F.col("m.gap") + F.length("m.v")).alias("step"))
    upto = Window.partitionBy("uid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    wanted = hits.select("uid", F.explode("known").alias("k")).select("uid", F.col("k.term").alias("term"))
    each = each.select("uid", "v", F.sum("step").over(upto).cast("int").alias("e"), F.lower("v").alias("term")).join(wanted, ["uid", "term"])
    spans = each.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((F.col("e") - F.length("v")).alias("s"), "e", "v"))).alias("found"))
    free = lambda m: ~F.exists("taken", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
    return rows.select("uid", "known", "taken").join(spans, "uid").select("uid", "known", F.filter("found", free).alias("found"))


def _analysed(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    with temporary(docs.sparkSession):
        base = materialise(find_base(docs, id_col, text_col), keep=True)
        terms = materialise(disclosing_terms(base, **options))
        more = materialise(_term_spans(base, terms), keep=True)
    out = base.drop("entities", "terms").join(_broadcast(more, "size(known) + size(found)"), "uid", "left")
    return out.withColumn("terms", F.coalesce("found", F.expr(_SPANS))).withColumn("known", F.coalesce("known", F.expr("cast(array() as array<struct<term: string, disclosure: double>>)"))).drop("found")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """Per row of ``docs``: uid, doc_id, email, ip, card, phone, terms (arrays of spans), base, known.

    base lists kind:start:end of the base spans by kind, then start; known has
    the disclosing terms of the row with their strength. A null text is empty;
    repeated rows are copies of each other; an empty table gives no
    rows. Other columns are not read.
    """
    return _analysed(docs, id_col, text_col, support=support, threshold=threshold).drop("text")


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """doc_id, text with base values as [KIND], disclosing terms as [TERM] or, from ``remove`` on, left out."""
    rows = _analysed(docs, id_col, text_col, **options)

    def marked(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("r")))

    named = [marked(kind) for kind in KINDS]
    strong = lambda m: F.exists("known", lambda t: (t["term"] == F.lower(m["v"])) & (t["disclosure"] >= remove))
    named.append(F.transform("terms", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.when(strong(m), F.lit("")).otherwise(F.lit("[TERM]")).alias("r"))))
    rows = rows.withColumn("spans", F.array_sort(F.concat(*named)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        skip = m["s"] < acc["at"]  # overlaps what is already replaced
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["s"] - acc["at"]), m["r"])
        return F.struct(F.when(skip, F.greatest(acc["at"], m["e"])).otherwise(m["e"]).alias("at"), F.when(skip, acc["out"]).otherwise(more).alias("out"))

    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", text.alias("text"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", F.concat("base", _joined("term", F.col("terms")))).alias("spans"), F.size("terms").cast("bigint").alias("n_terms")
    )
