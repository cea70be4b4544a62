"""Mixing sources to target weights [native]: Poisson replication.

Each source has a target share of the mixture. Its mean repetition rate is
share * corpus size / source size (sizes in code points, at least 1 a
document). A document's number of copies inverts the Poisson distribution with
that mean at a uniform number hashed from (seed, doc_id): no draw depends on
the task, the order or the cluster. The document is exploded by its count and
the copies are shuffled globally by a hash of (seed, doc_id, copy).

No document is repeated more than MAX_RATE times on average: what a source too
small for its share leaves goes to the other sources by their weights.

Large means are split: Poisson(m) is the sum of independent Poisson(m / parts)
with m / parts <= PART_MEAN, one hash each, so no distribution table is long.
The table of rates (a row a source, about 600 bytes) is aggregated map-side and
its rows counted. Up to BROADCAST_SOURCES rows it is broadcast, so documents
move once, in the final shuffle; beyond that the join is shuffled with salted
keys, which spread a source that holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

PART_MEAN = 8.0
#: the largest mean number of copies of a document
MAX_RATE = 100_000.0
TABLE_LENGTH = 64  # P(Poisson(8) > 64) < 1e-30: beyond the 52 bits of the uniform number
SALTS = 32
BROADCAST_SOURCES = 10_000
SEED = 17
#: target weights by source, and of every source that is not named
WEIGHTS: dict[str, float] = {}
OTHER_WEIGHT = 1.0


def _hash(*parts: str) -> str:
    """SQL for a uniform number in [0, 1) with 52 bits, the same in any SQL engine that has md5."""
    return f"(cast(conv(substring(md5(concat_ws('|', {', '.join(parts)})), 1, 13), 16, 10) as double) / 4503599627370496D)"


def source_rates(docs: DataFrame, weights: Mapping[str, float], other: float, total: float | None = None, *, max_rate: float = MAX_RATE, source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, int]:
    """(source, rate): the mean number of copies of each of its documents; and the number of sources.

    The sizes of sources are aggregated once and written. While a rate passes
    ``max_rate`` it is held there and the rest of the budget is shared anew; a
    round is one aggregate of that table, and each holds at least one more source.
    """
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    size = F.sum(F.greatest(F.lit(1), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    sizes = materialise(docs.groupBy(F.col(source_col).alias("source")).agg(size.alias("size")).withColumn("weight", weight))
    sums = sizes.agg(F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not sums["weight"]:
        return sizes.select("source", F.lit(0.0).alias("rate")), sums["n"]
    budget = float(total if total is not None else sums["size"])
    shared, left = float(sums["weight"]), budget  # of the sources that are not held at max_rate: weight and budget
    rate = F.col("weight") / F.lit(shared) * F.lit(left) / F.col("size")
    while True:
        held = sizes.filter(rate > max_rate).agg(F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.count("*").alias("n")).first()
        weight_left, budget_left = float(sums["weight"]) - float(held["weight"] or 0.0), budget - max_rate * float(held["size"] or 0)
        if not held["n"] or held["n"] == sums["n"] or weight_left <= 0 or (weight_left, budget_left) == (shared, left):
            return sizes.select("source", F.least(F.lit(float(max_rate)), rate).alias("rate")), sums["n"]
        shared, left = weight_left, budget_left
        rate = F.col("weight") / F.lit(shared) * F.lit(left) / F.col("size")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, other: float = OTHER_WEIGHT, total: float | None = None, max_rate: float = MAX_RATE, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` plus mix_part, mix_copy, mix_order: one row per copy.

    ``total`` is the size of the mixture in code points (default: that of
    ``docs``). A null source is a source of its own, a null or empty text has
    size 1, no mean number of copies passes ``max_rate``, a null doc_id hashes as the empty string, and repeated rows get
    equal counts. Weight 0 removes a source. An empty table gives no rows.
    Rows are shuffled: partitions by hash, sorted by mix_order inside.
    Columns of ``docs`` named like the three new ones are replaced.
    """
    docs = docs.drop("mix_part", "mix_copy", "mix_order")
    cols = docs.columns
    rates, n_sources = source_rates(docs, WEIGHTS if weights is None else weights, other, total, max_rate=max_rate, source_col=source_col, text_col=text_col)
    cdf = f"transform(sequence(0, {TABLE_LENGTH}), k -> k)"
    rates = (
        rates.withColumn("parts", F.expr(f"cast(greatest(1, ceil(rate / {PART_MEAN}D)) as int)"))
        .withColumn("mean", F.expr("rate / parts"))
        # cumulative probabilities p(0), p(0) + p(1), ...
        .withColumn(
            "cdf",
            F.expr(
                f"aggregate({cdf}, struct(exp(-mean) as p, 0D as c, cast(array() as array<double>) as l), (a, k) ->"
                " struct(a.p * mean / (k + 1) as p, a.c + a.p as c, array_append(a.l, a.c + a.p) as l), a -> a.l)"
            ),
        )
        .select(F.col("source").alias("__source"), "parts", "cdf")
    )
    same = F.col(source_col).eqNullSafe(F.col("__source"))
    if n_sources <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), same).drop("__source")
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("__row_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col("__row_salt") == F.col("__salt"))).drop("__row_salt", "__salt", "__source")
    ident = f"coalesce(cast(`{id_col}` as string), '')"
    u = _hash(f"'{seed}'", ident, "cast(__part as string)")
    out = (
        joined
        .withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("__u", F.expr(u))
        .withColumn("__n", F.expr("size(filter(cdf, c -> c <= __u))"))
        .filter("__n > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("mix_part", F.col("__part"))
    )
    key = F.expr(f"md5(concat_ws('|', 'order', '{seed}', {ident}, cast(mix_part as string), cast(mix_copy as string)))")
    out = out.select(*[F.col(f"`{c}`") for c in cols], "mix_part", "mix_copy", key.alias("mix_order"))
    return out.repartition("mix_order").sortWithinPartitions("mix_order")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH sizes AS (
  SELECT source, sum(greatest(1, length(coalesce(text, '')))) AS size, 1.0::DOUBLE AS weight
  FROM documents GROUP BY source
), rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(size) FROM sizes)::DOUBLE / size AS rate FROM sizes
), parts AS (
  SELECT source, greatest(1, ceil(rate / {PART_MEAN}))::INT AS parts, rate / greatest(1, ceil(rate / {PART_MEAN}))::INT AS mean FROM rates
), steps AS (
  SELECT source, parts, mean, k, exp(-mean + CASE WHEN k = 0 THEN 0 ELSE k * ln(mean) END - lgamma(k + 1)) AS p
  FROM parts, range(0, {TABLE_LENGTH + 1}) t(k)
), cdf AS (
  SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
), tables AS (
  SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS c FROM cdf GROUP BY source
), drawn AS (
  SELECT d.*, p.part AS mix_part,
         ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), p.part::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
         t.c AS c
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source, range(0, t.parts) p(part)
), counted AS (
  SELECT *, len(list_filter(c, lambda x: x <= u)) AS n FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, mix_part::INT AS mix_part, r.copy::INT AS mix_copy,
       md5(concat_ws('|', 'order', '{SEED}', coalesce(doc_id::VARCHAR, ''), mix_part::VARCHAR, r.copy::VARCHAR)) AS mix_order
FROM counted, range(0, n) r(copy)
"""
