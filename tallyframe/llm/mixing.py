"""Mixing sources to target weights by hash-seeded Poisson replication, in DataFrame expressions only.

Each source s with weight w_s gets the mean repetition rate  r_s = target_rows * w_s / sum(w) / rows_s.  A
document's count is the inverse of the Poisson(r_s) distribution at a uniform number hashed from (seed, doc_id),
so it depends on nothing but the document's id, its source's rate and the seed. Documents are exploded by their
count and dealt over the cluster in an order hashed from (seed, doc_id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import documents
from tallyframe.storage import materialize

#: A rate above this is drawn as a sum of equal independent parts, so exp(-rate) never underflows.
PART_RATE = 256.0
#: Up to so many sources the table of rates is broadcast; beyond, it is joined by shuffle, each source in so many parts.
BROADCAST_SOURCES = 10_000
SALTS = 64


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None) -> DataFrame:
    """(source, rows, rate, parts, cdf) for each source. weights: None weighs all sources alike; a source that
    the weights do not name gets none and leaves. cdf holds the distribution function of Poisson(rate / parts)
    from 0 up to where less than 1e-16 is left. A null source is a source of its own, named None."""
    per = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = per.withColumn("weight", F.lit(1.0))
    else:
        # a CASE over the few named weights, null-safe
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
        weighed = per.withColumn("weight", w)
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    target = F.col("all_rows").cast("double") if target_rows is None else F.lit(float(target_rows))
    rate = F.when(F.col("all_weight") > 0, target * (F.col("weight") / F.col("all_weight")) / F.col("rows")).otherwise(0.0)
    part = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), F.ceil(part + 12 * F.sqrt(part) + 30).cast("int"))
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("rate") / F.col("parts") / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return (
        weighed.join(F.broadcast(total))  # one row
        .withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
        .withColumn("cdf", F.aggregate(steps, start, step, lambda a: a["c"]))
        .select("source", "rows", "rate", "parts", "cdf")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    target_rows: int | None = None,
    seed: int = 17,
    partitions: int | None = None,
) -> DataFrame:
    """The columns of docs, each row repeated by its Poisson count, in globally shuffled order.

    Columns mix_copy (from 1), mix_count and mix_rate follow; columns of docs with those names are replaced.
    Rows with equal doc_id and source draw the same count. Null doc_id counts as the text "null". An empty table
    gives an empty one. A source's many rows stay where they were read until the one shuffle, which deals by the
    hash of (seed, doc_id, copy), so a hot source or a much repeated document spreads over all tasks. With very many
    sources the rates are joined by shuffle, on source and a salt from the doc_id.
    """
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_count", "mix_rate")]
    rates = materialize(
        source_rates(docs.select("source"), weights, target_rows).select(F.struct("source").alias("_s"), F.col("rate").alias("mix_rate"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf")),
        "mixing-rates",
    )
    small = rates.count() <= BROADCAST_SOURCES
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the uniform numbers stand outside the search in the distribution, so each is hashed once
    uniforms = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda i: _uniform(F.lit(str(seed)), key, i.cast("string")))
    count = F.aggregate(uniforms, F.lit(0), lambda a, u: a + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)))
    keyed = docs.select(*own)
    # null-safe equality on the source, written on a hashable pair so that both join kinds can serve
    on = [F.coalesce(keyed["source"], F.lit("")) == F.coalesce(F.col("_s.source"), F.lit("")), keyed["source"].isNull() == F.col("_s.source").isNull()]
    if small:
        joined = keyed.join(F.broadcast(rates), on)
    else:
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        salted = rates.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = keyed.join(salted, [*on, keyed["_salt"] == F.col("_part")])
    drawn = joined.withColumn("mix_count", count).where("mix_count > 0")
    copies = drawn.select(*own, F.explode(F.sequence(F.lit(1), F.col("mix_count"))).alias("mix_copy"), "mix_count", "mix_rate")
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mix_copy"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("_o", order).repartition(n, "_o").sortWithinPartitions("_o").drop("_o")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that every source weighs alike, as many rows as there are documents on average."""
    return mix_sources(documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"))


ORACLE_OP3 = """
WITH RECURSIVE per AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT count(*) FROM documents)::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM per)::DOUBLE) / rows AS rate FROM per),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < rate + 12 * sqrt(rate) + 30
),
tables AS (SELECT source, rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, rate),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.rate AS mix_rate,
    len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5('17:' || d.doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))::INT AS mix_count
  FROM documents d JOIN tables t ON d.source = t.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, mix_count + 1))::INT AS mix_copy, mix_count, mix_rate FROM drawn WHERE mix_count > 0
"""
