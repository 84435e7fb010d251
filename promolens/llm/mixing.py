"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with weight w and b of the corpus's T bytes repeats w x T / b times on average. Each
document draws its count by inverting the Poisson distribution at a uniform number that a hash of
its id and the seed gives, so the draw never depends on partitions or retries; only rows that their
id doesn't tell apart add their place in the table. Rates above
PIECE are drawn as sums of independent Poisson numbers, which is the same distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import save, table, text_or_empty

PIECE = 32.0  # largest mean that one inversion draws
TERMS = 128  # terms of its distribution; what lies beyond has probability below 1e-30


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """One row per source (null: empty): bytes, rate, pieces, cdf of a piece.

    weights: target share of each source in bytes, made to add up to 1; sources not named get 0.
    Without weights, shares are proportional to bytes^temperature. A source without bytes has rate 1.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source")).agg(
        F.sum(F.octet_length(text_or_empty()).cast("double")).alias("bytes")
    )
    if weights is None:
        sizes = sizes.withColumn("share", F.pow("bytes", F.lit(temperature)))
    else:
        named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__source string, share double")
        sizes = sizes.join(named, "__source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    sizes = save(sizes, "sizes")
    total, shares = sizes.agg(F.sum("bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("share")))).first()
    rate = F.when(
        F.col("bytes") > 0, F.col("share") / F.lit(float(shares or 1.0)) * F.lit(float(total or 0.0)) / F.col("bytes")
    ).otherwise(F.lit(1.0))
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("pieces")

    def term(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("__mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    first = F.exp(-F.col("__mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        term,
        lambda a: a["cdf"],
    )
    rates = sizes.withColumn("rate", rate).withColumn("pieces", pieces).withColumn("__mean", mean)
    return save(rates.withColumn("cdf", cdf).drop("__mean"), "rates")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of seed and parts: 52 bits and a half."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    seed: int = 17,
    shuffle: bool = True,
    names: tuple[str, str] = ("n_copies", "copy"),
) -> DataFrame:
    """docs, each row repeated by its count, with the columns `names` of the number of copies and of the
    copy (from 1), in a global random order.

    A row's draw and its place in the order come from its id. Rows without an id, or with one that
    several rows have, add their place in the table as it is read, so each draws for itself and no
    key gathers them; docs should then be a table that is read, not the outcome of a shuffle. Null
    texts weigh nothing; null sources are one source; columns of `names` are replaced. An empty table
    gives no rows. The rates table is joined by source: Spark broadcasts it when its written size is
    below the session's limit and else splits skewed sources.
    """
    n_copies, copy = names
    rates = source_rates(docs, weights, temperature).select("__source", "pieces", "cdf")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")),
        F.lit(0),
        lambda n, r: n + F.size(F.filter("cdf", lambda c: c < uniform(seed, F.col("__draw"), r))),
    )
    df = _with_draw(docs).withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    df = df.join(rates, "__source").withColumn(n_copies, count).drop("__source", "pieces", "cdf")
    df = df.filter(F.col(n_copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    if not shuffle:
        return df.drop("__draw")
    key = F.xxhash64(F.lit(seed), "__draw", copy)
    return df.withColumn("__key", key).drop("__draw").repartition("__key").sortWithinPartitions("__key").drop("__key")


def _with_draw(docs: DataFrame) -> DataFrame:
    """docs with __draw, a text that differs from row to row: the id, and where that doesn't tell rows apart their place too."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    shared = save(docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id"), F.lit(True).alias("__shared")), "shared")
    if shared.isEmpty():
        return docs.withColumn("__draw", name)
    placed = docs.withColumn("__row", F.monotonically_increasing_id())
    placed = placed.join(shared, placed["doc_id"] == shared["__id"], "left")
    own = F.when(F.col("__shared") | F.col("doc_id").isNull(), F.concat_ws("#", name, F.col("__row").cast("string"))).otherwise(name)
    return placed.withColumn("__draw", own).drop("__row", "__id", "__shared")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, temperature 0.5: doc_id, source, text and the copy's number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return replicate(docs).select("doc_id", "source", "text", "n_copies", "copy")


#: The same in DuckDB. The distribution of a piece is summed in the same order.
OP8_SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS src, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM documents GROUP BY 1
), shares AS (
  SELECT src, bytes, sqrt(bytes) AS share FROM sizes
), totals AS (
  SELECT sum(bytes) AS total, sum(share) FILTER (bytes > 0) AS shares FROM shares
), rates AS (
  SELECT src, CASE WHEN bytes > 0 THEN share / shares * total / bytes ELSE 1.0 END AS rate FROM shares, totals
), pieces AS (
  SELECT src, greatest(ceil(rate / 32.0), 1)::INT AS m, rate / greatest(ceil(rate / 32.0), 1) AS mean FROM rates
), terms(src, m, mean, k, p, c) AS (
  SELECT src, m, mean, 0, exp(-mean), exp(-mean) FROM pieces
  UNION ALL
  SELECT src, m, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < 128
), cdf AS (
  SELECT src, any_value(m) AS m, list(c ORDER BY k) AS cdf FROM terms GROUP BY src
), draws AS (
  SELECT d.doc_id, d.source, d.text,
         list_sum(list_transform(range(1, m + 1), lambda r: len(list_filter(cdf, lambda c: c <
           (('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || r), 1, 13))::BIGINT + 0.5) / 4503599627370496.0
         ))))::INT AS n_copies
  FROM documents d JOIN cdf ON coalesce(d.source, '') = cdf.src
)
SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1))::INT AS "copy" FROM draws WHERE n_copies > 0
"""
