"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of all text over its
own size. Each document draws its count from a Poisson distribution of that
mean by inverting the distribution at a uniform number hashed from its id and
a seed, is exploded by the count, and the copies are sorted globally by another
hash. The draws depend on (doc_id, seed) only, so a lost executor or another
partitioning changes nothing.

Defined cases: a null source is a source of its own, named ``(none)``; a null or
empty text has size 0, and a source of size 0 keeps every document once. ``weights`` that give
no source of the table a weight ask for nothing: all rates are 0. Rows
that repeat a ``doc_id`` draw alike. An empty table gives no rows. Existing
columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.text import unused

SEED = 17
#: A source's target weight is its size to this power (1: as it is, 0: all sources alike).
TEMPERATURE = 0.5
#: Sources up to this many rows are joined by broadcast: about 40 bytes each.
BROADCAST_SOURCES = 50_000
#: Above this rate counts are summed from below the mean instead of from 0.
LARGE_RATE = 500.0


def uniform(*parts: Column | str) -> Column:
    """A uniform number in (0, 1) from the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """_source, _rate: one row per source, from sizes over all documents.

    ``weights`` gives target weights by source (others weigh 0); without it a
    source weighs its size to the power ``temperature``.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("(none)")).alias("_source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("_size"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow("_size", F.lit(temperature)))
    else:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weighed = sizes.withColumn("_weight", F.coalesce(table[F.col("_source")], F.lit(0.0)) if weights else F.lit(0.0))
    total = weighed.agg(F.struct(F.sum("_size").alias("size"), F.sum("_weight").alias("weight")).alias("_all")).scalar()
    share = F.coalesce(F.try_divide(F.col("_weight") * total["size"], total["weight"]), F.lit(0.0)) / F.col("_size")
    return weighed.select("_source", F.when(F.col("_size") > 0, share).otherwise(F.lit(1.0)).alias("_rate"))


def _log_term(rate: Column, k: Column) -> Column:
    """ln P(X = k) for large k: Stirling's series, with the parts that cancel each other taken together."""
    e = (k - rate) / rate
    stirling = 1 / (12 * k) - 1 / (360 * k * k * k)
    return -rate * ((1 + e) * F.log1p(e) - e) - F.log(2 * math.pi * k) / 2 - stirling


def poisson_count(rate: Column, u: Column) -> Column:
    """The smallest k with u < P(X <= k): a fold over the terms of the series.

    Enough terms are summed for a rounding error of 1e-15 of the upper tail. As
    ``exp(-rate)`` vanishes for large rates, the fold then begins 12 deviations
    below the mean, with a term from its logarithm; what lies below is under
    1e-30, less than any ``u``.
    """
    large = rate > LARGE_RATE
    begin = F.when(large, F.floor(rate - 12 * F.sqrt(rate))).otherwise(0).cast("int")
    terms = F.sequence(begin + 1, F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    first = F.when(large, F.exp(_log_term(rate, begin.cast("double")))).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("cdf"), F.when(u < first, begin).otherwise(begin + 1).cast("int").alias("n"))
    return F.aggregate(
        terms,
        start,
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            (s["cdf"] + s["p"] * rate / k).alias("cdf"),
            F.when(u < s["cdf"] + s["p"] * rate / k, s["n"]).otherwise(s["n"] + 1).cast("int").alias("n"),
        ),
        lambda s: s["n"],
    )


def with_rates(docs: DataFrame, rates: DataFrame, name: str = "_rate", salts: int = 64) -> DataFrame:
    """Adds a column of rates; broadcast below a checked size, else a join by source and salt."""
    src, salt = unused(docs, "_source", "_salt")
    named = docs.withColumn(src, F.coalesce("source", F.lit("(none)")))
    rates = rates.select(F.col("_source").alias(src), F.col("_rate").alias(name))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return named.join(F.broadcast(rates), src).drop(src)
    salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return named.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, [src, salt]).drop(src, salt)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per copy with ``rate``, ``n_copies``, ``replica`` and ``shuffle_key``, in global order."""
    own = [c for c in docs.columns if c not in ("rate", "n_copies", "replica", "shuffle_key")]
    (rate,) = unused(docs, "_rate")
    drawn = with_rates(docs.select(*[F.col(f"`{c}`") for c in own]), source_rates(docs, weights, temperature), rate)
    counted = drawn.withColumn("n_copies", poisson_count(F.col(rate), uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    copies = counted.where("n_copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.col("doc_id").cast("string"), F.col("replica").cast("string"))))
    return keyed.select(*[F.col(f"`{c}`") for c in own], F.col(rate).alias("rate"), "n_copies", "replica", "shuffle_key").orderBy("shuffle_key", "doc_id", "replica")


def expected_share(size: float, total: float, temperature: float = TEMPERATURE) -> float:
    """The weight of one source, for tests on small tables."""
    return math.pow(size, temperature) / total
