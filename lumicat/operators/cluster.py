"""Topic clustering: tokens, TF-IDF, weighted spherical k-means, keyword clusters, summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators.rules import Rule, any_of, first_match
from lumicat.session import checkpointed

MAX_FEATURES, MIN_DF = 4096, 2


def tokens(col: Column, stop: list[str]) -> Column:
    """Words of two letters and more, word bigrams, and character 3- to 5-grams of words of four and more."""
    words = F.filter(F.split(fx.normalize_topic(col), " "), lambda w: (F.length(w) >= 2) & ~w.isin(stop))
    tagged = F.transform(words, lambda w: F.concat(F.lit("word:"), w))
    pairs = F.filter(F.transform(words, lambda w, i: F.when(i > 0, F.concat(F.lit("pair:"), F.get(words, i - 1), F.lit(" "), w))), lambda x: x.isNotNull())

    def cut(w: Column, n: int) -> Column:
        # sequence() would count down for words shorter than n
        return F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(f"char{n}:"), F.substring(w, i, n)))

    chars = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.concat(cut(w, 3), cut(w, 4), cut(w, 5))))
    made = F.concat(tagged, pairs, chars)
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.lit("word:прочее")))


def aggregate(rows: DataFrame) -> DataFrame:
    """topic, rows, programs, hours, weight per normalised topic of (topic, program, hours)."""
    out = rows.groupBy(fx.normalize_topic(F.col("topic")).alias("topic")).agg(F.count("*").alias("rows"), F.count_distinct("program").alias("programs"), F.sum(F.col("hours").cast("decimal(18,4)")).alias("hours"))
    return out.withColumn("weight", F.sqrt("rows") + F.sqrt("programs"))


def tfidf(topics: DataFrame, stop: list[str], max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """topic, token, value: L2-normalised weights of the most frequent tokens."""
    counted = topics.select("topic", F.explode(tokens(F.col("topic"), stop)).alias("token")).groupBy("topic", "token").agg(F.count("*").alias("tf"))
    features = counted.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("df"), "token").limit(max_features)
    total = topics.agg(F.count("*")).scalar()
    raw = counted.join(features, "token").select("topic", "token", ((1 + F.ln("tf")) * (F.ln((1 + total) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = raw.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "topic").select("topic", "token", (F.col("w") / F.col("norm")).alias("value"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _nearest(centres: list[list[float]]) -> Column:
    """A struct of similarity and minus the number of the most similar centre, the first on ties.

    A centre goes into the plan as one text that the optimizer folds to one array, not as a literal a dimension.
    """
    table = F.array(*[F.split(F.lit(",".join(map(repr, c))), ",").cast("array<double>") for c in centres])
    return F.array_max(F.transform(table, lambda c, i: F.struct(_dot(F.col("v"), c).alias("s"), (-i).alias("i"))))


def kmeans(points: DataFrame, k: int = 32, rounds: int = 80) -> DataFrame:
    """id, cluster, similarity, settled of unit vectors (id, v, weight), by weighted spherical k-means.

    Centres start with the heaviest point, then the one of largest distance
    times weight to the centres so far, or a point drawn by hash where there is no
    distance left; so is the next centre of a cluster that holds no point. ``k``
    points or fewer are clusters of their own. ``settled`` is false where the rounds
    ended before the labels stood still. Points of length 0 are left out. Only k
    centres ever reach the driver.
    """
    unit = points.select("id", "weight", F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("_n", F.sqrt(_dot(F.col("v"), F.col("v"))))
    unit = checkpointed(unit.where("_n > 0").select("id", "weight", F.transform("v", lambda x: x / F.col("_n")).alias("v")))
    if unit.limit(k + 1).count() <= k:
        number = F.row_number().over(Window.orderBy(F.desc("weight"), "id")) - 1  # k rows at most
        return unit.select("id", number.alias("cluster"), F.lit(1.0).alias("similarity"), F.lit(True).alias("settled"))
    drawn = lambda n: unit.orderBy(F.xxhash64("id", F.lit(n)), "id").limit(1).collect()[0]["v"]
    centres, kept = [unit.orderBy(F.desc("weight"), "id").limit(1).collect()[0]["v"]], 0
    near = unit.withColumn("best", F.lit(-1.0))
    for n in range(k - 1):
        best = F.greatest("best", _nearest(centres[kept:])["s"])
        far = near.select("v", "id", ((1 - best) * F.col("weight")).alias("s")).orderBy(F.desc("s"), "id").limit(1).collect()[0]
        centres.append(far["v"] if far["s"] > 1e-12 else drawn(n))
        if len(centres) - kept > 8:  # similarities to past centres are written now and then
            near, kept = checkpointed(near.withColumn("best", F.greatest("best", _nearest(centres[kept:-1])["s"]))), len(centres) - 1
    before, settled = None, False
    for n in range(rounds):
        moved, changed = _round(unit, centres, before)
        if before is not None and not changed:
            settled = True
            break
        if n == rounds - 1:
            break
        before, centres = centres, []
        for i in range(len(before)):
            v = moved[i] if i in moved else drawn(k * (n + 1) + i)
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            centres.append([x / norm for x in v])
    placed = unit.withColumn("b", _nearest(centres))
    return placed.select("id", (-F.col("b.i")).alias("cluster"), F.col("b.s").alias("similarity"), F.lit(settled).alias("settled"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length and their weights; points of different lengths are an error."""
    v = batch.column("v")
    width = len(v[0]) if len(v) else 0
    yield v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width), batch.column("weight").to_numpy(zero_copy_only=False)


def _round(unit: DataFrame, centres: list[list[float]], before: list[list[float]] | None) -> tuple[dict[int, list[float]], int]:
    """Weighted sums of the points of each centre, and how many points have another centre than ``before``: one pass over the points.

    Each task adds its own points up and hands on a row per centre; Spark adds the rows.
    """
    now, old = np.array(centres), None if before is None else np.array(before)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, changed = np.zeros(now.shape), np.zeros(len(now), dtype=bool), 0
        for batch in batches:
            for v, weight in _blocks(batch) if len(batch) else ():
                label = (v @ now.T).argmax(axis=1)
                if old is not None:
                    changed += int((label != (v @ old.T).argmax(axis=1)).sum())
                for c in np.unique(label).tolist():
                    mine = label == c
                    sums[c] += weight[mine] @ v[mine]
                    held[c] = True
        rows = np.flatnonzero(held)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(sums[rows].tolist(), pa.list_(pa.float64())), pa.array([changed] + [0] * (len(rows) - 1), pa.int64())], ["cluster", "v", "changed"])

    parts = unit.select("v", F.col("weight").cast("double").alias("weight")).mapInArrow(add, "cluster int, v array<double>, changed long")
    one = parts.select("cluster", "changed", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.sum(F.when(F.col("d") == 0, F.col("changed")).otherwise(0)).alias("changed"))
    got = one.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda r: r["x"]).alias("v"), F.sum("changed").alias("changed")).collect()
    return {r["cluster"]: r["v"] for r in got}, sum(r["changed"] for r in got)


def keyword_cluster(topic: Column, rules: tuple[Rule, ...], noise: str) -> Column:
    """The first of ordered clusters that a needle hits, after the noise filter."""
    key = fx.normalize_topic(topic)
    return first_match([((F.length(key) < 3) | key.rlike(noise), F.lit("noise"))] + [(any_of(key, r.needles), F.lit(r.code)) for r in rules], F.lit("other"))


def summary(placed: DataFrame) -> DataFrame:
    """cluster, topics, rows, programs, hours, examples, number: clusters renumbered by rows.

    ``placed`` has cluster, topic, rows, programs, hours.
    """
    out = placed.groupBy("cluster").agg(
        F.count("*").alias("topics"), F.sum("rows").alias("rows"), F.sum("programs").alias("programs"), F.sum("hours").alias("hours"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("m"), "topic"))), 1, 3), lambda x: x["topic"]), "; ").alias("examples"),
    )
    # one row per cluster
    return out.withColumn("number", F.row_number().over(Window.orderBy(F.desc("rows"), "cluster")).cast("bigint"))


def cluster_terms(weights: DataFrame, placed: DataFrame, most: int = 12) -> DataFrame:
    """cluster, terms: the heaviest tokens of each centre without character grams."""
    means = weights.where(~F.col("token").startswith("char")).join(placed, "topic").groupBy("cluster", "token").agg(F.sum("value").alias("s"))
    ranked = means.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("s", 9)), "token"))).where(F.col("rn") <= most)
    return ranked.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "token"))), lambda x: F.substring_index(x["token"], ":", -1)), ",").alias("terms"))
