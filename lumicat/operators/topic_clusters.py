"""Weighted spherical k-means of sparse rows, such as the TF-IDF weights of topics.

Points are rows (id, token, value) and weights rows (id, weight). Centres are a table of one row per token with the values
of all centres, so similarities are sums over an equi-join on tokens; it is broadcast while it is small. No vector is ever dense
and none reaches the driver.

Points keep a lower bound of the similarity to their own centre and an upper bound of that to any other. A centre
that moves by d changes similarities by d at most, so only points whose bounds have met are compared again, and only
those that change their cluster change the sums of centres.

The first centre is the heaviest point, then each time the point of largest weight times distance to the centres so far, or a
point drawn by hash where no distance is left; so is the next centre of a cluster that holds no point. ``k`` points or fewer
are clusters of their own. Similarities are compared to nine digits, the first of equal clusters wins. Points without a value
other than 0 are left out. ``settled`` is false where the rounds ended before the labels stood still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.operators.dictionary import sized
from lumicat.session import checkpointed

DIGITS = 9


def unit_rows(rows: DataFrame) -> DataFrame:
    """id, token, value of length 1; null and zero values are no values, equal tokens of a point add up."""
    own = rows.where("id is not null and token is not null and value <> 0").groupBy("id", "token").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0")
    norms = own.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    return own.join(norms, "id").select("id", "token", (F.col("value") / F.col("n")).alias("value"))


def _drawn(points: DataFrame, seed: int):
    return points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()[0]["id"]


def _first_centres(rows: DataFrame, points: DataFrame, k: int) -> list:
    """Ids of k points; each is looked for beside the best similarity to those before it."""
    centres = [points.orderBy(F.desc("weight"), "id").limit(1).collect()[0]["id"]]
    near = points.withColumn("best", F.lit(0.0))
    for n in range(1, k):
        last = rows.where(F.col("id") == centres[-1]).select("token", F.col("value").alias("c"))  # one point
        like = rows.join(F.broadcast(last), "token").groupBy("id").agg(F.sum(F.col("value") * F.col("c")).alias("s"))
        near = checkpointed(near.join(like, "id", "left").select("id", "weight", F.greatest("best", F.coalesce(F.round("s", DIGITS), F.lit(0.0))).alias("best")))
        far = near.select("id", F.round((1 - F.col("best")) * F.col("weight"), DIGITS).alias("s")).orderBy(F.desc("s"), "id").limit(1).collect()[0]
        centres.append(far["id"] if far["s"] > 0 else _drawn(points, n))
    return centres


def _table(centres: DataFrame, k: int) -> DataFrame:
    """token, c (values of all centres) of rows (cluster, token, value)."""
    return centres.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "value"))).alias("m")).select("token", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("c"))


def _similar(rows: DataFrame, table: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """id, cluster, low (similarity to it), high (to the best other) of ``points``."""
    sums = rows.join(table, "token").groupBy("id").agg(*[F.sum(F.col("value") * F.get("c", F.lit(i))).alias(f"s{i}") for i in range(k)])
    value = lambda i: F.coalesce(F.round(f"s{i}", DIGITS), F.lit(0.0))
    ranked = F.sort_array(F.array(*[F.struct(value(i).alias("s"), F.lit(-i).alias("i")) for i in range(k)]), asc=False)
    return points.select("id").join(sums, "id", "left").select("id", ranked.alias("r")).select("id", (-F.get("r", F.lit(0))["i"]).alias("cluster"), F.get("r", F.lit(0))["s"].alias("low"), F.get("r", F.lit(1))["s"].alias("high"))


def _sums(rows: DataFrame, points: DataFrame, labels: DataFrame, sign: Column) -> DataFrame:
    weighted = rows.join(labels.join(points, "id").select("id", "cluster", (F.col("weight") * sign).alias("w")), "id")
    return weighted.groupBy("cluster", "token").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def _centres(sums: DataFrame, sizes: DataFrame, rows: DataFrame, points: DataFrame, k: int, number: int) -> DataFrame:
    """cluster, token, value of length 1; a cluster without points gets a drawn one."""
    held = {r["cluster"] for r in sizes.where("n > 0").select("cluster").collect()}
    norms = sums.groupBy("cluster").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n")).where("n > 0")
    made = sums.join(norms, "cluster").select("cluster", "token", (F.col("value") / F.col("n")).alias("value"))
    made = made.where(F.col("cluster").isin(sorted(held)))
    for i in sorted(set(range(k)) - held):
        made = made.unionByName(rows.where(F.col("id") == _drawn(points, k * (number + 1) + i)).select(F.lit(i).alias("cluster"), "token", "value"))
    return made


def sparse_kmeans(rows: DataFrame, weights: DataFrame, k: int = 32, rounds: int = 80, most: int | None = None) -> DataFrame:
    """id, cluster, similarity, settled of points (id, token, value) with weights (id, weight)."""
    rows = checkpointed(unit_rows(rows))
    points = checkpointed(rows.select("id").distinct().join(weights.groupBy("id").agg(F.max(F.col("weight").cast("double")).alias("weight")), "id", "left").select("id", F.coalesce("weight", F.lit(1.0)).alias("weight")))
    if points.limit(k + 1).count() <= k:
        number = F.row_number().over(Window.orderBy(F.desc("weight"), "id")) - 1  # k rows at most
        return points.select("id", number.alias("cluster"), F.lit(1.0).alias("similarity"), F.lit(True).alias("settled"))
    first = _first_centres(rows, points, k)
    seeds = points.sparkSession.createDataFrame(list(enumerate(first)), f"cluster int, id {dict(points.dtypes)['id']}")
    centres = checkpointed(rows.join(F.broadcast(seeds), "id").select("cluster", "token", "value"))
    state = checkpointed(_similar(rows, sized(_table(centres, k), most), points, k))
    sums = checkpointed(_sums(rows, points, state, F.lit(1)))
    settled = False
    for n in range(rounds):
        sizes = state.groupBy("cluster").agg(F.count("*").alias("n"))
        moved = checkpointed(_centres(sums, sizes, rows, points, k, n))
        apart = centres.withColumn("value", -F.col("value")).unionByName(moved).groupBy("cluster", "token").agg(F.sum("value").alias("d"))
        shift = [0.0] * k
        for r in apart.groupBy("cluster").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d")).collect():  # k rows
            shift[r["cluster"]] = r["d"] + 10.0**-DIGITS
        centres = moved
        bounded = state.select("id", "cluster", (F.col("low") - F.get(F.array(*map(F.lit, shift)), F.col("cluster"))).alias("low"), (F.col("high") + max(shift)).alias("high"))
        bounded = checkpointed(bounded)
        open_ = bounded.where("low <= high").select("id", F.col("cluster").alias("was"))
        again = checkpointed(_similar(rows.join(open_, "id", "left_semi"), sized(_table(centres, k), most), open_, k).join(open_, "id"))
        changed = checkpointed(again.where("cluster <> was"))
        if changed.isEmpty():
            settled = True
            break
        state = checkpointed(bounded.where("low > high").unionByName(again.select("id", "cluster", "low", "high")))
        gone = _sums(rows, points, changed.select("id", F.col("was").alias("cluster")), F.lit(-1))
        come = _sums(rows, points, changed.select("id", "cluster"), F.lit(1))
        sums = checkpointed(sums.unionByName(gone).unionByName(come).groupBy("cluster", "token").agg(F.sum("value").alias("value")).where(F.abs("value") > 1e-12))
    labels = state.select("id", "cluster")
    like = rows.join(labels, "id").join(centres.withColumnRenamed("value", "c"), ["cluster", "token"]).groupBy("id").agg(F.sum(F.col("value") * F.col("c")).alias("s"))
    return labels.join(like, "id", "left").select("id", "cluster", F.coalesce("s", F.lit(0.0)).alias("similarity"), F.lit(settled).alias("settled"))
