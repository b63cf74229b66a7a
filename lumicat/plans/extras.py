"""Smaller operators: profile context, fixed catalogues, text heuristics, initial centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import cluster
from lumicat.plans.registry import register
from lumicat.session import table

@register(
    "rank_context",
    """select c_custkey, case when c_nationkey % 4 = 0 then 's3' when c_nationkey % 4 = 1 then 's4' else 's1' end as scenario, c_custkey % 19 as years,
    case when c_custkey % 19 between 3 and 18 then (c_custkey % 19) * 12 end::bigint as low, case when c_custkey % 19 between 3 and 18 then (c_custkey % 19) * 12 + 11 end::bigint as high,
    try_cast(nullif(case when c_custkey % 5 = 0 then '' else (c_custkey % 7 * 500)::varchar end, '') as bigint) as budget from customer""",
)
def rank_context(spark, sf_dir):
    """Profiles normalised once: scenario, age in months, budget as a number."""
    years = F.col("c_custkey") % 19
    known = years.between(3, 18)
    budget = F.when(F.col("c_custkey") % 5 == 0, "").otherwise((F.col("c_custkey") % 7 * 500).cast("string"))
    scenario = F.when(F.col("c_nationkey") % 4 == 0, "s3").when(F.col("c_nationkey") % 4 == 1, "s4").otherwise("s1")
    return table(spark, sf_dir, "customer").select("c_custkey", scenario.alias("scenario"), years.alias("years"), F.when(known, years * 12).alias("low"), F.when(known, years * 12 + 11).alias("high"), fx.extract_number(budget).alias("budget"))


@register(
    "rank_text_legacy",
    """select p_partkey, (case when contains(p_name, 'ring') then 2 else 0 end + case when contains(p_name, 'gear') then 2 else 0 end - case when contains(p_name, 'old') then 2 else 0 end
    + case when p_type = 'PROMO' then 8 else 0 end + case when p_size % 2 = 0 then 2 else 0 end)::int as score from part""",
)
def rank_text_legacy(spark, sf_dir):
    """The older scorer on text alone: interests, avoidances, direction, adaptation."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    name = F.col("p_name")
    score = points(name.contains("ring"), 2) + points(name.contains("gear"), 2) - points(name.contains("old"), 2) + points(F.col("p_type") == "PROMO", 8) + points(F.col("p_size") % 2 == 0, 2)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


MOCK = [(1, "robot lab", "tech", "7-9"), (2, "dance", "art", "5-6"), (3, "chess", "logic", "10-12"), (4, "swimming", "sport", "7-9"), (5, "debates", "social", "13+")]


@register("rank_mock", "select user_id, (array['robot lab','dance','chess','swimming','debates'])[(case user_id % 4 when 0 then 1 when 1 then 3 when 2 then 4 else 5 end)] as program from (select distinct user_id from events)")
def rank_mock(spark, sf_dir):
    """The fallback catalogue of five, matched by interest; each user's first hit."""
    programs = spark.createDataFrame(MOCK, "id int, program string, interest string, age string")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    wanted = F.when(F.col("user_id") % 4 == 0, "tech").when(F.col("user_id") % 4 == 1, "logic").when(F.col("user_id") % 4 == 2, "sport").otherwise("social")
    return users.withColumn("interest", wanted).join(programs, "interest").groupBy("user_id").agg(F.min(F.struct("id", "program"))["program"].alias("program"))


@register("clu_init")
def clu_init(spark, sf_dir):
    """Points by their initial centre: farthest-point choice without a refining round."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"))
    return cluster.kmeans(points, k=5, rounds=1).select("id", "cluster")


@register("rank_enrich", "select p_partkey, p_name, n from (select p_partkey, p_name, p_size from part order by p_size desc, p_partkey limit 12) join (select l_partkey, count(*)::bigint as n from lineitem group by 1) on l_partkey = p_partkey")
def rank_enrich(spark, sf_dir):
    """Details for the first few only: the join is reduced to their keys before it aggregates."""
    few = table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(12).select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey").join(few, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_partkey", "p_name").agg(F.count("*").alias("n"))
