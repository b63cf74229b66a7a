"""Ranking queries: parts as programmes, their line items as enrolment groups, words of names as topics."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import profile_ranking, ranking
from lumicat.plans.registry import register
from lumicat.session import table

FIND = ranking.Profile(
    municipality_id=3, organization="Brand#1", age_months=(40, 150), age_years=8, budget=1500.0, interests=(("ring", "gear"), ("cat_b", "bolt")), specific_terms=("anvil", "cat_r"),
    excluded_terms=("widget",), direction="PROMO", days=("weekend",), periods=("evening",), group_size="small", form=2, completed_ids=tuple(range(0, 400, 17)),
)
OPEN = ranking.Profile(age_months=(40, 250), budget=30000.0, interests=(("ring", "gear"), ("cat_b", "bolt")), direction="PROMO", days=("weekend",), periods=("evening",), group_size="small")
DEEP = ranking.Profile(scenario="s3", age_years=8, topic_keys=("ring", "blue"), category_keys=("cat_g",), parent_keys=("par_4",), average_hours=3.0, advanced=("anvil", "gizmo"))
WIDE = ranking.Profile(scenario="s4", age_years=8, topic_keys=("ring",), category_keys=("cat_r",), parent_keys=("par_4",))


def candidates(spark, sf_dir, profile=None):
    """One nested row per part; groups are gathered after a narrow projection.

    With a profile only parts that may pass its hard filters are left, and only their groups are gathered.
    """
    lines = table(spark, sf_dir, "lineitem")
    size = F.col("p_size")
    topic = lambda w: F.struct(w.alias("key"), w.alias("name"), F.concat(F.lit("cat_"), F.left(w, F.lit(1))).alias("category"), F.concat(F.lit("par_"), F.length(w).cast("string")).alias("parent"), (size % 9).alias("hours"), (size % 4).alias("practice"))
    topics = F.when(size % 4 != 0, F.transform(F.split("p_name", " "), topic)).otherwise(F.transform(F.filter(F.split("p_name", " "), lambda w: F.lit(False)), topic))
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("municipality_id"))
    first = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("supp")).join(place, F.col("supp") == F.col("s_suppkey"), "left").select("l_partkey", "municipality_id")
    parts = table(spark, sf_dir, "part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("organization"), F.col("p_type").alias("direction"), "municipality_id",
        F.nullif(size % 3, F.lit(0)).alias("form"), (size % 6).alias("level"), F.when(size % 10 == 0, 3).otherwise(1).alias("enrollment"),
        (size * 6).alias("age_min"), F.when(size % 11 != 0, size * 6 + 36).alias("age_max"), F.array(F.lower("p_type")).alias("keywords"),
        F.array(F.struct((size % 20).alias("low"), (size % 20 + 4).alias("high"))).alias("modules"), topics.alias("topics"), (size % 9 != 0).alias("topics_known"), F.lit("about ring work").alias("annotation"),
    )
    if profile is not None:
        parts = parts.where(ranking.may_pass(profile))
        lines = lines.join(parts.select("id"), F.col("l_partkey") == F.col("id"), "left_semi")
    groups = lines.select(
        "l_partkey",
        F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") - 10).cast("int").alias("free"),
            fx.weekday(F.date_format("l_shipdate", "EEE")).alias("day"), (F.col("l_linenumber") * 3).alias("hour"),
        ).alias("g"),
    ).groupBy("l_partkey").agg(F.array_sort(F.collect_list("g")).alias("groups"))
    return parts.join(groups, F.col("id") == F.col("l_partkey"), "left").drop("l_partkey")


def _term(text: str, terms) -> str:
    return "(" + " or ".join(f"contains({text}, '{t.lower()}')" for t in terms) + ")" if terms else "false"


def _words(test: str) -> str:
    return f"len(list_filter(topics, lambda w: {test})) > 0"


def _isin(value: str, keys) -> str:
    return f"{value} in ({', '.join(repr(k) for k in keys)})" if keys else "false"


_KEY, _CAT, _PAR = "w", "'cat_' || w[1]", "'par_' || len(w)"
_NAMED = "lower(p_name || ' ' || p_type)"


def _specific(terms) -> str:
    if not terms:
        return "0"
    return f"case when {_words(_term('w', terms))} then 180 when {_words(_term(_CAT, terms))} then 130 when {_words(_term(_PAR, terms))} then 80 when {_term(_NAMED, terms)} then 110 when len(topics) = 0 and {_term("'about ring work'", terms)} then 40 else 0 end"


def _interest(interests) -> str:
    parts = [f"case when {_words(_term('w', t))} then 100 when {_words(_term(_CAT, t))} then 70 when {_words(_term(_PAR, t))} then 30 when len(topics) = 0 and {_term(_NAMED, t)} then 20 when len(topics) = 0 and {_term("'about ring work ' || lower(p_type)", t)} then 10 else 0 end" for t in interests]
    return f"least(200, {' + '.join(parts)})" if parts else "0"


def scored_sql(p: ranking.Profile) -> str:
    """The whole cascade and all criteria for the profiles above, as common table expressions."""
    schedule = "case when isodow(l_shipdate) >= 6 and l_linenumber * 3 >= 17 then 60 when isodow(l_shipdate) >= 6 or l_linenumber * 3 >= 17 then 30 else -60 end" if p.days else "0"
    exact = _words(_term("w", [t for i in p.interests for t in i])) if p.interests else "false"
    wide_out = f"case when len(topics) = 0 then true else {_words(_isin(_CAT, p.category_keys))} end"
    wide = f"least(200, case when {_words('not ' + _isin(_PAR, p.parent_keys))} then 100 else 0 end + case when {_words(_isin(_PAR, p.parent_keys))} then 40 else 0 end + least(50, 10 * len(list_distinct(topics))) + case when level in (1, 2, 4, 5) then 50 else 0 end)"
    same, second, first = _words(_isin(_KEY, p.topic_keys)), _words(f"{_isin(_CAT, p.category_keys)} and not {_isin(_KEY, p.topic_keys)}"), _words(f"{_isin(_PAR, p.parent_keys)} and not {_isin(_CAT, p.category_keys)}")
    advanced = f"regexp_matches(lower(p_name || ' about ring work ' || p_type || ' ' || array_to_string(topics, ' ')), '{'|'.join(p.advanced)}')"
    years = f"floor((p_size * 6 + 6) / 12.0) between {p.age_years} - 1 and {p.age_years}" if p.age_years is not None else "false"
    hours = f"len(topics) > 0 and (p_size % 9)::double > {p.average_hours or 0}::double * 1.15" if p.average_hours else "false"
    practice = "len(topics) > 0 and p_size % 4 > 0 and (p_size % 4) * len(topics) >= (p_size % 9) * len(topics) * 0.4::double"
    deep = f"case when {same} or {second} or {first} then least(200, case when {same} then 30 else 0 end + case when {second} then 70 else 0 end + case when {first} then 40 else 0 end + case when depth > 0 then 80 else 0 end - case when depth = 0 and {same} and not {second} and not {first} then 10 else 0 end) end"
    trajectory = deep if p.scenario == "s3" else f"case when not ({wide_out}) then {wide} end" if p.scenario == "s4" else "0"
    lost = "no_completed_topic_link" if p.scenario == "s3" else "repeated_or_empty_topics"
    org = f"(contains(lower(p_brand), '{(p.organization or '').lower()}') or contains('{(p.organization or '').lower()}', lower(p_brand)))" if p.organization else "true"
    age = f"(p_size * 6 <= {p.age_months[1]} and (p_size % 11 = 0 or p_size * 6 + 36 >= {p.age_months[0]}))" if p.age_months else "true"
    done = f"p_partkey in ({', '.join(map(str, p.completed_ids))})" if p.completed_ids else "false"
    form = f"(p_size % 3 <> 0 and p_size % 3 <> {p.form})" if p.form is not None else "false"
    wanted = (p.direction or "").lower()
    direction = f"case when contains(lower(p_type), '{wanted}') or contains('{wanted}', lower(p_type)) then 30 when exact_topic or specific > 0 then 0 else -30 end" if p.direction else "0"
    size = "case when p_size % 20 + 2 <= 10 or p_size % 20 + 4 <= 10 then 20 else -20 end" if p.group_size else "0"
    bucket = "case when specific = 0 then 40 when not age_eligible then 30 when enrollment <> 3 and open_groups > 0 then 10 else 20 end" if p.specific_terms else "0"
    return f"""g as (select l_partkey, count(*) as n_groups, min(l_extendedprice) as low, count(*) filter (where l_quantity > 10) as open_groups, max({schedule}) as schedule, min(l_suppkey) as supp from lineitem group by 1),
    c as (select part.*, g.*, n_regionkey as municipality_id, case when p_size % 4 <> 0 then string_split(p_name, ' ') else []::varchar[] end as topics, p_size % 6 as level, case when p_size % 10 = 0 then 3 else 1 end as enrollment
      from part left join g on l_partkey = p_partkey left join supplier on s_suppkey = supp left join nation on n_nationkey = s_nationkey),
    f as (select *, {_specific(p.specific_terms)} as specific, {_specific(p.excluded_terms)} as excluded_hit, {age} as age_eligible, {_interest(p.interests)} as interest, {exact} as exact_topic,
      case when p_size % 9 = 0 then 0 when len(topics) = 0 then -10 else 10 end as presence, case when enrollment = 3 then -25 when n_groups is null then 0 when open_groups > 0 then 50 else 25 end as availability, {size} as group_size,
      (level in (2, 3, 5))::int + ({advanced})::int + ({years})::int + ({hours})::int + ({practice})::int as depth from c),
    h as (select *, {direction} as direction_score, {trajectory} as trajectory,
      case when {f'municipality_id is not null and municipality_id <> {p.municipality_id}' if p.municipality_id is not None else 'false'} then 'municipality_mismatch' when not {org} then 'organization_mismatch' when excluded_hit > 0 then 'excluded_specific_interest'
        when not age_eligible and specific = 0 then 'age_mismatch' when not age_eligible then null when {f'low > {p.budget}' if p.budget is not None else 'false'} then 'budget_mismatch' when {done} then 'completed_program' when {form} then 'education_form_mismatch' end as filter_reason from f),
    r as (select *, coalesce(filter_reason, case when {'interest = 0 and specific = 0' if p.interests else 'false'} then 'interest_mismatch' end, case when trajectory is null then '{lost}' end) as reason, {bucket} as bucket from h),
    scored as (select *, p_partkey as id, case when reason is null then presence + specific + interest + coalesce(schedule, 0) + availability + direction_score + group_size + coalesce(trajectory, 0) else 0 end::int as score from r)"""


def scored(spark, sf_dir, profile):
    return ranking.score(candidates(spark, sf_dir), profile)


def criterion(name: str, profile: ranking.Profile, columns: dict[str, str]) -> None:
    """Registers one criterion over all candidates: output names to SQL expressions."""

    def query(spark, sf_dir):
        return scored(spark, sf_dir, profile).select("id", *[F.col(c).cast("int").alias(c) if kind == "int" else F.col(c) for c, kind in columns.items()])

    register(name, f"with {scored_sql(profile)} select id, {', '.join(f'{c}::int as {c}' if kind == 'int' else c for c, kind in columns.items())} from scored")(query)


criterion("rank_specific", FIND, {"specific": "int", "excluded_hit": "int"})
criterion("rank_interest", FIND, {"interest": "int"})
criterion("rank_topic_presence", OPEN, {"presence": "int"})
criterion("rank_availability", OPEN, {"availability": "int"})
criterion("rank_direction", FIND, {"direction_score": "int"})
criterion("rank_group_size", OPEN, {"group_size": "int"})
criterion("rank_age", FIND, {"age_eligible": ""})
criterion("rank_hard_filters", FIND, {"filter_reason": ""})
criterion("rank_depth", DEEP, {"depth": "int"})
criterion("rank_deep", DEEP, {"trajectory": "int", "reason": "", "score": "int"})
criterion("rank_wide", WIDE, {"trajectory": "int", "reason": "", "score": "int"})
criterion("rank_total", OPEN, {"presence": "int", "interest": "int", "availability": "int", "direction_score": "int", "group_size": "int", "score": "int"})
criterion("rank_bucket", FIND, {"bucket": "int", "score": "int"})


@register("rank_schedule", f"with {scored_sql(OPEN)} select id, coalesce(schedule, 0)::int as schedule from scored")
def rank_schedule(spark, sf_dir):
    return scored(spark, sf_dir, OPEN).select("id", "schedule")


@register("rank_org", "select p_partkey as id, contains(lower(p_brand), 'brand#1') or contains('brand#1', lower(p_brand)) as passes from part")
def rank_org(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", ranking.matches_organization("Brand#1").alias("passes"))


@register("rank_budget", f"with {scored_sql(FIND)} select id, coalesce(low <= 1500, true) as passes from scored")
def rank_budget(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", ranking.matches_budget(1500.0).alias("passes"))


@register("rank_form", "select p_partkey as id, p_size % 3 in (0, 2) as passes from part")
def rank_form(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", ranking.matches_form(2).alias("passes"))


@register("flt_hard_cascade", f"with {scored_sql(FIND)} select reason, count(*)::bigint as n from scored group by 1")
def flt_hard_cascade(spark, sf_dir):
    return scored(spark, sf_dir, FIND).groupBy("reason").agg(F.count("*").alias("n"))


@register("rank_reason_counts", f"with {scored_sql(DEEP)} select reason, count(*)::bigint as n from scored group by 1")
def rank_reason_counts(spark, sf_dir):
    return scored(spark, sf_dir, DEEP).groupBy("reason").agg(F.count("*").alias("n"))


@register("rank_topk", f"with {scored_sql(OPEN)} select id, p_name as name, score from scored where score > 0 order by score desc, id limit 10")
def rank_topk(spark, sf_dir):
    found = ranking.score(candidates(spark, sf_dir, OPEN), OPEN)
    return ranking.top(found).select("id", "name", F.col("score").cast("int").alias("score"))


@register("rank_best_group", """select id, best, score::int as score from (select l_partkey as id, l_orderkey * 10 + l_linenumber as best, s as score, row_number() over (partition by l_partkey order by s desc, l_orderkey * 10 + l_linenumber, l_extendedprice, (l_quantity - 10)::int, lower(dayname(l_shipdate))) as rn from (
    select *, case when l_extendedprice <= 30000 then 3 when l_extendedprice <= 37500 then -1 else -4 end + case when isodow(l_shipdate) >= 6 then 1 else 0 end + case when l_linenumber * 3 >= 17 then 1 else -1 end + case when l_quantity > 10 then 1 else 0 end as s from lineitem)) where rn = 1""")  # fmt: skip
def rank_best_group(spark, sf_dir):
    best = candidates(spark, sf_dir).where("groups is not null").select("id", ranking.best_group(OPEN).alias("b"))
    return best.select("id", F.col("b.id").alias("best"), F.col("b.score").alias("score"))


@register("rank_result_state", f"with {scored_sql(OPEN)} select count(*)::bigint as candidates, count(*) filter (where score > 0)::bigint as ranked, count(*) filter (where score > 0) < 3 as sparse, case when count(*) = 0 then 'no_candidates' when count(*) filter (where score > 0) = 0 then 'filtered_out' else '' end as empty_reason from scored")
def rank_result_state(spark, sf_dir):
    out = scored(spark, sf_dir, OPEN).agg(F.count("*").alias("candidates"), F.count_if(F.col("score") > 0).alias("ranked"))
    reason = F.when(F.col("candidates") == 0, "no_candidates").when(F.col("ranked") == 0, "filtered_out").otherwise("")
    return out.select("candidates", "ranked", (F.col("ranked") < 3).alias("sparse"), reason.alias("empty_reason"))


@register("rank_completed", "select o_custkey, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) as programs, max(p_size)::bigint as low, min(p_size + 9)::bigint as high from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where rn <= 2 group by 1")
def rank_completed(spark, sf_dir):
    """Programmes of each user's latest orders and the age range they share."""
    from pyspark.sql import Window

    latest = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))).where("rn <= 2")
    done = latest.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return done.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("programs"), F.max("p_size").cast("bigint").alias("low"), F.min(F.col("p_size") + 9).cast("bigint").alias("high"))


@register("rank_topic_groups", "with t as (select distinct 'par_' || len(w) as parent, 'cat_' || w[1] as category from (select unnest(string_split(p_name, ' ')) as w from part)), n as (select *, row_number() over (partition by parent order by category) as rn from t) select parent, string_agg(category, ',' order by rn) as categories from n where rn <= 3 group by 1 order by parent limit 4")
def rank_topic_groups(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    groups = words.groupBy(F.concat(F.lit("par_"), F.length("w").cast("string")).alias("parent")).agg(F.array_join(F.slice(F.sort_array(F.collect_set(F.concat(F.lit("cat_"), F.left("w", F.lit(1))))), 1, 3), ",").alias("categories"))
    return groups.orderBy("parent").limit(4)


@register("rank_card")
def rank_card(spark, sf_dir):
    """Cards of the ranked programmes; ``tests/test_operators.py`` makes them again from the tables."""
    found = ranking.top(ranking.score(candidates(spark, sf_dir, OPEN), OPEN))
    return ranking.cards(found, OPEN, focus=("building", "logic"))


_SEGMENTS = {"AUTOMOBILE": [["gear", "bolt"], ["rod"]], "BUILDING": [["plate"], ["cat_b", "anvil"]], "FURNITURE": [["widget", "ring"]], "MACHINERY": [["gizmo", "cat_g"], ["blue"]], "HOUSEHOLD": []}
_DAYS, _PERIODS = [["weekend"], ["weekday"], []], [["evening"], [], ["morning", "day"], []]


def asked_profiles(spark, sf_dir):
    """One profile per customer."""
    key = F.col("c_custkey")
    pick = lambda values, kind: F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), (key % len(values) + 1).cast("int"))
    interests = F.from_json(F.lit(json.dumps(_SEGMENTS)), "map<string, array<array<string>>>")[F.col("c_mktsegment")]
    place = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("profile_id"), F.when(key % 7 != 0, F.col("n_regionkey")).alias("municipality_id"), F.when(key % 6 == 0, "Brand#1").alias("organization"),
        F.when(key % 11 != 0, 12 + key * 13 % 250).cast("int").alias("age_from"), F.when(key % 11 != 0, 36 + key * 13 % 250).cast("int").alias("age_to"),
        F.when(key % 5 != 0, 1000 + key * 37 % 4000).cast("double").alias("budget"), interests.alias("interests"), F.when(key % 3 != 0, "PROMO").alias("direction"),
        pick(_DAYS, "array<string>").alias("days"), pick(_PERIODS, "array<string>").alias("periods"), F.when(key % 2 == 0, "small").alias("group_size"), F.when(key % 13 == 0, 2).alias("form"),
        F.array(key, key + 17).alias("completed_ids"),
    )


def _many_sql() -> str:
    hit = lambda text: f"len(list_filter(t, lambda y: contains({text}, y))) > 0"
    topic = lambda value: f"len(list_filter(topics, lambda w: len(list_filter(t, lambda y: contains({value}, y))) > 0)) > 0"
    rung = f"case when {topic('w')} then 100 when {topic(_CAT)} then 70 when {topic(_PAR)} then 30 when len(topics) = 0 and {hit(_NAMED)} then 20 when len(topics) = 0 and {hit("'about ring work ' || lower(p_type)")} then 10 else 0 end"
    named = "case when len(days) = 0 then false when days[1] = 'weekend' then x.weekend else not x.weekend end"
    timed = "list_contains(periods, x.period)"
    one = f"case when len(days) > 0 and len(periods) > 0 then case when ({named}) and {timed} then 60 when ({named}) or {timed} then 30 else -60 end when len(days) > 0 then case when {named} then 60 else -60 end else case when {timed} then 60 else -60 end end"
    segments = " ".join(f"when '{k}' then {v!r}::varchar[][]" for k, v in _SEGMENTS.items())
    return f"""with g as (select l_partkey, count(*) as n_groups, min(l_extendedprice) as low, count(*) filter (where l_quantity > 10) as open_groups, min(l_suppkey) as supp,
        list(distinct {{'weekend': isodow(l_shipdate) >= 6, 'period': case when l_linenumber * 3 < 12 then 'morning' when l_linenumber * 3 < 17 then 'day' else 'evening' end}}) as times from lineitem group by 1),
      c as (select part.*, g.*, n_regionkey as place, case when p_size % 4 <> 0 then string_split(p_name, ' ') else []::varchar[] end as topics, case when p_size % 10 = 0 then 3 else 1 end as enrollment
        from part left join g on l_partkey = p_partkey left join supplier on s_suppkey = supp left join nation on n_nationkey = s_nationkey),
      p as (select c_custkey as k, case when c_custkey % 7 <> 0 then n_regionkey end as municipality, case when c_custkey % 11 <> 0 then 12 + c_custkey * 13 % 250 end as age_from, case when c_custkey % 11 <> 0 then 36 + c_custkey * 13 % 250 end as age_to,
          case when c_custkey % 5 <> 0 then 1000 + c_custkey * 37 % 4000 end as budget, case c_mktsegment {segments} end as interests,
          ({_DAYS!r}::varchar[][])[c_custkey % 3 + 1] as days, ({_PERIODS!r}::varchar[][])[c_custkey % 4 + 1] as periods from customer join nation on n_nationkey = c_nationkey),
      met as (select * from p join c on (municipality is null or place is null or municipality = place) and (k % 6 <> 0 or contains(lower(p_brand), 'brand#1') or contains('brand#1', lower(p_brand)))
          and (age_from is null or (p_size * 6 <= age_to and (p_size % 11 = 0 or p_size * 6 + 36 >= age_from))) and (budget is null or low is null or low <= budget)
          and p_partkey <> k and p_partkey <> k + 17 and (k % 13 <> 0 or p_size % 3 in (0, 2))),
      s as (select k as profile_id, p_partkey as id, len(interests) as asks,
          case when p_size % 9 = 0 then 0 when len(topics) = 0 then -10 else 10 end as presence, least(200, coalesce(list_sum(list_transform(interests, lambda t: {rung})), 0))::int as interest,
          case when len(days) + len(periods) = 0 then 0 else coalesce(list_max(list_transform(times, lambda x: {one})), 0) end as schedule,
          case when enrollment = 3 then -25 when n_groups is null then 0 when open_groups > 0 then 50 else 25 end as availability,
          case when k % 3 = 0 then 0 when contains(lower(p_type), 'promo') or contains('promo', lower(p_type)) then 30 when len(list_filter(flatten(interests), lambda y: len(list_filter(topics, lambda w: contains(w, y))) > 0)) > 0 then 0 else -30 end as direction_score,
          case when k % 2 <> 0 then 0 when p_size % 20 + 2 <= 10 or p_size % 20 + 4 <= 10 then 20 else -20 end as group_size from met),
      r as (select *, presence + interest + schedule + availability + direction_score + group_size as score from s where asks = 0 or interest > 0),
      n as (select *, row_number() over (partition by profile_id order by score desc, id)::int as place from r where score > 0)
      select profile_id, id, presence, interest, schedule, availability, direction_score, group_size, score::int as score, place from n where place <= 10"""


@register("rank_profiles", _many_sql())
def rank_profiles(spark, sf_dir):
    """The ten best programmes for every customer."""
    return profile_ranking.top(asked_profiles(spark, sf_dir), candidates(spark, sf_dir))
