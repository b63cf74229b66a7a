"""Request understanding over the turns of conversations.

The test texts are invented words, so each turn is read together with one of a
few planted requests; both engines look at the whole joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import dictionary, lexicon, nlu
from lumicat.operators.staging import staged
from lumicat.plans.registry import register
from lumicat.plans.scalars import norm, squeeze
from lumicat.session import table

PHRASES = [
    "ребенку 7-9 лет, робототехника в Кировске, до 3 000 руб", "сыну 12 лет, не футбол а шахматы", "занятия по баскетболу в Оленегорске, вечером", "бесплатно, дочери 5, рисование в Варзуге", "подросток, программирование онлайн",
    "ищем флорбол для школьника", "из Мурманска и Североморска, танцы или театр", "спорт без футбола, спокойный темп", "бюджет: 1500, выходные", "после школы, смешанный формат", "первый кружок, не любит шумные группы", "хотим что-то новое, не зашло",
    "интересует керамика", "план на год по физике и математике", "перегруз на секции плавания, нужно другое", "уже ходит в кружок вокала, дисциплина важна", "первоклассник любит лепить", "20 лет в Полярных Зорях", "очно, рядом с домом, утром в субботу", "экскурсии и походы, краеведение",
    "не нужны танцы", "кроме самбо и дзюдо", "однообразие утомляет, сцены боится", "просто разговор",
]
_PHRASE = "(array[" + ", ".join(f"'{p}'" for p in PHRASES) + f"])[1 + (conv_id * 7 + turn) % {len(PHRASES)}]"
SPOKEN = f"(select conv_id, turn, role, text || ' ' || {_PHRASE} as text from conversations)"
Q = squeeze(norm("text"))
S = squeeze("translate(" + norm("text") + ", '«»\"“”\'\'', '')")


def turns(spark, sf_dir):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(PHRASES))).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", F.lit(" "), phrase).alias("text"))


def places(spark):
    """The known places in every form, as a table."""
    return dictionary.inflected(spark.createDataFrame(list(enumerate(lexicon.PLACES)), "rank int, name string"))


def with_places(rows):
    """``rows`` with the places that their texts name, looked up in the table."""
    return dictionary.with_names(rows.withColumn("_s", fx.normalize_search(F.col("text"))), places(rows.sparkSession), ["conv_id", "turn"], "_s").drop("_s")


def over_turns(name: str, columns: dict | Callable, sql: dict[str, str] | None, named: bool = False) -> None:
    """Registers columns of the text of each turn, or of the places found in it: one by one, or as a function that gives a struct."""

    def query(spark, sf_dir):
        rows = with_places(turns(spark, sf_dir)) if named else turns(spark, sf_dir)
        value = F.col("found" if named else "text")
        made = [F.inline(F.array(columns(value)))] if callable(columns) else [c(value).alias(n) for n, c in columns.items()]
        return rows.select("conv_id", "turn", "role", *made)

    text = None if sql is None else f"with t as (select conv_id, turn, role, text, {Q} as q, {S} as s from {SPOKEN}) select conv_id, turn, role, {', '.join(f'{v} as {k}' for k, v in sql.items())} from t"
    register(name, text)(query)


def _hit(pattern: str, value: str = "q") -> str:
    return f"regexp_matches({value}, '{pattern}')"


def _first(rules, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {_hit(p)} then '{n}'" for n, p in rules) + f" else {otherwise} end"


def _every(rules) -> str:
    """The names of all rules that hit, as a list."""
    return "list_filter([" + ", ".join(f"case when {_hit(p)} then '{n}' end" for n, p in rules) + "], lambda x: x is not null)"


def _joined(values: str) -> str:
    return f"array_to_string({values}, ',')"


_NUMBER = f"try_cast(nullif(regexp_extract(q, '{nlu.AGE_NUMBER}', 2), '') as int)"
_RANGE = lambda i: f"regexp_extract(q, '{nlu.AGE_RANGE}', {i})"
_AGE_SQL = f"case when {_RANGE(1)} <> '' then floor(({_RANGE(1)}::int + {_RANGE(2)}::int + 1) / 2.0)::int when {_NUMBER} between 3 and 18 then {_NUMBER} " + " ".join(f"when {_hit(p)} then {y}" for p, y in lexicon.AGE_WORDS) + " end"
_UNSURE_SQL = f"({_hit(nlu.AGE_RANGE)} or (not coalesce({_NUMBER} between 3 and 18, false) and {_hit('|'.join(p for p, _ in lexicon.AGE_WORDS))}))"
_PLACES = "list_filter([" + ", ".join(f"case when {_hit(nlu.whole(nlu.name_pattern(n)), 's')} then '{n}' end" for n in lexicon.PLACES) + "], lambda x: x is not null)"
_DIR_RULES = [(d.value, d.pattern) for d in lexicon.DIRECTIONS]
_DIRECTION_SQL, _DIRS = _first(_DIR_RULES), _every(_DIR_RULES)
_NEG = rf"(^| )({lexicon.NEGATIONS}) +[а-я-]{{0,16}}$|(^| )({lexicon.NEGATIONS}|не +нужн[а-я]*) +$"


def _before(activity) -> str:
    out = "''"
    for p in reversed(activity.patterns):
        out = f"case when {_hit(p)} then right(regexp_extract(q, '^(.*?)({p})', 1), 32) else {out} end"
    return out


def _acts(want: bool, name) -> str:
    return "list_filter([" + ", ".join(f"case when {_hit('|'.join(a.patterns))} and {'' if want else 'not '}{_hit(_NEG, _before(a))} then '{name(a)}' end" for a in lexicon.ACTIVITIES) + "], lambda x: x is not null)"


_isin = lambda values: ", ".join(f"'{v}'" for v in values)
_WORDS = "list_filter(regexp_split_to_array(q, '[^a-zа-я0-9-]+'), lambda x: x <> '')"
_RAW = f"""list_filter(list_transform(list_filter(range(2, len({_WORDS}) + 1), lambda i: list_contains([{_isin(lexicon.TRIGGERS)}], ({_WORDS})[i - 1])), lambda i: regexp_replace(({_WORDS})[i], '({lexicon.TERM_ENDINGS})$', '')),
  lambda w: length(w) >= 4 and not list_contains([{_isin(lexicon.STOPWORDS)}], w) and not regexp_matches(w, '^[0-9]+$'))[1]"""
_BUDGET_FIRST, _BUDGET_NAMED = "regexp_extract(q, 'до *([0-9][0-9 ]*) *(₽|руб)', 1)", "regexp_extract(q, 'бюджет *[: до]* *([0-9][0-9 ]*)', 1)"
_BUDGET = f"case when contains(q, 'бесплатн') then 'бесплатно' when {_BUDGET_FIRST} <> '' then 'до ' || trim({_BUDGET_FIRST}) || ' рублей' when {_BUDGET_NAMED} <> '' then 'до ' || trim({_BUDGET_NAMED}) || ' рублей' else '' end"
_FORM = "case " + " ".join(f"when {_hit(p)} then {n}" for n, p in lexicon.FORMS) + " end"
_GOAL, _AVOID, _BROAD = _first(lexicon.GOALS), _every(lexicon.AVOIDANCES), _every(lexicon.INTERESTS)
_CONFLICT = f"(list_contains({_BROAD}, 'sports') and ({_hit(lexicon.CALM_WISHES)} or list_contains({_AVOID}, 'intense')))"
_CONFIDENCE = f"((len({_BROAD}) >= 2)::int * 2 + (len({_AVOID}) > 0)::int + ({_GOAL} is not null)::int - (len({_BROAD}) >= 4)::int)"


def joined(values):
    return F.array_join(values, ",")


def only_place(found):
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


over_turns("nlu_age", {"age": nlu.age_years, "ambiguous": nlu.age_is_unsure}, {"age": _AGE_SQL, "ambiguous": _UNSURE_SQL})
over_turns("nlu_settlement", {"n_places": F.size, "names": lambda f: joined(F.array_sort(f))}, {"n_places": f"len({_PLACES})::int", "names": _joined(f"list_sort({_PLACES})")}, named=True)
over_turns("nlu_place", {"place": only_place, "ambiguous": lambda f: F.size(f) > 1}, {"place": f"case when len({_PLACES}) = 1 then ({_PLACES})[1] end", "ambiguous": f"len({_PLACES}) > 1"}, named=True)
over_turns("nlu_direction", {"direction": nlu.first_direction}, {"direction": _DIRECTION_SQL})
over_turns("nlu_interests", {"interests": lambda t: joined(nlu.interests(t)), "broad": lambda t: F.size(nlu.directions(t)) > 1}, {"interests": _joined(_BROAD), "broad": f"len({_DIRS}) > 1"})
over_turns("nlu_conflict", {"several": lambda t: F.size(nlu.directions(t)) > 1, "conflict": nlu.conflict}, {"several": f"len({_DIRS}) > 1", "conflict": _CONFLICT})


def _names(found, want: bool):
    return joined(F.transform(F.filter(found, lambda a: a["negated"] if want else ~a["negated"]), lambda a: a["name"]))


def _ontology(t):
    """Terms, excluded terms and the direction of a text whose activities are looked for once."""
    return fx.once(nlu.activities(t), lambda found: F.struct(_names(found, False).alias("terms"), _names(found, True).alias("excluded"), nlu.only_direction(found).alias("direction")))


over_turns("nlu_activity_ontology", _ontology, {"terms": _joined(_acts(False, lambda a: a.name)), "excluded": _joined(_acts(True, lambda a: a.name)), "direction": f"case when len(list_distinct({_acts(False, lambda a: a.direction)})) = 1 then ({_acts(False, lambda a: a.direction)})[1] end"})
over_turns("nlu_negation", {"negated": lambda t: nlu.negated(F.right(fx.normalize_query(t), F.lit(32)))}, {"negated": _hit(_NEG, "right(q, 32)")})
over_turns("nlu_raw_term", {"term": nlu.raw_term}, {"term": _RAW})
over_turns("nlu_budget", {"budget": nlu.budget}, {"budget": _BUDGET})
over_turns("nlu_schedule", {"schedule": lambda t: joined(nlu.schedule(t))}, {"schedule": _joined(_every(lexicon.SCHEDULE))})
over_turns("nlu_format", {"form": nlu.attendance}, {"form": _FORM})
over_turns("nlu_goal", {"goal": nlu.goal}, {"goal": _GOAL})
over_turns("nlu_avoid", {"avoid": lambda t: joined(nlu.avoidances(t))}, {"avoid": _joined(_AVOID)})
over_turns("nlu_profile_confidence", {"confidence": lambda t: nlu.profile_confidence(F.size(nlu.interests(t)), F.size(nlu.avoidances(t)), nlu.goal(t).isNotNull())}, {"confidence": f"case when {_CONFIDENCE} >= 4 then 'high' when {_CONFIDENCE} >= 2 then 'medium' else 'low' end"})
_BOUND, _WISH = f"({_BUDGET} <> '' or len({_every(lexicon.SCHEDULE)}) > 0)", f"(len({_BROAD}) > 0 or {_GOAL} is not null)"
_EXPERIENCE = _first(lexicon.EXPERIENCE)
over_turns(
    "nlu_llm_heuristics",
    {"bucket": lambda t: fx.once(nlu.age_years(t), lambda y: F.when(y >= 13, "13+").otherwise(fx.age_bucket(y))), "experience": lambda t: nlu.first_of(t, lexicon.EXPERIENCE), "adaptation": lambda t: nlu.first_of(t, lexicon.ADAPTATION), "scenario": nlu.scenario},
    {
        "bucket": f"case when {_AGE_SQL} between 3 and 4 then '3-4' when {_AGE_SQL} between 5 and 6 then '5-6' when {_AGE_SQL} between 7 and 9 then '7-9' when {_AGE_SQL} between 10 and 12 then '10-12' when {_AGE_SQL} >= 13 then '13+' end",
        "experience": _EXPERIENCE, "adaptation": _first(lexicon.ADAPTATION),
        "scenario": f"case when {_hit(lexicon.TRAJECTORY)} then 'build_trajectory' when coalesce({_EXPERIENCE} in ('active', 'new'), false) then 'switch_program' when {_BOUND} and {_WISH} then 'first_time_selection' when {_BOUND} then 'clarify_constraints' when {_WISH} or {_AGE_SQL} is not null then 'clarify_preferences' else 'fallback' end",
    },
)

_PARSED = f"t as (select conv_id, turn, role, text, {Q} as q, {S} as s from {SPOKEN}), parsed as (select conv_id, turn, role, text, {_AGE_SQL} as age, {_DIRECTION_SQL} as interest, coalesce(case when len({_PLACES}) = 1 then ({_PLACES})[1] end, '') as place, {_UNSURE_SQL} or len({_PLACES}) > 1 as unsure from t)"


def parsed(spark, sf_dir):
    text = F.col("text")
    rows = staged(with_places(turns(spark, sf_dir)), age=nlu.age_years(text), interest=nlu.first_direction(text), range=nlu.age_is_unsure(text))
    place = F.when(F.size("found") == 1, F.get("found", F.lit(0))).otherwise("")
    return rows.withColumns({"place": place, "unsure": F.col("range") | (F.size("found") > 1)}).drop("found", "range")


@register("nlu_parse", f"with {_PARSED} select conv_id, turn, role, age, interest, place from parsed")
def nlu_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("conv_id", "turn", "role", "age", "interest", "place")


@register("nlu_missing", f"with {_PARSED} select conv_id, turn, role, array_to_string(list_filter([case when age is null then 'age' end, case when place = '' then 'place' end, case when interest is null then 'interest' end], lambda x: x is not null), ',') as missing from parsed")
def nlu_missing(spark, sf_dir):
    return parsed(spark, sf_dir).select("conv_id", "turn", "role", F.array_join(nlu.missing(F.col("age"), F.col("place"), F.col("interest")), ",").alias("missing"))


_N_MISSING = "(age is null)::int + (place = '')::int + (interest is null)::int"


@register("nlu_llm_gate", f"with {_PARSED} select conv_id, turn, role, {_N_MISSING} > 0 or unsure or length(text) > 160 as ask from parsed")
def nlu_llm_gate(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return rows.select("conv_id", "turn", "role", nlu.ask_model(F.col("text"), F.size(nlu.missing(F.col("age"), F.col("place"), F.col("interest"))), F.col("unsure")).alias("ask"))


@register("nlu_profile", f"with {_PARSED} select conv_id, turn, role, coalesce({'case when age between 3 and 4 then 3 when age between 5 and 6 then 5 when age between 7 and 9 then 7 when age between 10 and 12 then 10 when age between 13 and 18 then 13 end'}, 7) as bucket, coalesce(interest, 'any') as direction, 'discover' as goal from parsed")
def nlu_profile(spark, sf_dir):
    """Ranking profile with defaults for what is missing."""
    bucket = F.create_map(*[F.lit(x) for x in ("3-4", 3, "5-6", 5, "7-9", 7, "10-12", 10, "13+", 13)])[F.coalesce(fx.age_bucket(F.col("age")), F.lit("7-9"))]
    return parsed(spark, sf_dir).select("conv_id", "turn", "role", bucket.alias("bucket"), F.coalesce("interest", F.lit("any")).alias("direction"), F.lit("discover").alias("goal"))


@register("nlu_correction", f"with {_PARSED} select conv_id, arg_max(age, turn) filter (where age is not null) as age, arg_max(interest, turn) filter (where interest is not null) as interest from parsed group by 1")
def nlu_correction(spark, sf_dir):
    """Sessions folded turn by turn; a session's turns are a bounded dialogue."""
    folded = parsed(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "age", "interest"))).alias("turns"))
    return folded.select("conv_id", nlu.correction(F.col("turns")).alias("f")).select("conv_id", "f.age", "f.interest")


@register(
    "nlu_criteria_record",
    f"""with {_PARSED} select conv_id, turn, role, criterion, value, confidence::decimal(4,3) as confidence from parsed, lateral (values ('age', age::varchar, case when age is not null then 0.900 end), ('place', nullif(place, ''), case when place <> '' then 0.950 end), ('interest', interest, case when interest is not null then 0.800 end)) v(criterion, value, confidence)""",
)
def nlu_criteria_record(spark, sf_dir):
    """Criteria as rows: a fixed confidence where a value was recognised."""
    row = lambda name, value, c: F.struct(F.lit(name).alias("criterion"), value.alias("value"), F.when(value.isNotNull(), F.lit(c)).cast("decimal(4,3)").alias("confidence"))
    rows = F.array(row("age", F.col("age").cast("string"), "0.900"), row("place", F.nullif("place", F.lit("")), "0.950"), row("interest", F.col("interest"), "0.800"))
    return parsed(spark, sf_dir).select("conv_id", "turn", "role", F.inline(rows))


_PATCH = "case when turn % 3 = 0 then 'recognized' when turn % 3 = 1 then 'rejected' else 'unknown' end"


@register("nlu_criteria_patch", f"with {_PARSED} select conv_id, turn, role, case when {_PATCH} in ('recognized', 'unknown') then coalesce('m' || turn, interest) else interest end as interest, case when {_PATCH} = 'unknown' then 'recognized_unverified' else {_PATCH} end as status from parsed")
def nlu_criteria_patch(spark, sf_dir):
    """Model criteria from JSON patch the fields where their status allows it."""
    status = F.when(F.col("turn") % 3 == 0, "recognized").when(F.col("turn") % 3 == 1, "rejected").otherwise("unknown")
    payload = F.to_json(F.struct(F.struct(status.alias("status"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("value")).alias("interest")))
    model = F.from_json(payload, "map<string, struct<status: string, value: string>>")["interest"]
    verified = F.when((model["status"] == "unknown") & model["value"].isNotNull(), "recognized_unverified").otherwise(model["status"])
    usable = verified.isin("recognized", "recognized_ambiguous", "recognized_unverified", "pending_scoring")
    return parsed(spark, sf_dir).select("conv_id", "turn", "role", F.when(usable, F.coalesce(model["value"], F.col("interest"))).otherwise(F.col("interest")).alias("interest"), verified.alias("status"))


@register("nlu_criteria_arrays", "select conv_id, count(distinct role)::bigint as n, string_agg(distinct role, ',' order by role) as roles from conversations group by 1")
def nlu_criteria_arrays(spark, sf_dir):
    """Any value as a trimmed, distinct array of at most eight texts."""
    values = turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_set(F.trim("role")).alias("r"))
    kept = F.slice(F.array_sort(F.array_distinct(F.filter("r", lambda x: x != ""))), 1, 8)
    return values.select("conv_id", F.size(kept).cast("bigint").alias("n"), F.array_join(kept, ",").alias("roles"))


@register("nlu_criteria_flatten", "select conv_id, turn, role, case when turn % 2 = 0 then turn end as age, case when turn % 2 = 0 then role else '' end as interests from conversations")
def nlu_criteria_flatten(spark, sf_dir):
    """Nested or flat model JSON into one typed row: absent lists are empty, absent scalars null."""
    nested = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.struct(F.col("turn").alias("value")).alias("age"), F.array("role").alias("interests")))).otherwise(F.lit("{}"))
    made = F.from_json(nested, "age struct<value: bigint>, interests array<string>")
    return turns(spark, sf_dir).select("conv_id", "turn", "role", made["age"]["value"].alias("age"), F.array_join(F.coalesce(made["interests"], F.array().cast("array<string>")), ",").alias("interests"))


@register("nlu_specific_patch", f"with t as (select conv_id, turn, role, text, {Q} as q from {SPOKEN}) select conv_id, turn, role, coalesce(nullif({_joined(_acts(False, lambda a: a.name))}, ''), role) as terms from t")
def nlu_specific_patch(spark, sf_dir):
    """Model terms re-run through the ontology; raw ones stay where it knows none."""
    return turns(spark, sf_dir).select("conv_id", "turn", "role", F.coalesce(F.nullif(_names(nlu.activities(F.col("text")), False), F.lit("")), F.col("role")).alias("terms"))
