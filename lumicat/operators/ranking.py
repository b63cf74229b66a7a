"""Ranking of catalogue programmes for a profile.

A candidate is one row with nested groups, modules and topics. Hard filters give
the first reason that excludes it, criteria give whole-number scores, and the
score is their sum. Everything is a column expression over that one row, so the
plan is scan, aggregate to nested rows, project, filter and top-k.

Candidate columns: id, name, organization, direction, municipality_id, form,
level, enrollment, age_min, age_max (months, null is open), keywords, groups
(id, price, free, day, hour), modules (low, high), topics (key, name, category,
parent, hours, practice), topics_known, annotation.

Points, caps and levels are fixed values of the ranking, written where they apply.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators.rules import first_match
from lumicat.operators.staging import staged

CAP, CLOSED = 200, 3
DEEP_LEVELS, WIDE_LEVELS = (2, 3, 5), (1, 2, 4, 5)


@dataclass(frozen=True)
class Profile:
    scenario: str = "s1"
    municipality_id: int | None = None
    organization: str | None = None
    age_months: tuple[int, int] | None = None
    age_years: int | None = None
    budget: float | None = None
    interests: tuple[tuple[str, ...], ...] = ()
    specific_terms: tuple[str, ...] = ()
    excluded_terms: tuple[str, ...] = ()
    direction: str | None = None
    days: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    group_size: str | None = None
    form: int | None = None
    completed_ids: tuple[int, ...] = ()
    topic_keys: tuple[str, ...] = ()
    category_keys: tuple[str, ...] = ()
    parent_keys: tuple[str, ...] = ()
    average_hours: float | None = None
    advanced: tuple[str, ...] = field(default=("project", "research", "advanced"))


def has_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Terms of three characters or more inside normalised text."""
    out = F.lit(False)
    for term in terms:
        if len(term) >= 3:
            out = out | F.contains(fx.normalize_text(text), F.lit(term.lower().replace("ё", "е")))
    return out


def _topic(parts: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    return F.exists("topics", lambda t: has_term(F.concat_ws(" ", *[t[p] for p in parts]), terms))


def _no_topics() -> Column:
    return F.size(F.coalesce("topics", F.array())) == 0


def specific(terms: tuple[str, ...]) -> Column:
    """First rung that hits, not the best: a parent hit (80) goes before the name (110)."""
    if not terms:
        return F.lit(0)
    named, text = F.concat_ws(" ", "name", F.array_join("keywords", " ")), F.coalesce("annotation", F.lit(""))
    return first_match(
        [
            (_topic(("key", "name"), terms), F.lit(180)),
            (_topic(("category",), terms), F.lit(130)),
            (_topic(("parent",), terms), F.lit(80)),
            (has_term(named, terms), F.lit(110)),
            (_no_topics() & has_term(text, terms), F.lit(40)),
        ],
        F.lit(0),
    )


def interest(interests: tuple[tuple[str, ...], ...]) -> Column:
    """Best rung per interest, summed and capped."""
    total = F.lit(0)
    for terms in interests:
        named, text = F.concat_ws(" ", "name", F.array_join("keywords", " ")), F.concat_ws(" ", "annotation", "direction")
        total = total + first_match(
            [
                (_topic(("key", "name"), terms), F.lit(100)),
                (_topic(("category",), terms), F.lit(70)),
                (_topic(("parent",), terms), F.lit(30)),
                (_no_topics() & has_term(named, terms), F.lit(20)),
                (_no_topics() & has_term(text, terms), F.lit(10)),
            ],
            F.lit(0),
        )
    return F.least(total, F.lit(CAP))


def topic_presence() -> Column:
    return F.when(~F.coalesce("topics_known", F.lit(True)), 0).when(_no_topics(), -10).otherwise(10)


def schedule(days: tuple[str, ...], periods: tuple[str, ...]) -> Column:
    """Best group: all requested dimensions 60, some 30, none -60; groups without entries don't count."""
    if not days and not periods:
        return F.lit(0)

    def one(g: Column) -> Column:
        tests = []
        if days:
            named = g["day"].isin(list(days))
            named = named | fx.is_weekend(g["day"]) if "weekend" in days else named
            tests.append(named | ~fx.is_weekend(g["day"]) if "weekday" in days else named)
        if periods:
            period = F.when(g["hour"] < 12, "morning").when(g["hour"] < 17, "day").otherwise("evening")
            tests.append(period.isin(list(periods)))
        every, some = tests[0], tests[0]
        for t in tests[1:]:
            every, some = every & t, some | t
        return F.when(every, 60).when(some, 30).otherwise(-60)

    known = F.filter("groups", lambda g: g["day"].isNotNull() | g["hour"].isNotNull())
    return F.coalesce(F.array_max(F.transform(known, one)), F.lit(0))


def availability() -> Column:
    free = F.filter("groups", lambda g: g["free"].isNotNull())
    return F.when(F.col("enrollment") == CLOSED, -25).when(F.size(F.coalesce(free, F.array())) == 0, 0).when(F.exists(free, lambda g: g["free"] > 0), 50).otherwise(25)


def has_open_places() -> Column:
    return (F.col("enrollment") != CLOSED) & F.coalesce(F.exists("groups", lambda g: g["free"] > 0), F.lit(False))


def direction(wanted: str | None, matched: Column) -> Column:
    if not wanted or wanted == "any":
        return F.lit(0)
    actual, asked = fx.normalize_text(F.col("direction")), F.lit(wanted.lower())
    return F.when(F.coalesce(actual, F.lit("")) == "", 0).when(F.contains(actual, asked) | F.contains(asked, actual), 30).when(matched, 0).otherwise(-30)


def group_size(wanted: str | None) -> Column:
    if not wanted or wanted == "any":
        return F.lit(0)
    return F.coalesce(F.array_max(F.transform("modules", lambda m: F.when(fx.group_size_class(m["low"], m["high"]) == wanted, 20).otherwise(-20))), F.lit(0))


def matches_organization(wanted: str | None) -> Column:
    if not wanted:
        return F.lit(True)
    name, asked = fx.normalize_text(F.col("organization")), F.lit(wanted.lower())
    return (name == "") | F.contains(name, asked) | F.contains(asked, name)


def matches_age(months: tuple[int, int] | None) -> Column:
    if months is None:
        return F.lit(True)
    return (F.col("age_min").isNull() | (F.col("age_min") <= months[1])) & (F.col("age_max").isNull() | (F.col("age_max") >= months[0]))


def matches_budget(budget: float | None) -> Column:
    """Any group price within the budget; without group prices the candidate passes."""
    if budget is None:
        return F.lit(True)
    priced = F.filter("groups", lambda g: g["price"].isNotNull())
    return (F.size(F.coalesce(priced, F.array())) == 0) | F.exists(priced, lambda g: g["price"] <= budget)


def matches_form(form: int | None) -> Column:
    return F.lit(True) if form is None else F.col("form").isNull() | (F.col("form") == form)


def hard_filter(p: Profile) -> Column:
    """The first failing test's reason, or null.

    An age mismatch of a candidate with a specific hit passes at once, before
    budget, completed programmes and form are looked at.
    """
    hit = F.col("specific") > 0
    tests = [
        (F.col("municipality_id").isNotNull() & (F.col("municipality_id") != p.municipality_id) if p.municipality_id is not None else F.lit(False), "municipality_mismatch"),
        (~matches_organization(p.organization), "organization_mismatch"),
        (F.col("excluded_hit") > 0, "excluded_specific_interest"),
        (~F.col("age_eligible") & ~hit, "age_mismatch"),
        (~F.col("age_eligible"), None),
        (~matches_budget(p.budget), "budget_mismatch"),
        (F.col("id").isin(list(p.completed_ids)) if p.completed_ids else F.lit(False), "completed_program"),
        (~matches_form(p.form), "education_form_mismatch"),
    ]
    return first_match([(t, F.lit(r).cast("string")) for t, r in tests], F.lit(None).cast("string"))


def may_pass(p: Profile) -> Column:
    """Whether a candidate can pass the hard filters, from its narrow columns only: no groups, no terms.

    For callers that want passing candidates and not the reasons of the others;
    they ask before they gather groups. ``hard_filter`` still decides.
    """
    place = F.lit(True) if p.municipality_id is None else F.col("municipality_id").isNull() | (F.col("municipality_id") == p.municipality_id)
    aged = matches_age(p.age_months) if not p.specific_terms else F.lit(True)  # a specific hit passes at any age
    rest = F.lit(True) if p.specific_terms else matches_form(p.form) & (~F.col("id").isin(list(p.completed_ids)) if p.completed_ids else F.lit(True))
    return place & matches_organization(p.organization) & aged & rest


def _in(value: Column, keys: tuple[str, ...]) -> Column:
    return value.isin(list(keys)) if keys else F.lit(False)


def depth_signals(p: Profile) -> Column:
    """How many of five signs of a deeper programme the candidate shows."""
    text = fx.normalize_text(F.concat_ws(" ", "name", "annotation", "direction", F.array_join("keywords", " "), F.array_join(F.transform("topics", lambda t: t["name"]), " ")))
    total = lambda f: F.aggregate("topics", F.lit(0).cast("double"), lambda a, t: a + F.coalesce(t[f], F.lit(0)).cast("double"))
    years = fx.months_to_years(F.col("age_min"))
    hours, practice = total("hours"), total("practice")
    signs = [
        F.col("level").isin(list(DEEP_LEVELS)),
        text.rlike("|".join(p.advanced)) if p.advanced else F.lit(False),
        years.between(p.age_years - 1, p.age_years) if p.age_years is not None else F.lit(False),
        (F.size("topics") > 0) & (F.try_divide(hours, F.size("topics")) > p.average_hours * 1.15) if p.average_hours else F.lit(False),
        (practice > 0) & (practice >= hours * 0.4),
    ]
    count = F.lit(0)
    for s in signs:
        count = count + F.coalesce(s, F.lit(False)).cast("int")
    return count


def deep(p: Profile) -> Column:
    """Continuation in depth; null where nothing links to what was completed."""
    same = F.exists("topics", lambda t: _in(t["key"], p.topic_keys))
    second = F.exists("topics", lambda t: _in(t["category"], p.category_keys) & ~_in(t["key"], p.topic_keys))
    first = F.exists("topics", lambda t: _in(t["parent"], p.parent_keys) & ~_in(t["category"], p.category_keys))
    signs = F.col("depth") > 0
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(same, 30) + points(second, 70) + points(first, 40) + points(signs, 80) - points(~signs & same & ~second & ~first, 10)
    return F.when(same | second | first, F.least(score, F.lit(CAP)))


def wide_reason(p: Profile) -> Column:
    meaningful = F.filter("topics", lambda t: F.coalesce(t["category"], F.lit("")) != "")
    return F.when(F.exists(meaningful, lambda t: _in(t["category"], p.category_keys)), "repeated_level2_topic").when(F.size(F.coalesce(meaningful, F.array())) == 0, "no_meaningful_topics")


def wide(p: Profile) -> Column:
    """Continuation in breadth; null where ``wide_reason`` excludes."""
    meaningful = F.filter("topics", lambda t: F.coalesce(t["category"], F.lit("")) != "")
    known, fresh = F.exists(meaningful, lambda t: _in(t["parent"], p.parent_keys)), F.exists(meaningful, lambda t: ~_in(t["parent"], p.parent_keys))
    unique = F.size(F.array_distinct(F.transform(meaningful, lambda t: t["key"])))
    score = F.when(fresh, 100).otherwise(0) + F.when(known, 40).otherwise(0) + F.least(unique * 10, F.lit(50)) + F.when(F.col("level").isin(list(WIDE_LEVELS)), 50).otherwise(0)
    return F.when(wide_reason(p).isNull(), F.least(score, F.lit(CAP)))


def score(candidates: DataFrame, p: Profile) -> DataFrame:
    """Adds every criterion, the exclusion reason, the score and the bucket."""
    out = staged(
        candidates,
        specific=specific(p.specific_terms),
        excluded_hit=specific(p.excluded_terms),
        age_eligible=matches_age(p.age_months),
        interest=interest(p.interests),
        presence=topic_presence(),
        schedule=schedule(p.days, p.periods),
        availability=availability(),
        group_size=group_size(p.group_size),
        depth=depth_signals(p),
        open_places=has_open_places(),
        exact_topic=F.lit(False) if not p.interests else _topic(("key", "name"), tuple(t for terms in p.interests for t in terms)),
    )
    trajectory = deep(p) if p.scenario == "s3" else wide(p) if p.scenario == "s4" else F.lit(0)
    out = staged(out, direction_score=direction(p.direction, F.col("exact_topic") | (F.col("specific") > 0)), filter_reason=hard_filter(p), trajectory=trajectory)
    mismatch = (F.col("interest") == 0) & (F.col("specific") == 0) if p.interests else F.lit(False)
    lost = F.when(F.col("trajectory").isNull(), "no_completed_topic_link" if p.scenario == "s3" else "repeated_or_empty_topics")
    out = staged(out, reason=F.coalesce("filter_reason", F.when(mismatch, "interest_mismatch"), lost))
    total = F.col("presence") + F.col("specific") + F.col("interest") + F.col("schedule") + F.col("availability") + F.col("direction_score") + F.col("group_size") + F.coalesce("trajectory", F.lit(0))
    bucket = F.when(F.col("specific") == 0, 40).when(~F.col("age_eligible"), 30).when(F.col("open_places"), 10).otherwise(20) if p.specific_terms else F.lit(0)
    return staged(out, score=F.when(F.col("reason").isNull(), total).otherwise(0), bucket=bucket)


def top(scored: DataFrame, limit: int = 10) -> DataFrame:
    return scored.where("score > 0").orderBy("bucket", F.desc("score"), "id").limit(limit)


def best_group(p: Profile) -> Column:
    """score, first, id and the other fields of the best enrolment group, the first one on ties."""

    def one(g: Column, i: Column) -> Column:
        total = F.lit(0)
        if p.budget:
            total = total + F.when(g["price"].isNull(), 0).when(g["price"] <= p.budget, 3).when(g["price"] <= p.budget * 1.25, -1).otherwise(-4)
        named = [d for d in p.days if d not in ("weekday", "weekend")]
        if named:
            total = total + F.when(g["day"].isin(named), 2).otherwise(-2)
        if "weekday" in p.days:
            total = total + F.when(~fx.is_weekend(g["day"]), 1).otherwise(0)
        if "weekend" in p.days:
            total = total + F.when(fx.is_weekend(g["day"]), 1).otherwise(0)
        if "evening" in p.periods:
            total = total + F.when(g["hour"].isNull(), 0).when(g["hour"] >= 17, 1).otherwise(-1)
        total = total + F.when(g["free"] > 0, 1).otherwise(0)
        return F.struct(total.alias("score"), (-i).alias("first"), *[g[c].alias(c) for c in ("id", "price", "free", "day", "hour")])

    return F.array_max(F.transform("groups", one))


# fixed values: texts of cards
SHORT_DAYS = {"monday": "Пн", "tuesday": "Вт", "wednesday": "Ср", "thursday": "Чт", "friday": "Пт", "saturday": "Сб", "sunday": "Вс"}
FOCUS = {"building": "интерес к конструированию", "creative": "творческий интерес", "logic": "интерес к логике и устройству вещей"}
NO_PRICE, FREE, NO_SCHEDULE = "Стоимость уточняется на карточке программы", "Бесплатно", "Расписание уточняется на карточке"
NO_GROUP, BEST_SHOWN, FREE_PLACES = "По открытым группам и расписанию лучше перейти в карточку программы.", "Показана наиболее подходящая открытая группа по бюджету и расписанию.", "Сейчас свободных мест: "
NO_NOTE = "Перед записью лучше открыть карточку и проверить детали набора."
# end of fixed values


def cards(found: DataFrame, p: Profile, focus: tuple[str, ...] = ()) -> DataFrame:
    """id, label, schedule, price, summary, note, topics, score of ranked candidates, from their best group.

    ``focus`` names broad interests of the request, of which two are told.
    """
    best = staged(found, _b=best_group(p))
    b, group = F.col("_b"), F.col("_b").isNotNull()
    day = F.create_map(*[F.lit(x) for kv in SHORT_DAYS.items() for x in kv])[b["day"]]
    schedule = F.when(b["day"].isNull(), NO_SCHEDULE).otherwise(F.concat_ws(" ", F.coalesce(day, F.initcap(b["day"])), F.concat(b["hour"].cast("string"), F.lit(":00"))))
    price = F.when(b["price"].isNull(), NO_PRICE).when(b["price"] == 0, FREE).otherwise(F.concat(fx.format_price(b["price"]), F.lit(" за период")))
    told = [FOCUS[i] for i in focus if i in FOCUS][:2]
    tail = f" Лучше всего совпадает с запросом на {' и '.join(told)}." if told else ""
    sentence = fx.first_sentence(fx.strip_html(F.col("annotation")))
    plain = F.concat(F.lit('Программа из направления "'), "direction", F.lit('", которую стоит рассмотреть с учетом профиля ребенка.'))
    summary = F.concat(F.when(sentence != "", sentence).otherwise(plain), F.lit(tail))
    notes = F.concat_ws(" ", F.when(group & (F.size("groups") > 1), BEST_SHOWN), F.when(group & b["free"].isNotNull(), F.concat(F.lit(FREE_PLACES), b["free"].cast("string"), F.lit("."))))
    note = F.when(~group, NO_GROUP).when(notes == "", NO_NOTE).otherwise(notes)
    topics = F.array_join(F.slice(F.transform("topics", lambda t: t["name"]), 1, 6), ", ")
    return best.select("id", F.concat_ws(" · ", "name", "organization").alias("label"), schedule.alias("schedule"), price.alias("price"), summary.alias("summary"), note.alias("note"), topics.alias("topics"), "score")
