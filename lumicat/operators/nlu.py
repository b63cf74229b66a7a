"""Understanding of short free-text requests, as pure expressions of one text column.

Lexicons are data (``operators/lexicon.py``) and may be replaced. Words are
matched between non-letters, never with word boundaries, so Latin and Cyrillic
behave alike. Every function takes the whole text; none looks at its length only.

A text is normalised once per function (``fx.once``) and all patterns read that
value: written into each pattern's expression, it would be computed for each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import lexicon
from lumicat.operators.lexicon import Activity, Direction
from lumicat.operators.rules import first_match

EDGE = r"[^a-zа-я0-9]"
AGE_RANGE = r"([0-9]{1,2}) *[-–] *([0-9]{1,2})"
AGE_NUMBER = r"(^|[^0-9])([0-9]{1,2})"


def whole(words: str) -> str:
    return rf"(^|{EDGE})({words})({EDGE}|$)"


def name_pattern(name: str) -> str:
    """A place name in any case, words parted by blanks or hyphens."""

    def word(w: str) -> str:
        if len(w) <= 4 or w.isdigit():
            return re.escape(w)
        end, cut, forms = next(x for x in lexicon.NAME_ENDINGS if w.endswith(x[0]))
        return re.escape(w[: len(w) - cut]) + f"({forms})"

    words = [w for w in re.split(r"[\s-]+", name.lower().replace("ё", "е")) if w]
    return "[ -]+".join(map(word, words))


def _query(text: Column, made) -> Column:
    """What ``made`` gives for the normalised text."""
    return fx.once(fx.normalize_query(text), made)


def _hits(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The names of all rules whose pattern hits, in rule order."""
    return _query(text, lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in rules])))


def _first_number(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, AGE_NUMBER, 2), F.lit("")).cast("int")


def age_years(text: Column, words: Sequence[tuple[str, int]] = lexicon.AGE_WORDS) -> Column:
    """The mean of a range, else the first one or two digits if they are an age, else an age word."""

    def made(t: Column) -> Column:
        low, high = (F.regexp_extract(t, AGE_RANGE, i) for i in (1, 2))
        number = _first_number(t)
        out = F.when(low != "", F.floor((low.cast("int") + high.cast("int") + 1) / 2).cast("int")).when(fx.age_bucket(number).isNotNull(), number)
        for pattern, years in words:
            out = out.when(t.rlike(pattern), years)
        return out

    return _query(text, made)


def age_is_unsure(text: Column, words: Sequence[tuple[str, int]] = lexicon.AGE_WORDS) -> Column:
    """Whether the age is a range or a word."""
    return _query(text, lambda t: t.rlike(AGE_RANGE) | (fx.age_bucket(_first_number(t)).isNull() & t.rlike("|".join(p for p, _ in words))))


def places(text: Column, names: Sequence[str] = tuple(lexicon.PLACES)) -> Column:
    """Distinct known places in any grammatical case, by first position, then list order.

    A pattern runs only where the text holds the beginning that all its forms share.
    """

    def at(t: Column, name: str) -> Column:
        pattern = name_pattern(name)
        stem = re.split(r"\(|\[", pattern)[0].replace("\\", "")
        return F.when(t.contains(stem), F.regexp_instr(t, F.lit(whole(pattern)))).otherwise(0)

    found = fx.once(fx.normalize_search(text), lambda t: F.array(*[F.struct(at(t, n).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
    return F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["n"])


def directions(text: Column, rules: Sequence[Direction] = lexicon.DIRECTIONS) -> Column:
    """All directions whose pattern hits, in rule order."""
    return _hits(text, [(r.value, r.pattern) for r in rules])


def first_direction(text: Column, rules: Sequence[Direction] = lexicon.DIRECTIONS) -> Column:
    return first_of(text, [(r.value, r.pattern) for r in rules])


def interests(text: Column, rules: Sequence[tuple[str, str]] = lexicon.INTERESTS) -> Column:
    """All broad interests whose pattern hits, in rule order."""
    return _hits(text, rules)


def activities(text: Column, entries: Sequence[Activity] = lexicon.ACTIVITIES) -> Column:
    """Per activity that hits: name, terms, interests, direction, negated.

    Patterns of an entry are tried in order. Negated means a negation among the
    32 characters before the first hit.
    """

    def one(t: Column, e: Activity) -> Column:
        hit = F.lit(False)
        before = F.lit("")
        for pattern in reversed(e.patterns):
            before = F.when(t.rlike(pattern), F.right(F.regexp_extract(t, f"^(.*?)({pattern})", 1), F.lit(32))).otherwise(before)
            hit = hit | t.rlike(pattern)
        texts = lambda values: F.array(*[F.lit(v) for v in values])
        return F.when(hit, F.struct(F.lit(e.name).alias("name"), texts(e.terms).alias("terms"), texts(e.interests).alias("interests"), F.lit(e.direction).alias("direction"), negated(before).alias("negated")))

    return F.array_compact(_query(text, lambda t: F.array(*[one(t, e) for e in entries])))


def negated(before: Column, words: str = lexicon.NEGATIONS) -> Column:
    """Whether a text ends in a negation, perhaps with one word or part of it behind."""
    return before.rlike(rf"(^| )({words}) +[а-я-]{{0,16}}$|(^| )({words}|не +нужн[а-я]*) +$")


def raw_term(text: Column, triggers: Sequence[str] = lexicon.TRIGGERS, stop: Sequence[str] = lexicon.STOPWORDS) -> Column:
    """The first word behind a trigger word that, without its ending, is long enough and no stop word or number."""

    def pairs(words: Column) -> Column:
        # the words are one value here: each lookup in their expression would split the text again
        return F.zip_with(F.concat(F.array(F.lit(None).cast("string")), words), words, lambda a, w: F.struct(a.alias("a"), w.alias("w")))

    words = F.filter(F.split(fx.normalize_query(text), r"[^a-zа-я0-9-]+"), lambda w: w != "")
    behind = F.transform(F.filter(fx.once(words, pairs), lambda x: x["a"].isin(list(triggers))), lambda x: F.regexp_replace(x["w"], f"({lexicon.TERM_ENDINGS})$", ""))
    return F.get(F.filter(behind, lambda w: (F.length(w) >= 4) & ~w.isin(list(stop)) & ~w.rlike("^[0-9]+$")), F.lit(0))


def specific_interests(text: Column, entries: Sequence[Activity] = lexicon.ACTIVITIES) -> Column:
    """A struct of interests, terms, labels, excluded and direction.

    Terms of activities that are not negated; without any, the raw term of the
    text unless it is negated itself. The direction is given if it is the only one.
    """

    def made(found: Column) -> Column:
        good = F.filter(found, lambda a: ~a["negated"])
        flat = lambda acts, part: F.array_distinct(F.flatten(F.transform(acts, lambda a: a[part])))
        free = lambda raw: _query(text, lambda t: ~negated(F.right(F.left(t, F.instr(t, raw) - 1), F.lit(32))))
        own = F.when(F.size(good) == 0, fx.once(raw_term(text), lambda raw: F.when(raw.isNotNull() & free(raw), F.array(raw))))
        return F.struct(
            flat(good, "interests").alias("interests"),
            F.coalesce(own, flat(good, "terms")).alias("terms"),
            F.coalesce(own, F.transform(good, lambda a: a["name"])).alias("labels"),
            flat(F.filter(found, lambda a: a["negated"]), "terms").alias("excluded"),
            only_direction(found).alias("direction"),
        )

    return fx.once(activities(text, entries), made)


def only_direction(found: Column) -> Column:
    """The direction of the activities that are not negated, if it is the only one."""
    directions = F.array_distinct(F.transform(F.filter(found, lambda a: ~a["negated"]), lambda a: a["direction"]))
    return fx.once(directions, lambda d: F.when(F.size(d) == 1, F.get(d, F.lit(0))))


def budget(text: Column) -> Column:
    """Free, or an upper bound in roubles, as a text; empty where none is named."""

    def made(t: Column) -> Column:
        first = F.regexp_extract(t, r"до *([0-9][0-9 ]*) *(₽|руб)", 1)
        named = F.regexp_extract(t, r"бюджет *[: до]* *([0-9][0-9 ]*)", 1)
        return F.when(t.contains("бесплатн"), "бесплатно").when(first != "", F.concat(F.lit("до "), F.trim(first), F.lit(" рублей"))).when(named != "", F.concat(F.lit("до "), F.trim(named), F.lit(" рублей"))).otherwise("")

    return _query(text, made)


def schedule(text: Column, rules: Sequence[tuple[str, str]] = lexicon.SCHEDULE) -> Column:
    return _hits(text, rules)


def attendance(text: Column, rules: Sequence[tuple[int, str]] = lexicon.FORMS) -> Column:
    """2 for mixed, 3 for remote, 1 for in person."""
    return _query(text, lambda t: F.coalesce(*[F.when(t.rlike(p), F.lit(n)) for n, p in rules]))


def goal(text: Column, rules: Sequence[tuple[str, str]] = lexicon.GOALS) -> Column:
    return first_of(text, rules)


def first_of(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern hits, or null: experience, adaptation and the like."""
    return _query(text, lambda t: first_match([(t.rlike(p), F.lit(n)) for n, p in rules], F.lit(None).cast("string")))


def scenario(text: Column) -> Column:
    """What a request asks for: a plan, another programme, a first choice, or which questions are open."""
    wish = (F.size(interests(text)) > 0) | goal(text).isNotNull()
    bound = (budget(text) != "") | (F.size(schedule(text)) > 0)

    def open_questions(b: Column) -> Column:
        wished = fx.once(wish, lambda w: F.when(b & w, "first_time_selection").when(b, "clarify_constraints").when(w | age_years(text).isNotNull(), "clarify_preferences").otherwise("fallback"))
        return F.when(_query(text, lambda t: t.rlike(lexicon.TRAJECTORY)), "build_trajectory").when(F.coalesce(first_of(text, lexicon.EXPERIENCE).isin("active", "new"), F.lit(False)), "switch_program").otherwise(wished)

    return fx.once(bound, open_questions)


def avoidances(text: Column, rules: Sequence[tuple[str, str]] = lexicon.AVOIDANCES) -> Column:
    return _hits(text, rules)


def conflict(text: Column) -> Column:
    """Sports wished for beside a wish for calm or against an intense pace."""
    return F.array_contains(interests(text), "sports") & (_query(text, lambda t: t.rlike(lexicon.CALM_WISHES)) | F.array_contains(avoidances(text), "intense"))


def corrected(text: Column) -> Column:
    """Of "not X but Y" the part behind "but", else the text."""
    return _query(text, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(^| )не +.+? +а +(.+)$", 2), F.lit("")), t))


def missing(age: Column, place: Column, interest: Column) -> Column:
    return F.array_compact(F.array(F.when(age.isNull(), F.lit("age")), F.when(F.coalesce(place, F.lit("")) == "", F.lit("place")), F.when(F.coalesce(interest, F.lit("")) == "", F.lit("interest"))))


def ask_model(text: Column, n_missing: Column, unsure: Column) -> Column:
    """A model is asked only where something is missing or unsure, or the text is long."""
    return (n_missing > 0) | unsure | (F.length(text) > 160)


def profile_confidence(n_interests: Column, n_avoid: Column, has_goal: Column) -> Column:
    points = F.when(n_interests >= 2, 1).otherwise(0) + F.when(n_interests >= 2, 1).otherwise(0) + F.when(n_avoid > 0, 1).otherwise(0) + F.when(has_goal, 1).otherwise(0) - F.when(n_interests >= 4, 1).otherwise(0)
    return F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def correction(turns: Column) -> Column:
    """Fields of a session folded in turn order: a value replaces, a null keeps."""
    zero = F.struct(F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("interest"))
    return F.aggregate(turns, zero, lambda s, t: F.struct(F.coalesce(t["age"], s["age"]).alias("age"), F.coalesce(t["interest"], s["interest"]).alias("interest")))
