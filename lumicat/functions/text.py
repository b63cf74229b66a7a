"""Column functions on catalogue text, numbers and dates.

All are built-in expressions. Cyrillic and Latin letters are written as classes,
never as word boundaries, and text is lower-cased before it is matched, so the
same patterns mean the same in Java's and in RE2's dialect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "


def _sub(col: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        col = F.regexp_replace(col, pattern, to)
    return col


def _without(col: Column, chars: str) -> Column:
    """Cuts single characters; a search by bytes each, which is far cheaper than ``translate`` where they are rare."""
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def normalize_text(col: Column) -> Column:
    """Lower case, with the letter yo as ye."""
    return F.replace(F.lower(F.coalesce(col, F.lit(""))), F.lit("ё"), F.lit("е"))


def squeeze(col: Column) -> Column:
    """White space, hard spaces included, as single spaces, none at the ends."""
    return F.trim(_sub(F.replace(col, F.lit(NBSP), F.lit(" ")), (r"[ \t\n\r\f\x0B]+", " ")))


def normalize_query(col: Column) -> Column:
    return squeeze(normalize_text(col))


def normalize_search(col: Column) -> Column:
    return squeeze(F.translate(normalize_text(col), "«»\"“”'", ""))


def normalize_key(col: Column) -> Column:
    """A topic key: letters, digits and ``+#.-`` only, single blanks; ends keep dots and dashes."""
    # the text is in lower case, and one class of ASCII is faster than two ranges
    return F.trim(_sub(_without(normalize_text(col), "«»\"“”"), (r"[^\p{Alnum}а-я+#.-]+", " ")))


def normalize_topic(col: Column) -> Column:
    """A topic key whose ends lose spaces, dots and dashes."""
    return F.btrim(normalize_key(col), F.lit(" .-"))


# fixed values: words that lead a topic name and its number, words that lead or end a kind of lesson, units of hours
_NUMBERED = ("Тема", "тема", "Раздел", "раздел", "Модуль", "модуль", "Topic", "topic", "Unit", "unit")
_LEADING = ("Теория", "теория", "Практика", "практика", "Контроль", "контроль", "Проект", "проект", "Theory", "theory", "Practice", "practice")
_ENDING = ("теория", "практика", "контроль", "зачет", "зачёт", "опрос", "theory", "practice", "test")
_HOURS = ("час", "часа", "часов", "hours", "h")
_ROW = ("table_row", "TABLE_ROW")
# end of fixed values


def _begins(col: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.startswith(w)
    return out


#: Ordered patterns cut from a topic name, each with a cheap test of the name's ends that any match passes.
TOPIC_STRIPS = [
    (lambda c: _begins(c, _ROW), rf"^({'|'.join(_ROW)}) *\|\| *"),
    (lambda c: F.left(c, F.lit(1)).between("0", "9"), r"^[0-9]+([.)]|\.[0-9]+)? *"),
    (lambda c: _begins(c, _NUMBERED), rf"^({'|'.join(_NUMBERED)}) *[0-9]+[.)]? *"),
    (lambda c: _begins(c, _LEADING), rf"^({'|'.join(_LEADING)}) *[:.-] *"),
    (lambda c: F.right(c, F.lit(9)).rlike(rf"({'|'.join(_ENDING)})\.?$"), rf" +({'|'.join(_ENDING)})\.?$"),
    (lambda c: F.right(c, F.lit(6)).rlike(rf"([0-9]|{'|'.join(_HOURS)})\.?$"), rf" +[0-9]+([,.][0-9]+)? *({'|'.join(_HOURS)})?\.?$"),
]


def clean_topic(col: Column) -> Column:
    plain = F.coalesce(col, F.lit(""))
    for char, to in (("–", "-"), ("—", "-"), ("«", '"'), ("»", '"')):
        plain = F.replace(plain, F.lit(char), F.lit(to))

    def cut(value: Column, steps: list) -> Column:
        """One step after the other on a value that is computed once."""
        if not steps:
            return F.btrim(value, F.lit(" .;-"))
        test, pattern = steps[0]
        return once(F.when(test(value), F.regexp_replace(value, pattern, "")).otherwise(value), lambda v: cut(v, steps[1:]))

    return once(squeeze(plain), lambda v: cut(v, TOPIC_STRIPS))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_html(col: Column) -> Column:
    return squeeze(F.replace(_sub(F.coalesce(col, F.lit("")), ("<[^>]*>", " ")), F.lit("&nbsp;"), F.lit(" ")))


# fixed values: named references in decoding order; the ampersand comes before the angle brackets
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def decode_entities(col: Column) -> Column:
    for name, char in ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def first_sentence(col: Column) -> Column:
    """The first sentence of 30 to 220 characters, else the first 220 characters."""
    flat = squeeze(F.coalesce(col, F.lit("")))
    found = F.regexp_extract(flat, r"^(.{30,220}?[.!?])( |$)", 1)
    return F.when(found != "", found).otherwise(F.left(flat, F.lit(220)))


def extract_number(col: Column) -> Column:
    return F.nullif(F.regexp_extract(_sub(col, (r"[ \t]+", "")), "[0-9]+", 0), F.lit("")).try_cast("bigint")


def price_amount(col: Column) -> Column:
    """Free is 0; blanks go, the first comma is the decimal point; no number is null."""
    lower = normalize_text(col)
    digits = _sub(F.translate(lower, NBSP + " \t", ""), ("^([^,]*),", "$1."))
    number = F.nullif(F.regexp_extract(digits, r"[0-9]+(\.[0-9]+)?", 0), F.lit("")).try_cast("decimal(18,4)")
    return F.when(col.isNull() | (col == ""), F.lit(None)).when(lower.contains("бесплат") | lower.contains("free"), F.lit(0)).otherwise(number).cast("decimal(18,4)")


def format_price(amount: Column) -> Column:
    return F.concat(F.translate(F.format_number(F.round(amount.cast("decimal(18,4)"), 0), 0), ",", " "), F.lit(" ₽"))


def nullable_number(col: Column) -> Column:
    return F.nullif(F.btrim(col), F.lit("")).try_cast("double")


def safe_float(col: Column) -> Column:
    return F.coalesce(F.replace(col, F.lit(","), F.lit(".")).try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def months_to_years(months: Column) -> Column:
    """Whole years, halves up."""
    return F.floor((months + 6) / 12).cast("bigint")


def age_bucket(years: Column) -> Column:
    return once(years, lambda y: F.when(y.between(3, 4), "3-4").when(y.between(5, 6), "5-6").when(y.between(7, 9), "7-9").when(y.between(10, 12), "10-12").when(y.between(13, 18), "13+"))


def weekday(col: Column) -> Column:
    """English day name of a Russian or English name, long or short; others pass in lower case."""
    name = F.btrim(normalize_text(col), F.lit(" ."))
    # fixed values: names of days
    days = {"monday": ["понедельник", "пн", "mon"], "tuesday": ["вторник", "вт", "tue"], "wednesday": ["среда", "ср", "wed"], "thursday": ["четверг", "чт", "thu"], "friday": ["пятница", "пт", "fri"], "saturday": ["суббота", "сб", "sat"], "sunday": ["воскресенье", "вс", "sun"]}
    out = F.when(F.lit(False), "")
    for day, names in days.items():
        out = out.when(name.isin(names), day)
    return out.otherwise(name)


def is_weekend(day: Column) -> Column:
    return day.isin("saturday", "sunday")


def time_period(col: Column) -> Column:
    hour = F.nullif(F.regexp_extract(col, "[0-9]{1,2}", 0), F.lit("")).cast("int")
    return F.when(hour < 12, "morning").when(hour < 17, "day").when(hour.isNotNull(), "evening")


def ru_plural(n: Column, one: str, few: str, many: str) -> Column:
    teen = (n % 100).between(11, 14)
    return F.when(~teen & (n % 10 == 1), one).when(~teen & (n % 10).between(2, 4), few).otherwise(many)


def age_label(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" лет")))
        .when(low.isNotNull(), F.concat(F.lit("от "), low.cast("string"), F.lit(" лет")))
        .when(high.isNotNull(), F.concat(F.lit("до "), high.cast("string"), F.lit(" лет")))
        .otherwise("")
    )


def group_size_class(low: Column, high: Column) -> Column:
    mean = (low + high) / 2
    return F.when((mean <= 10) | (high <= 10), "small").when((low >= 15) | (mean >= 16), "large").otherwise("medium")


#: Ordered activity patterns on normalised text.
# fixed values: kinds of lessons in order, with alternatives of parts that must all occur
ACTIVITIES = [
    ("контроль", ("контроль",), ("зачет",), ("тест",), ("экзамен",), ("опрос",), ("exam",), ("test",)),
    ("проект", ("проект",), ("project",)),
    ("теория+практика", ("теори", "практик")),
    ("практика", ("практик",), ("упражнен",), ("практич",), ("practice",)),
    ("теория", ("теор",), ("лекци",), ("беседа",), ("история",), ("theory",), ("history",)),
]


def activity_type(activity: Column, topic: Column) -> Column:
    """The first kind whose parts occur in activity or topic, as in their key; quotes inside words don't part them."""
    text = _without(normalize_text(F.concat_ws(" ", F.coalesce(activity, F.lit("")), F.coalesce(topic, F.lit("")))), "«»\"“”")

    def kinds(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, *ways in ACTIVITIES:
            test = F.lit(False)
            for parts in ways:
                every = F.lit(True)
                for part in parts:
                    every = every & t.contains(part)
                test = test | every
            out = out.when(test, name)
        return out

    return F.coalesce(once(text, kinds), F.nullif(activity, F.lit("")), F.lit("не определено"))


def url_program_id(url: Column) -> Column:
    parts = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]id=([0-9]+)", r"/program/([0-9]+)", r"/([0-9]+)(?:[/.?#]|$)")]
    return F.coalesce(*parts).try_cast("bigint")


def url_links(text: Column, domain: str, most: int = 5) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^ \t\n<>\"]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda u: u.contains(domain))), 1, most)


def classifier_keys(code: Column, name: Column) -> Column:
    """``code:x`` and ``name:y``, without blank, generic and unknown values."""
    useful = lambda c: ~F.coalesce(c, F.lit("")).isin("", "unknown", "unknown_content", "other", "none")
    made = F.array(F.when(useful(code), F.concat(F.lit("code:"), code)), F.when(useful(F.lower(name)), F.concat(F.lit("name:"), normalize_query(name))))
    return F.array_compact(made)


def classifier_path(parent: Column, category: Column) -> Column:
    p, c = F.nullif(parent, F.lit("")), F.nullif(category, F.lit(""))
    return F.when(p.eqNullSafe(c), F.coalesce(c, F.lit(""))).otherwise(F.concat_ws(" / ", p, c))


def taxonomy_path(*parts: Column) -> Column:
    return F.concat_ws(" > ", *[F.nullif(p, F.lit("")) for p in parts])


def education_form(col: Column) -> Column:
    n = col.try_cast("int")
    return F.when(n.isin(1, 2, 3), n)


def education_form_label(form: Column) -> Column:
    return F.when(form == 1, "in person").when(form == 2, "mixed").when(form == 3, "remote")


def round_confidence(col: Column) -> Column:
    return F.round(F.least(F.greatest(col.cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")), F.lit("0.999").cast("decimal(18,6)")), 3)


def round_2(col: Column) -> Column:
    return F.round(col.cast("decimal(18,6)"), 2)
