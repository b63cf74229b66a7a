"""Topic rows from syllabus text: lines, patterns, structured tables, quality and regression checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.operators.staging import staged


def normalize(text: Column) -> Column:
    """One newline form, no byte order mark, single blanks, plain dashes; a text that needs none of it is looked through once."""
    whole = t = F.coalesce(text, F.lit(""))
    for old, new in (("\ufeff", ""), ("\r\n", "\n"), ("\r", "\n"), ("\f", "\n")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, "[ \t]{2,}|\t", " ")
    for dash in "–—−":
        t = F.replace(t, F.lit(dash), F.lit("-"))
    return F.when(whole.rlike("[\ufeff\r\f\t–—−]|  "), t).otherwise(whole)


def logical_lines(docs: DataFrame) -> DataFrame:
    """doc, pos, line with continuation lines joined to the line they continue.

    A line continues the one before if it starts in lower case, has more than
    three characters, and the one before ends without a full stop or the like.
    """
    numbered = F.transform(F.split(normalize(F.col("text")), "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    rows = staged(docs.select("doc", "text"), _l=F.filter(numbered, lambda x: x["line"] != ""))

    def more(x: Column, i: Column) -> Column:
        return (i > 0) & x["line"].rlike(r"^[a-zа-яёéèçñ]") & (F.length(x["line"]) > 3) & ~F.get("_l", i - 1)["line"].rlike(r"[.!?:;]$")

    rows = staged(rows, _m=F.transform("_l", lambda x, i: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), more(x, i).alias("more"))))
    # within one document, so no shuffle: lines are put together and cut again where a new one begins
    text = F.array_join(F.transform("_m", lambda x: F.concat(F.when(x["more"], " ").otherwise("\n"), x["line"])), "")
    starts = F.filter("_m", lambda x: ~x["more"])
    whole = F.zip_with(starts, F.slice(F.split(text, "\n"), F.lit(2), F.size(starts)), lambda s, x: F.struct(s["pos"].alias("pos"), x.alias("line")))
    return staged(rows, _z=whole).select("doc", F.inline("_z"))


#: Extractors in order of preference: pattern and the group that holds the title.
PATTERNS = [
    (r"^(Тема|Topic|Unit) *[0-9]+[.)]? *(.+)$", 2),
    (r"^[0-9]+ +([^0-9].*?) +[0-9]+([.,][0-9]+)? +[0-9]+([.,][0-9]+)? +[0-9]+([.,][0-9]+)?$", 1),
    (r"^(.+?) *\([0-9]+([.,][0-9]+)? *(ч|час|часа|часов|h|hours)\.?\)$", 1),
    (r"^[0-9]+\.[0-9]+\.? +(.+)$", 1),
    (r"^([0-9]+ год|year [0-9]+)[ :.-]+(.+)$", 2),
]


def cleanup(title: Column) -> Column:
    """A usable title or null: hours cut, 3 to 180 characters, no numbers alone, headers or legal lines."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title, r" *\([0-9]+[^)]*\)$", ""), r"( +[0-9]+([.,][0-9]+)?){1,3}$", ""))
    low = F.lower(t)
    bad = t.rlike(r"^[0-9 .,-]*$") | low.rlike("^(всего|итого|total|№|название|наименование)") | low.rlike("федеральн|приказ|all rights") | (F.length(t) - F.length(F.replace(t, F.lit(";"), F.lit(""))) >= 2)
    return F.when(F.length(t).between(3, 180) & ~bad, t)


def topics(lines: DataFrame) -> DataFrame:
    """doc, ordinal, topic: all extractors united, the first of equal titles kept, in extractor and line order."""
    # each pattern runs once; a title has a character at least, so an empty one is none
    titles = F.array(*[F.struct(F.lit(i).alias("priority"), F.regexp_extract("line", p, g).alias("title")) for i, (p, g) in enumerate(PATTERNS)])
    found = lines.select("doc", "pos", F.inline(titles)).where("title <> ''")
    rows = found.select("doc", "priority", "pos", cleanup(F.col("title")).alias("topic")).where("topic is not null")
    first = rows.groupBy("doc", F.lower("topic").alias("_k")).agg(F.min(F.struct("priority", "pos", "topic")).alias("f"))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("f.priority", "f.pos")).cast("bigint")
    return first.select("doc", ordinal.alias("ordinal"), F.col("f.topic").alias("topic"))


def hours(cell: Column) -> Column:
    """Hours with comma decimals; a dash or a blank is null."""
    # a cast that fails is caught as an exception, which costs far more than the test
    return F.when(cell.rlike(r"\p{Nd}"), F.replace(F.trim(cell), F.lit(","), F.lit(".")).try_cast("decimal(18,4)"))


def table_rows(docs: DataFrame) -> DataFrame:
    """doc, ordinal, topic, total, theory, practice of ``TABLE_ROW || n || title || hours...`` lines.

    Rows need a number and a title; missing totals are theory and practice
    together. ``cell_rows`` and ``inline_rows`` read other layouts.
    """
    lines = docs.select("doc", F.posexplode(F.split(normalize(F.col("text")), "\n")).alias("pos", "line")).where(F.col("line").startswith("TABLE_ROW"))
    cells = F.transform(F.split("line", r" *\|\| *"), lambda c: F.trim(c))
    row = lines.select("doc", "pos", cells.alias("c")).where(F.get("c", F.lit(1)).rlike(r"^[0-9]+[.)]?$") & (F.length(F.get("c", F.lit(2))) >= 3))
    get = lambda i: hours(F.get("c", F.lit(i)))
    total = F.coalesce(get(3), F.coalesce(get(4), F.lit(0).cast("decimal(18,4)")) + F.coalesce(get(5), F.lit(0).cast("decimal(18,4)")))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("pos")).cast("bigint")
    return row.select("doc", ordinal.alias("ordinal"), F.get("c", F.lit(2)).alias("topic"), total.cast("decimal(18,4)").alias("total"), get(4).alias("theory"), get(5).alias("practice"))


CELL = r"^([0-9]+([.,][0-9]+)?|-)$"


def cell_rows(docs: DataFrame, **carried: Column) -> DataFrame:
    """doc, ordinal, topic, total, theory, practice of calendars with a cell a line: number, title, three cells of hours.

    Only lines behind a header that names theory and practice count. A title may
    take two lines; rows of totals have no number and don't count. ``carried`` are
    columns of the document's lines, ``_l``, to be added to its rows.
    """
    lines = F.filter(F.transform(F.split(normalize(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = staged(docs.select("doc", "text"), _l=lines)
    head = F.array_max(F.transform("_l", lambda x, i: F.when(F.lower(x).rlike("^(практика|practice)") & F.lower(F.get("_l", i - 1)).rlike("^(теория|theory)"), i)))
    rows = staged(rows, _head=head)
    at = lambda i, k: F.get("_l", i + k)
    number = lambda x: F.coalesce(x.rlike(CELL), F.lit(False))
    title = lambda x: F.coalesce(x.rlike("[^0-9 .,-]") & (F.length(x) >= 3) & ~F.lower(x).rlike("^(итого|всего|total)"), F.lit(False))

    def row(x, i):
        begins = (i > F.col("_head")) & x.rlike(r"^[0-9]{1,3}[.)]?$") & title(at(i, 1))
        cells = lambda k: number(at(i, k)) & number(at(i, k + 1)) & number(at(i, k + 2))
        made = lambda name, k: F.struct(i.alias("pos"), name.alias("topic"), hours(at(i, k)).alias("total"), hours(at(i, k + 1)).alias("theory"), hours(at(i, k + 2)).alias("practice"))
        return F.when(begins & cells(2), made(at(i, 1), 2)).when(begins & title(at(i, 2)) & cells(3), made(F.concat_ws(" ", at(i, 1), at(i, 2)), 3))

    found = staged(rows.where("_head is not null"), _r=F.array_compact(F.transform("_l", row)), **carried)
    return found.select("doc", *carried, F.posexplode("_r").alias("n", "r")).select("doc", (F.col("n") + 1).cast("bigint").alias("ordinal"), "r.topic", "r.total", "r.theory", "r.practice", *carried)


_HOUR = r"([0-9]{1,3}(?:[.,][0-9]+)?|-)"
_ROW_NUMBER = r"(?<= )[0-9]{1,2}\.(?:[0-9]{1,2}\.?)? (?=[^0-9 -])"


def inline_rows(docs: DataFrame) -> DataFrame:
    """doc, ordinal, section, topic, total, theory, practice of calendars whose rows run over lines of any length.

    A row is a number, a title and three cells of hours; what follows is its form
    of lesson. A number and a title without hours is a section, and the title of
    the rows behind it.
    """
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(normalize(F.col("text")), r"\s+", " ")))
    rows = staged(docs.select("doc", "text"), _flat=flat)
    pieces = F.filter(F.slice(F.split("_flat", _ROW_NUMBER), 2, 1_000_000), lambda x: F.trim(x) != "")
    cells = rf"^(.{{3,180}}?) {_HOUR} {_HOUR} {_HOUR}( |$)"
    part = lambda x, i: F.regexp_extract(x, cells, i)
    row = lambda x: F.struct(F.trim(part(x, 1)).alias("topic"), hours(part(x, 2)).alias("total"), hours(part(x, 3)).alias("theory"), hours(part(x, 4)).alias("practice"), F.trim(F.regexp_replace(x, r"(?i) *(всего часов|итого|total)\b?.*$", "")).alias("name"))
    rows = staged(rows, _r=F.transform(pieces, row))
    titled = F.transform("_r", lambda r, i: F.struct(r["topic"].alias("topic"), r["total"].alias("total"), r["theory"].alias("theory"), r["practice"].alias("practice"), F.try_element_at(F.filter(F.slice("_r", 1, i + 1), lambda x: x["topic"] == ""), F.lit(-1))["name"].alias("section")))
    rows = staged(rows.where(F.exists("_r", lambda r: r["topic"] != "")), _t=F.filter(titled, lambda r: r["topic"] != ""))
    return rows.select("doc", F.posexplode("_t").alias("n", "t")).select("doc", (F.col("n") + 1).cast("bigint").alias("ordinal"), "t.section", "t.topic", "t.total", "t.theory", "t.practice")


def html_cells(html: Column) -> Column:
    """Rows of all tables as arrays of cell texts; rows without text go. Only ``td`` counts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def quality(rows: DataFrame) -> DataFrame:
    """doc, topics, passes, confidence of fresh parses (doc, topic, total)."""
    out = rows.groupBy("doc").agg(F.count("*").alias("topics"), F.bool_and(F.length(F.trim("topic")) > 0).alias("named"), F.sum(F.coalesce("total", F.lit(0))).alias("hours"))
    passes = F.col("named") & (F.col("hours") > 0)
    return out.select("doc", "topics", passes.alias("passes"), F.when(passes, F.lit("0.82")).cast("decimal(4,2)").alias("confidence"))


def regress(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """doc, mismatches: fields of (doc, topics, hours) that differ from the expected row."""
    a, b = summary.alias("a"), expected.alias("b")
    fields = F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("topics", "hours")])
    return b.join(a, F.col("a.doc") == F.col("b.doc"), "left").select(F.col("b.doc").alias("doc"), F.array_join(F.array_compact(fields), ",").alias("mismatches"))
