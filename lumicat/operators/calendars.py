"""Calendars of syllabuses: rows split over lines or table rows are put together, and rival tables of a document are told apart.

Three layouts are read: delimited tables (``TABLE_ROW || ...``), plans whose rows
run over lines, and a cell a line (``extract.cell_rows``). Lines are rows of a
DataFrame; folds over them are windows and groups of one document, so after the
lines are grouped by document nothing but chosen rows is shuffled. Hours follow
the order that the header of their table names; where one of theory and practice
is given, a blank other is zero, and a missing total is their sum. A row with
hours whose number is the beginning of the next row's number is a section.

A document may hold the same calendar twice, in full and as a summary, and may
hold one calendar a year. Two tables are rivals if they share at least half of
the titles of the smaller one. A table goes if a better rival is there: better
is whose total row agrees with its rows, then whose rows add up, then the layout
in the order cells, lines, tables, then the first. Others are all kept.

A null or empty text has no rows; a table without header has total, theory and
practice in this order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.operators import extract
from lumicat.operators.staging import staged

CELLS, LINES, TABLES = 0, 1, 2
NUMBER = r"^[0-9]{1,3}([.][0-9]{1,3})*[.)]?$"
SECTION = r"^(раздел|модуль|блок|section|module)(?= |[0-9])"
TOTAL = r"^(итого|всего|total)"
_HOUR = r"([0-9]{1,4}(?:[.,][0-9]+)?|-)"
_HOURS_BEHIND = rf"^(.*?) {_HOUR} {_HOUR} {_HOUR}(?: .*)?$"


def _lines(docs: DataFrame) -> DataFrame:
    """doc, pos, line, low: lines that aren't empty, and the same in lower case."""
    return docs.select("doc", F.posexplode(F.split(extract.normalize(F.col("text")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''").withColumn("low", F.lower("line"))


def _any(text: Column, *words: str) -> Column:
    """Whether a text holds one of the words; far cheaper than a pattern, so patterns are tried behind it."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def _role(cell: Column) -> Column:
    low = F.lower(cell)
    return F.when(low.rlike("^(теор|theor)"), "theory").when(low.rlike("^(практ|pract)"), "practice").when(low.rlike("^(всего|общ|итого|total)"), "total")


def _rows(groups: DataFrame) -> DataFrame:
    """Topics of (doc, layout, part, pos, number, title, total, theory, practice) rows, with their section and the total of their table."""
    table = Window.partitionBy("doc", "layout", "part")
    here = table.orderBy("pos")
    number = F.regexp_replace("number", "[.)]+$", "")
    following = F.regexp_replace(F.lead("number").over(here), "[.)]+$", "")
    low = F.lower("title")
    timed = F.coalesce("total", "theory", "practice").isNotNull()
    is_total = F.lower(F.trim(F.concat_ws(" ", "number", "title"))).rlike(TOTAL)
    is_section = ~is_total & (low.rlike(SECTION) | F.coalesce(following.startswith(F.concat(number, F.lit("."))) & (number != ""), F.lit(False)) | ~timed)
    kinds = groups.withColumn("kind", F.when(is_total, "total").when(is_section, "section").otherwise("topic"))
    name = F.trim(F.regexp_replace("title", "(?iu)" + SECTION + r"( *[0-9]+| +[IVX]+(?![A-Za-z]))?[.:]? *", ""))
    zero = F.lit(0).cast("decimal(18,4)")
    some = F.coalesce("theory", "practice").isNotNull()
    parts = {c: F.when(some, F.coalesce(F.col(c), zero)).cast("decimal(18,4)") for c in ("theory", "practice")}
    summed = (parts["theory"] + parts["practice"]).cast("decimal(18,4)")
    placed = (
        kinds.withColumn("section", F.last(F.when(F.col("kind") == "section", name), ignorenulls=True).over(here))
        .withColumn("stated", F.last(F.when(F.col("kind") == "total", F.coalesce("total", summed)), ignorenulls=True).over(table.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .where((F.col("kind") == "topic") & (F.length("title") >= 3))
    )
    return placed.select("doc", "layout", "part", "pos", "section", F.col("title").alias("topic"), F.coalesce("total", summed).alias("total"), parts["theory"].alias("theory"), parts["practice"].alias("practice"), "stated")


def line_rows(docs: DataFrame) -> DataFrame:
    """Rows of delimited tables, each table a part, and of plans that run over lines, in one pass over the lines.

    A table row without number joins the row before it, which takes its words and,
    where it has none, its hours. A row of a plan is a number and a title, which may
    go on in the next lines, and three cells of hours; only lines behind one that
    names theory and practice count, or behind two lines that do.
    """
    by_doc = Window.partitionBy("doc").orderBy("pos")
    table = F.col("line").startswith("TABLE_ROW")
    theory, practice = ("теори", "theory"), ("практик", "practice")
    # cells behind TABLE_ROW; blanks around bars go with them
    lines = _lines(docs).withColumn("c", F.when(table, F.split("line", r" *\|\| *")))
    cell = lambda i: F.coalesce(F.get("c", F.lit(i)), F.lit(""))
    roles = F.array_compact(F.transform(F.slice("c", F.lit(2), F.size("c")), _role))
    named = F.exists(roles, lambda r: r != "total") & ~F.exists(F.slice("c", F.lit(2), F.size("c")), lambda c: c.rlike(r"^[0-9]+([.,][0-9]+)?$"))
    names_practice = _any(F.col("low"), *practice) & ~F.col("low").startswith("table_row")
    lines = lines.select(
        "doc", "pos", "line", "c", table.alias("table"),
        F.col("line").startswith("STRUCTURED_DOCX_TABLE_BEGIN").cast("int").alias("begins"),
        F.when(table & _any(F.col("low"), "теор", "theor", "практ", "pract"), F.when(named, roles)).alias("roles"),
        names_practice.alias("second"),
        (names_practice & F.col("low").rlike(f"({'|'.join(theory)}).*({'|'.join(practice)})")).alias("both"),
        (_any(F.col("low"), *theory) & F.col("low").rlike(f"({'|'.join(theory)})[а-яa-z]*$")).alias("first"),
        F.when(table, cell(1).rlike(NUMBER) | F.lower(F.concat(cell(1), cell(2))).rlike(f"{SECTION}|{TOTAL}"))
        .otherwise(F.col("line").rlike(r"^[0-9]{1,3}([.][0-9]{1,3})*[.)]? +[A-Za-zА-Яа-яЁё«\"(]") | F.col("low").rlike(f"{SECTION}|{TOTAL}")).alias("starts"),
    )
    lines = lines.withColumn("tables", F.sum("begins").over(by_doc)).withColumn("behind", F.lag("first", 1, False).over(by_doc))
    lines = lines.withColumn("head", F.last(F.when(F.col("roles").isNotNull(), F.struct(F.col("tables").alias("part"), "roles")), ignorenulls=True).over(by_doc))
    header = F.when(F.col("table"), F.col("roles").isNotNull()).otherwise(F.col("both") | F.col("second") & F.col("behind"))
    lines = lines.withColumn("header", header)
    read = ~F.col("header") & ~F.col("line").startswith("STRUCTURED_DOCX_TABLE")
    begun = lambda where: F.sum((where & read & F.col("starts")).cast("int")).over(by_doc)
    lines = lines.select(
        "doc", "pos", "line", "c", "table", "starts", read.alias("read"),
        F.when(F.col("table") & (F.col("head.part") == F.col("tables")), F.col("head.roles")).otherwise(F.array(F.lit("total"), F.lit("theory"), F.lit("practice"))).alias("roles"),
        F.when(F.col("table"), F.col("tables")).otherwise(F.sum((~F.col("table") & F.col("header")).cast("int")).over(by_doc)).alias("part"),
        F.when(F.col("table"), begun(F.col("table"))).otherwise(begun(~F.col("table"))).alias("group"),
    ).where("read and (table or part > 0)")
    hour = lambda role: F.when(F.col("table"), extract.hours(F.get("c", (F.nullif(F.array_position("roles", role), F.lit(0)) + 2).cast("int")))).alias(role)
    rows = lines.select("doc", F.when(F.col("table"), TABLES).otherwise(LINES).alias("layout"), "part", "group", "pos", "starts", F.when(F.col("table"), cell(1)).alias("number"), F.when(F.col("table"), cell(2)).otherwise(F.col("line")).alias("words"), *[hour(r) for r in ("total", "theory", "practice")])
    timed = F.coalesce("total", "theory", "practice").isNotNull()
    folded = rows.groupBy("doc", "layout", "part", "group").agg(
        F.min(F.struct("pos", "number")).alias("r"),
        F.min(F.when(timed, F.struct("pos", "total", "theory", "practice"))).alias("h"),
        F.sort_array(F.collect_list(F.when(F.col("words") != "", F.struct("pos", "words")))).alias("w"),
        F.bool_or("starts").alias("starts"),
    )
    # lines of a table or plan before its first row belong to none
    whole = folded.where("starts").select("doc", "layout", "part", "r.pos", "r.number", "h", F.array_join("w.words", " ").alias("words"))
    line = F.col("layout") == LINES
    number = F.when(line, F.regexp_extract("words", r"^([0-9]{1,3}(?:[.][0-9]{1,3})*[.)]?) ", 1)).otherwise(F.col("number"))
    split = whole.withColumn("number", number).withColumn("rest", F.when(line, F.trim(F.expr("substring(words, length(number) + 1)"))).otherwise(F.col("words")))
    # the rest begins with no blank, so the title before hours is never empty; hours are the three words behind it
    split = split.withColumn("before", F.when(line, F.regexp_extract("rest", _HOURS_BEHIND, 1)).otherwise(""))
    split = split.withColumn("cells", F.when(F.col("before") != "", F.split(F.expr("substring(rest, length(before) + 2)"), " ", 4)))
    given = lambda i, c: F.when(line, extract.hours(F.rtrim(F.get("cells", F.lit(i)), F.lit("\u0085\u2028\u2029")))).otherwise(F.col(f"h.{c}")).alias(c)
    title = F.when(line, F.trim(F.when(F.col("before") != "", F.col("before")).otherwise(F.col("rest")))).otherwise(F.col("words"))
    return _rows(split.select("doc", "layout", "part", "pos", "number", title.alias("title"), *[given(i, c) for i, c in enumerate(("total", "theory", "practice"))]))


#: What a text in lower case has where a line begins with theory and the next one with practice.
_CELL_HEADER = r"(теория|theory)[^\n\r\f]*[\n\r\f]\s*(практика|practice)"


def cell_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``extract.cell_rows``; the total is the first cell behind the last line of totals."""
    # lower-casing costs most, so a line that begins with the letter of practice is looked for first; a byte order mark may stand inside a word
    some = docs.where(F.col("text").rlike(r"[\n\r\f]\s*[пПpP]") & F.lower("text").rlike(_CELL_HEADER) | F.col("text").contains("\ufeff"))
    at = F.array_max(F.transform("_l", lambda x, i: F.when(F.lower(x).rlike(TOTAL + "( часов)?:?$") & F.coalesce(F.get("_l", i + 1).rlike(extract.CELL), F.lit(False)), i + 1)))
    rows = extract.cell_rows(some, stated=extract.hours(F.get("_l", at)))
    return rows.select("doc", F.lit(CELLS).alias("layout"), F.lit(0).cast("bigint").alias("part"), F.col("ordinal").cast("int").alias("pos"), F.lit(None).cast("string").alias("section"), "topic", "total", "theory", "practice", "stated")


def chosen(rows: DataFrame) -> DataFrame:
    """doc, tables: the tables of each document that have no better rival in it, with their rows, each an array in order."""
    row = F.struct("pos", "section", "topic", "total", "theory", "practice")
    tables = rows.groupBy("doc", "layout", "part").agg(
        F.coalesce(F.max("stated") == F.sum("total"), F.lit(False)).alias("agrees"),
        (F.sum(F.when(F.col("total") == F.col("theory") + F.col("practice"), 1).otherwise(0)) / F.count("*")).alias("adds_up"),
        F.collect_set(F.lower("topic")).alias("titles"),
        F.sort_array(F.collect_list(row)).alias("rows"),
    )
    rank = F.struct("agrees", "adds_up", (-F.col("layout")).alias("layout"), (-F.col("part")).alias("part"))
    by_doc = tables.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("layout", "part", rank.alias("rank"), "titles", "rows"))).alias("t"))

    def rivals(a: Column, b: Column) -> Column:
        return 2 * F.size(F.array_intersect(a["titles"], b["titles"])) >= F.least(F.size(a["titles"]), F.size(b["titles"]))

    kept = F.filter("t", lambda a: ~F.exists("t", lambda b: (b["rank"] > a["rank"]) & rivals(a, b)))
    return by_doc.select("doc", F.when(F.size("t") == 1, F.col("t")).otherwise(kept).alias("tables"))


def calendar(docs: DataFrame) -> DataFrame:
    """doc, ordinal, section, topic, total, theory, practice: the calendar of each document in all layouts."""
    # so that whatever makes the texts isn't run once for each look at them
    docs = staged(docs.select("doc", "text"), _whole=F.col("text")).select("doc", F.col("_whole").alias("text"))
    rows = chosen(cell_rows(docs).unionByName(line_rows(docs))).select("doc", F.posexplode(F.flatten("tables.rows")).alias("n", "r"))
    return rows.select("doc", (F.col("n") + 1).cast("bigint").alias("ordinal"), "r.section", "r.topic", "r.total", "r.theory", "r.practice")
