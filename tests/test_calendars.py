"""Calendars: layouts, repair of split rows, sections, and the choice among tables of a document."""

from pyspark.sql import functions as F

from lumicat.operators import calendars


def read(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    out = [[] for _ in texts]
    for r in sorted(calendars.calendar(docs).collect(), key=lambda r: (r.doc, r.ordinal)):
        number = lambda x: None if x is None else float(x)
        out[r.doc].append((r.section, r.topic, number(r.total), number(r.theory), number(r.practice)))
    return out


TABLE = """STRUCTURED_DOCX_TABLE_BEGIN 1
TABLE_ROW || № || Содержание || Часы
TABLE_ROW || Теория || Практика || Всего
TABLE_ROW ||  || Раздел 1. Музей. || 2 || 2 || 4
TABLE_ROW || 1. || Виды музеев || 1 ||  || 1
TABLE_ROW || 2. || Рассказ о школьном ||  ||  ||
TABLE_ROW ||  || музее ||  || 2 || 2
TABLE_ROW || 3. || Понятия и слова || 1 || 0,5 ||
TABLE_ROW || 4 || Модуль походов || 3 || 3 || 6
TABLE_ROW || 4.1 || Карта || 1 || 1 || 2
TABLE_ROW || 4.2 || Поход || 2 || 2 || 4
TABLE_ROW ||  || Итого || 5 || 5,5 || 10,5
STRUCTURED_DOCX_TABLE_END"""
ROWS = [
    ("Музей.", "Виды музеев", 1, 1, 0), ("Музей.", "Рассказ о школьном музее", 2, 0, 2), ("Музей.", "Понятия и слова", 1.5, 1, 0.5),
    ("походов", "Карта", 2, 1, 1), ("походов", "Поход", 4, 2, 2),
]
CELLS = "План\nВсего\nТеория\nПрактика\n1\nТема первая\n2\n1\n1\n2\nТема вторая\n2\n0,5\n1,5\n3\nТема третья\n2\n1\n1\nИтого\n6\n2,5\n3,5\n"
EXTRA = "STRUCTURED_DOCX_TABLE_BEGIN 1\nTABLE_ROW || № || Тема || Всего || Теория || Практика\n" + "\n".join(f"TABLE_ROW || {i} || {t} || 2 || 1 || 1" for i, t in enumerate(["Тема первая", "Тема вторая", "Тема третья", "Лишняя", "Ещё одна"], 1)) + "\nSTRUCTURED_DOCX_TABLE_END\n"
LINES = """Тема Всего Кол-во часов
теория практика
Раздел 3. Рельеф 6 3 3
9 Особенности рельефа
местности.
Олимпиада.
2 1 1 беседа
10 Создатели рельефа (силы
внутри) 4 2 2
Итого 6 3 3
Содержание программы"""


def test_tables_with_blank_cells_sections_and_split_rows(spark):
    assert read(spark, TABLE, None, "", "просто текст", "TABLE_ROW || x") == [ROWS, [], [], [], []]


def test_rows_over_several_lines(spark):
    (got,) = read(spark, LINES)
    assert got == [("Рельеф", "Особенности рельефа местности. Олимпиада.", 2, 1, 1), ("Рельеф", "Создатели рельефа (силы внутри)", 4, 2, 2)]


def test_the_better_of_two_rivals_stays(spark):
    three = [(None, "Тема первая", 2, 1, 1), (None, "Тема вторая", 2, 0.5, 1.5), (None, "Тема третья", 2, 1, 1)]
    both, alone, spoilt = read(spark, CELLS + EXTRA, EXTRA, CELLS.replace("Итого\n6", "Итого\n60") + EXTRA.replace("STRUCTURED_DOCX_TABLE_END", "TABLE_ROW || || Итого || 10 || 5 || 5\nSTRUCTURED_DOCX_TABLE_END"))
    assert both == three
    # a total that agrees speaks for the table that has it
    assert [r[1] for r in alone] == [r[1] for r in spoilt] == ["Тема первая", "Тема вторая", "Тема третья", "Лишняя", "Ещё одна"]


def test_tables_of_several_years_are_all_kept(spark):
    second = EXTRA.replace("Тема", "Второй год").replace("Лишняя", "Иная").replace("Ещё одна", "Последняя").replace("BEGIN 1", "BEGIN 2").replace("№ || Второй год", "№ || Тема")
    (got,) = read(spark, EXTRA + second + EXTRA)
    assert [r[1] for r in got] == ["Тема первая", "Тема вторая", "Тема третья", "Лишняя", "Ещё одна", "Второй год первая", "Второй год вторая", "Второй год третья", "Иная", "Последняя"]


def test_an_empty_table(spark):
    assert calendars.calendar(spark.createDataFrame([], "doc int, text string, extra int")).count() == 0


def test_rows_of_both_layouts_between_each_other(spark):
    mixed = "Тема Всего Теория Практика\nSTRUCTURED_DOCX_TABLE_BEGIN 1\nTABLE_ROW || без номера || 9 || 9 || 9\nTABLE_ROW || 1. || Виды || || ||\n5 Река и\nTABLE_ROW || || музеев || 2 || 1 || 1\nозеро 3 1 2\nTABLE_ROW || № || Тема || Практика || Теория\nTABLE_ROW || 2 || Поход || 3 || 1\n"
    (got,) = read(spark, mixed)
    assert got == [(None, "Река и озеро", 3, 1, 2), (None, "Виды музеев", 2, 1, 1), (None, "Поход", 4, 1, 3)]


def test_lines_are_read_once_and_tables_meet_without_a_join(spark):
    docs = spark.createDataFrame([(1, TABLE)], "doc int, text string")
    plan = calendars.calendar(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("posexplode(split(") == 1


def test_texts_are_made_once_for_each_of_the_two_branches(spark):
    """Not once for each expression that looks at a text."""
    made = spark.range(4).select(F.col("id").alias("doc"), F.concat(F.lit(CELLS), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"))
    found = calendars.calendar(made)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("repeat(") == 2
    assert found.count() == 12


def test_odd_white_space_and_headers_in_capitals(spark):
    """What a text is cleaned of and how its header is written change no row."""
    plain = CELLS + EXTRA
    (want,) = read(spark, plain)
    odd = [plain.replace("\n", "\r\n"), plain.replace("\n", "\r"), "﻿" + plain, plain.replace("Практика\n1", "\tПРАКТИКА\n1"), plain.replace("Теория\nПрактика", "ТЕОРИЯ\n ﻿ практика"), plain.replace("\nПрактика", "\f  Практика"), plain.replace(" ", "  "), plain.replace("Тема ", "Тема\t")]
    assert want and all(got == want for got in read(spark, *odd))
