"""Small labelled cases of the catalogue operators."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import cluster, extract, nlu, ranking, sync, topics
from lumicat.operators.rules import Rule, Taxonomy
from lumicat.plans import registry
from lumicat.streaming import sessions

CANDIDATE = """id bigint, name string, organization string, direction string, municipality_id int, form int, level int, enrollment int, age_min int, age_max int, keywords array<string>,
 groups array<struct<id: bigint, price: double, free: int, day: string, hour: int>>, modules array<struct<low: int, high: int>>,
 topics array<struct<key: string, name: string, category: string, parent: string, hours: int, practice: int>>, topics_known boolean, annotation string"""


def candidate(spark, **changes):
    row = dict(id=1, name="Программа", organization="", direction="Техническая", municipality_id=10, form=None, level=None, enrollment=1, age_min=84, age_max=168, keywords=[], groups=[], modules=[], topics=[], topics_known=True, annotation="")
    return spark.createDataFrame([row | changes], CANDIDATE)


def scored(spark, profile, **changes):
    return ranking.score(candidate(spark, **changes), profile).first()


def test_budget_mismatch(spark):
    got = scored(spark, ranking.Profile(budget=4000), groups=[(1, 5000.0, 3, "monday", 18)])
    assert got.reason == "budget_mismatch" and got.score == 0


def test_age_mismatch_with_specific_hit_skips_later_filters(spark):
    profile = ranking.Profile(age_months=(12, 24), budget=10, specific_terms=("робот",))
    got = scored(spark, profile, name="Робототехника", groups=[(1, 5000.0, 3, "monday", 18)])
    assert got.reason is None and got.specific == 110 and got.bucket == 30
    assert scored(spark, ranking.Profile(age_months=(12, 24)), groups=[]).reason == "age_mismatch"


def test_deep_trajectory(spark):
    topic = [("arduino", "Ардуино", "code:robots", "parent:tech", 4, 0)]
    got = scored(spark, ranking.Profile(scenario="s3", topic_keys=("arduino",)), level=3, topics=topic)
    assert (got.presence, got.trajectory, got.score) == (10, 110, 120)
    assert scored(spark, ranking.Profile(scenario="s3", topic_keys=("other",)), level=3, topics=topic).reason == "no_completed_topic_link"


def test_wide_trajectory(spark):
    topic = [("arduino", "Ардуино", "code:robots", "parent:tech", 4, 0)]
    again = scored(spark, ranking.Profile(scenario="s4", category_keys=("code:robots",)), level=2, topics=topic)
    assert again.score == 0 and again.reason is not None
    fresh = scored(spark, ranking.Profile(scenario="s4", category_keys=("code:x",), parent_keys=("parent:y",)), level=2, topics=topic)
    assert (fresh.trajectory, fresh.score) == (160, 170)


def test_schedule_takes_the_best_group(spark):
    groups = [(1, None, 0, "monday", 10), (2, None, 0, "saturday", 18)]
    assert scored(spark, ranking.Profile(days=("weekend",), periods=("evening",)), groups=groups).schedule == 60
    assert scored(spark, ranking.Profile(days=("sunday",), periods=("day",)), groups=groups).schedule == -60
    assert scored(spark, ranking.Profile(days=("weekend",))).schedule == 0


def test_specific_ladder_takes_the_first_rung(spark):
    topic = [("a", "b", "c", "parent-robot", 1, 0)]
    assert scored(spark, ranking.Profile(specific_terms=("robot",)), name="robot club", topics=topic).specific == 80


def test_top_is_ordered_and_limited(spark):
    many = candidate(spark).withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>"))).withColumn("topics", F.array(F.struct(F.lit("k").alias("key"), F.lit("k").alias("name"), F.lit("c").alias("category"), F.lit("p").alias("parent"), F.lit(1).alias("hours"), F.lit(0).alias("practice"))))
    assert [r.id for r in ranking.top(ranking.score(many, ranking.Profile()), 10).collect()] == list(range(1, 11))


@pytest.mark.parametrize("raw,value", [("1 500,50", Decimal("1500.5")), ("бесплатно", Decimal(0)), ("", None), (None, None), ("от 300 руб", Decimal(300)), ("1 200", Decimal(1200))])
def test_price(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "p string").select(fx.price_amount(F.col("p")).alias("x")).first().x == value


def test_text_functions(spark):
    row = spark.range(1).select(
        fx.normalize_key(F.lit("«Ёлка» и  C++ — ура!")).alias("key"), fx.clean_topic(F.lit("TABLE_ROW || 3. Тема 2. Ардуино 4 часа")).alias("topic"), fx.weekday(F.lit("Пн.")).alias("day"),
        fx.ru_plural(F.lit(112), "a", "b", "c").alias("plural"), fx.months_to_years(F.lit(78)).alias("years"), fx.activity_type(F.lit(""), F.lit("Итоговый зачёт")).alias("kind"), fx.url_program_id(F.lit("https://x.ru/program/123?q=1")).alias("id"),
    ).first()
    assert tuple(row) == ("елка и c++ ура", "Ардуино", "monday", "c", 7, "контроль", 123)


ROBOTS = Taxonomy(
    content=(Rule("robots", "Robots", "tech", ("робот", "датчик", "arduino"), ("сборка робота",)), Rule("code", "Code", "tech", ("python", "программир"), ())),
    service=(("assessment", ("зачет", "тестирование"), True), ("schedule", ("расписание",), False)),
    manual=(("^организационное собрание$", "service", "organisation"),),
    generic=("введение",),
)


def test_topic_precedence(spark):
    names = ["Сборка робота Arduino", "Зачет", "Зачет по программированию", "Введение", "12", "Организационное собрание", "Расписание робототехники", "Прогулка"]
    rows = spark.createDataFrame([(i, 1, "Техническая", "Клуб python", n, i, 2, "") for i, n in enumerate(names)], "topic_id long, program_id long, direction string, program_name string, topic_name string, topic_order int, hours int, activity_type string")
    made = topics.normalize(rows, ROBOTS)
    kinds = {r.topic_order: r.record_type for r in made.collect()}
    assert [kinds[i] for i in range(8)] == ["content", "service", "content", "noise", "noise", "service", "service", "content"]
    rolled = topics.aggregate(made)
    assert rolled.agg(F.sum("hours_total")).first()[0] == 16
    found = {r.topic_key: r for r in topics.classify(rolled, ROBOTS).collect()}
    assert found["сборка робота arduino"].category_code == "robots" and found["сборка робота arduino"].class_confidence == Decimal("0.96")
    assert found["прогулка"].category_code == "unknown_content" and found["прогулка"].class_confidence == Decimal("0.42")
    gold = spark.createDataFrame([("прогулка", "hiking")], "topic_key string, gold_code string")
    fixed = {r.topic_key: r for r in topics.apply_gold(topics.classify(rolled, ROBOTS), gold).collect()}
    assert fixed["прогулка"].category_code == "hiking" and fixed["прогулка"].class_confidence == Decimal("0.99")


CONTENT = [
    ("regional_studies", "local_history", ["краевед"], ["родного края"]), ("museum_studies", "museum_excursion", ["музе", "экспозиц"], []), ("excursion_guiding", "museum_excursion", ["экскурсовод"], ["проведения экскурсии"]), ("orientation_topography", "orientation", ["топограф", "компас", "карт"], []),
    ("tourism_competitions", "sport_training", ["соревнован"], ["технике пешеходного"]), ("tourism_equipment_knots", "tourism_skills", ["снаряжен", "узл"], []), ("tourism_basics", "tourism_skills", ["туризм", "турист"], []), ("safety_survival", "tourism_skills", ["выживан"], []),
    ("first_aid", "tourism_skills", ["травм", "бинт"], ["первой помощи"]), ("drill_civil_defense", "civic_patriotic", ["строев"], []), ("physical_training", "sport_training", ["физическ"], ["физическая подготовка"]),
]


def test_taxonomy_from_a_table(spark, tmp_path):
    """Rules read from a file beside the default service, noise and synonym rules, by direction."""
    from lumicat.operators import topic_rules

    rows = [("content", i, c, c, p, n, ph, None, None, None) for i, (c, p, n, ph) in enumerate(CONTENT)] + [("manual", 0, "organisation", None, None, None, None, "^собрание родителей$", "service", None)]
    spark.createDataFrame(rows, topic_rules.SCHEMA).coalesce(1).write.json(str(tmp_path / "rules"))
    tourism = topic_rules.read_taxonomy(spark, str(tmp_path / "rules"))
    assert [r.code for r in tourism.content] == [c for c, *_ in CONTENT] and tourism.service == topic_rules.SERVICE
    technical = topic_rules.taxonomy([dict(kind="content", position=0, code="cad_3d", name="3D", parent="engineering", needles=["3d", "чертеж"], phrases=[], pattern=None, record_type=None, guarded=None)])
    cases = [
        ("Введение в краеведение (лекция, викторина, инструктаж)", "local_history", "regional_studies"), ("Основы музейных знаний", "museum_excursion", "museum_studies"), ("Методика проведения экскурсии", "museum_excursion", "excursion_guiding"), ("Знакомство с туризмом.", "tourism_skills", "tourism_basics"),
        ("Соревнования по технике пешеходного туризма (ТПТ)", "sport_training", "tourism_competitions"), ("Личное и общественное туристское снаряжение", "tourism_skills", "tourism_equipment_knots"), ("Выживание в природной среде", "tourism_skills", "safety_survival"), ("Оказание первой помощи при условно заданной травме. Бинтование.", "tourism_skills", "first_aid"),
        ("Основы строевой подготовки", "civic_patriotic", "drill_civil_defense"), ("Общая физическая подготовка", "sport_training", "physical_training"), ("Компас и карта", "orientation", "orientation_topography"), ("Итоговое занятие", "service", "intro_final"), ("Собрание родителей", "manual", "organisation"), ("Сентябрь", "noise", "unknown"), ("Кабинет 12", "noise", "unknown"), ("Москва, Просвещение", "noise", "unknown"), ("Прочее разное", "unknown_content", "unknown_content"),
    ]
    schema = "topic_id long, program_id long, direction string, program_name string, topic_name string, topic_order int, hours int, activity_type string"
    table = [(i, 1, "Туристско-краеведческая", "Клуб", n, i, 2, "") for i, (n, *_) in enumerate(cases)] + [(100, 2, "Техническая", "Клуб", "Компас и карта", 0, 2, ""), (101, 2, None, "Клуб", "Трёхмерное черчение и 3Д", 1, 2, ""), (102, 2, "Техническая", "Клуб", "Компас и карта", 5, 1, "")]
    found = topic_rules.classify_by_scope(spark.createDataFrame(table, schema), {"tourism": ("турист|краевед", tourism)}, technical).collect()
    got = {(r.program_id, r.topic_name): r for r in found}
    placed = {(r.program_id, r.first_order): r for r in found}
    for i, (name, parent, category) in enumerate(cases):
        row = placed[1, i]
        assert (row.parent_code, row.category_code) == (parent, category), name
    assert got[2, "Компас и карта"].category_code == "unknown_content" and got[2, "Компас и карта"].rows == 2
    assert got[2, "3D черчение и 3D"].category_code == "cad_3d" and len(found) == len(cases) + 2
    with pytest.raises(ValueError):
        topic_rules.taxonomy([dict(kind="other", position=0, needles=None, phrases=None)])


def test_sync_twice_changes_nothing(spark):
    state = spark.createDataFrame([(1, "a", "ready"), (2, "b", "ready"), (3, "c", "error")], "id long, hash string, status string")
    now = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, hash string")
    once = sync.catalog_sync(state, now)
    got = {r.id: (r.status, r.catalog_status) for r in once.collect()}
    assert got == {1: ("ready", "active"), 2: ("pending", "active"), 3: ("error", "missing"), 4: ("pending", "active")}
    assert sorted(map(tuple, sync.catalog_sync(once.select("id", "hash", "status"), now).collect())) == sorted(map(tuple, once.collect()))


def understood(spark, texts, **columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return rows.select("i", *[f(F.col("t")).alias(n) for n, f in columns.items()]).orderBy("i").collect()


def test_requests(spark):
    asked = "Ребенку 7-9 лет, хочу робототехнику, но не футбол, до 3 000 руб, вечером после школы"
    (row,) = understood(spark, [asked], age=nlu.age_years, unsure=nlu.age_is_unsure, budget=nlu.budget, schedule=nlu.schedule, acts=nlu.activities, found=nlu.specific_interests)
    assert (row.age, row.unsure, row.budget) == (8, True, "до 3 000 рублей") and row.schedule == ["weekdays", "evening"]
    assert [(a.name, a.negated) for a in row.acts] == [("футбол", True), ("робототехника", False)]
    assert (row.found.terms, row.found.excluded, row.found.direction, row.found.interests) == (["робототехника", "робот"], ["футбол"], "technical", ["building", "logic"])
    rows = understood(spark, ["дочке 12", "подросток", "в 1500 метрах", "ребёнок 10 – 13", "", "первоклассник 40 дней"], age=nlu.age_years, unsure=nlu.age_is_unsure)
    assert [(r.age, r.unsure) for r in rows] == [(12, False), (13, True), (15, False), (12, True), (None, False), (7, True)]
    rows = understood(spark, ["бесплатно", "бюджет: 1500 руб", "до 900₽", "дорого", "бюджет до 2 000"], b=nlu.budget)
    assert [r.b for r in rows] == ["бесплатно", "до 1500 рублей", "до 900 рублей", "", "до 2 000 рублей"]
    rows = understood(spark, ["спорт, но спокойный темп", "спорт", "не футбол а шахматы", "заочно", "очно-заочно", "очно"], c=nlu.conflict, p=nlu.corrected, f=nlu.attendance)
    assert [r.c for r in rows] == [True, False, False, False, False, False] and rows[2].p == "шахматы" and [r.f for r in rows] == [None, None, None, 3, 2, 1]


def test_activities_of_requests(spark):
    rows = understood(spark, ["занятия по баскетболу в Оленегорске", "подберите спорт, но не футбол", "ищем флорбол для школьника", "любит танцы и шахматы", "интересует программа", "не ищем флорбол"], f=nlu.specific_interests)
    found = [r.f for r in rows]
    assert (found[0].interests, found[0].terms, found[0].labels, found[0].direction) == (["sports"], ["баскетбол", "баскет"], ["баскетбол"], "sport")
    assert found[1].terms == [] and found[1].excluded == ["футбол"] and found[1].direction is None
    assert (found[2].interests, found[2].terms, found[2].labels) == ([], ["флорбол"], ["флорбол"])
    assert found[3].labels == ["шахматы", "танцы"] and found[3].direction is None and found[4].terms == ["программирование", "программ"]


def test_places_in_any_case(spark):
    texts = ["ищем рисование в Варзуге", "подойдут занятия в ж/д ст Нял", "Мурманская область", "с Варзуга", "Мурманск и Североморск", "из Полярных Зорь в Полярные Зори", "в Кировске и под Апатитами, потом в Кировск", "рядом с Белым морем", "Мыс-Чёрный", "нялый кировский"]
    got = [r.p for r in understood(spark, texts, p=nlu.places)]
    assert got == [["Варзуга"], ["Нял"], [], ["Варзуга"], ["Мурманск", "Североморск"], ["Полярные Зори"], ["Кировск", "Апатиты"], [], ["Мыс-Чёрный"], []]
    assert understood(spark, ["в Каневке, то есть каневке"], p=lambda t: nlu.places(t, ["Клин", "Каневка"]))[0].p == ["Каневка"]


def test_calendar_rows_with_comma_decimals(spark):
    text = "\n".join(["TABLE_ROW || № || Тема || Всего || Теория || Практика", *[f"TABLE_ROW || {i} || Тема номер {i} || 2 || 0,5 || 1,5" for i in range(1, 5)], "TABLE_ROW || || Итого || 8"])
    got = extract.table_rows(spark.createDataFrame([(1, text)], "doc long, text string")).orderBy("ordinal").collect()
    assert [r.total for r in got] == [2] * 4 and [r.theory for r in got] == [Decimal("0.5")] * 4 and [r.practice for r in got] == [Decimal("1.5")] * 4


def test_calendar_layouts(spark):
    """A cell a line with comma decimals, and rows that run over lines, with sections and totals."""
    cells = "1.2 ПЛАН\n№\nТема\nВсего\nТеория\nПрактика\nФорма\n1\nВводное занятие,\nосновные сведения\n2\n0,5\n1,5\nБеседа\n2\nПервая помощь\n3\n-\n3\nОпрос\n\nИТОГО\n5\n0,5\n4,5\n1.3 СОДЕРЖАНИЕ\n"
    got = extract.cell_rows(spark.createDataFrame([(1, cells), (2, None), (3, ""), (4, "1\nбез шапки\n2\n1\n1")], "doc int, text string")).collect()
    assert [(r.doc, r.ordinal, r.topic, r.total, r.theory, r.practice) for r in got] == [(1, 1, "Вводное занятие, основные сведения", Decimal(2), Decimal("0.5"), Decimal("1.5")), (1, 2, "Первая помощь", Decimal(3), None, Decimal(3))]
    rows = "Учебный план\n№ Тема Всего Теория Практика\n1. Вводное занятие 2 1 1 беседа, игра на\nместности\nВсего часов: 2 1 1\n2. Модуль «История»\n2.1. Юнармия: символы,\nстиль, кодекс.\n1 1 - беседа\n2.2. Малая родина 20 10 10 круглый\nстол 2.3. Флот 2 1 1\nВсего часов: 23 12 11\n3. Модуль «Строй»\n3.1. Основы 1,5 1 0,5 показ"
    got = extract.inline_rows(spark.createDataFrame([(1, rows), (2, None), (3, "просто текст")], "doc int, text string")).collect()
    assert [(r.ordinal, r.section, r.topic, r.total, r.theory, r.practice) for r in got] == [
        (1, None, "Вводное занятие", 2, 1, 1), (2, "Модуль «История»", "Юнармия: символы, стиль, кодекс.", 1, 1, None), (3, "Модуль «История»", "Малая родина", 20, 10, 10), (4, "Модуль «История»", "Флот", 2, 1, 1), (5, "Модуль «Строй»", "Основы", Decimal("1.5"), 1, Decimal("0.5")),
    ]


def test_topic_patterns(spark):
    lines = ["Тема 1. Сборка робота", "2 Датчики света 6 2 4", "Моторы (4 часа)", "1.4 Пульты", "сборка РОБОТА (2 ч)", "Всего 12 4 8", "просто строка"]
    got = extract.topics(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc long, pos long, line string")).orderBy("ordinal").collect()
    assert [r.topic for r in got] == ["Сборка робота", "Датчики света", "Моторы", "Пульты"]


def test_kmeans_invariants(spark):
    rows = [(i, [1.0, 0.02 * i, 0.0] if i % 2 else [0.0, 0.02 * i, 1.0], 1.0 + i % 3) for i in range(20)] + [(99, [0.0, 0.0, 0.0], 1.0)]
    got = cluster.kmeans(spark.createDataFrame(rows, "id long, v array<double>, weight double"), k=2, rounds=10).collect()
    assert len(got) == 20 and len({r.cluster for r in got}) == 2 and all(r.similarity > 0.9 for r in got)
    assert len({r.cluster for r in got if r.id % 2}) == 1


def test_kmeans_settles(spark, sf_dir):
    found = registry.queries()["clu_kmeans"](spark, sf_dir).collect()
    assert len({r.cluster for r in found}) == 32 and all(r.settled for r in found)
    points = spark.createDataFrame([(i, [1.0, 0.1 * i], 1.0) for i in range(9)], "id long, v array<double>, weight double")
    assert {r.settled for r in cluster.kmeans(points, k=2, rounds=1).collect()} == {False}
    assert {r.settled for r in cluster.kmeans(points, k=2, rounds=80).collect()} == {True}


def brute_kmeans(rows, k, rounds):
    """Labels by id, and whether they settled, with plain loops over numpy rows."""
    import numpy as np

    ids, weight = [r[0] for r in rows], np.array([r[2] for r in rows])
    v = np.array([r[1] for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if len(rows) <= k:
        return {ids[i]: n for n, i in enumerate(sorted(range(len(rows)), key=lambda i: (-weight[i], ids[i])))}, True
    centres = [v[min(range(len(rows)), key=lambda i: (-weight[i], ids[i]))]]
    while len(centres) < k:
        score = (1 - (v @ np.array(centres).T).max(axis=1)) * weight
        centres.append(v[min(range(len(rows)), key=lambda i: (-score[i], ids[i]))])
    labels = None
    for _ in range(rounds):
        found = (v @ np.array(centres).T).argmax(axis=1)
        if labels is not None and (found == labels).all():
            return dict(zip(ids, found)), True
        labels = found
        for c in range(k):
            total = (v[labels == c] * weight[labels == c, None]).sum(axis=0)
            centres[c] = total / np.linalg.norm(total)
    return dict(zip(ids, labels)), False


@pytest.mark.parametrize("k,rounds", [(12, 80), (20, 3), (3, 1), (60, 5), (90, 5)])
def test_kmeans_brute(spark, k, rounds):
    import random

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 1.0 + rng.random()) for i in range(60)]
    got = cluster.kmeans(spark.createDataFrame(rows, "id long, v array<double>, weight double"), k=k, rounds=rounds).collect()
    labels, settled = brute_kmeans(rows, k, rounds)
    assert {r.id: r.cluster for r in got} == labels and {r.settled for r in got} == {settled}


def test_kmeans_of_few_different_points(spark):
    """Centres without points are drawn anew; more clusters than different points settle all the same."""
    rows = [(i, [1.0, float(i % 3)], 1.0) for i in range(30)]
    got = cluster.kmeans(spark.createDataFrame(rows, "id long, v array<double>, weight double"), k=7, rounds=20).collect()
    assert len(got) == 30 and all(r.similarity > 1 - 1e-9 for r in got) and len({r.cluster for r in got}) == 3
    assert cluster.kmeans(spark.createDataFrame([], "id long, v array<double>, weight double")).count() == 0


def test_tfidf_is_normalised(spark):
    rows = cluster.aggregate(spark.createDataFrame([("робот мотор", 1, "2"), ("робот датчик", 2, "1"), ("мотор", 1, "1")], "topic string, program long, hours string"))
    norms = cluster.tfidf(rows, []).groupBy("topic").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert norms and all(abs(r.n - 1) < 1e-9 for r in norms)


def test_stream_upsert_over_several_batches(spark, tmp_path):
    schema = "k long, at long, v string"
    for i in range(3):
        spark.createDataFrame([(k, i, f"v{i}") for k in range(i, 4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    stream = sessions.event_stream(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    got = sessions.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k"], ["at"])
    assert {r.k: r.v for r in got.collect()} == {0: "v0", 1: "v1", 2: "v2", 3: "v2"}


def test_entry_point_without_llm(monkeypatch):
    import importlib.util
    import sys

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("lumicat.llm") or name == "corpus_pipeline" else real(name, *a))
    assert "rank_topk" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("corpus_pipeline", None)


def test_card_texts(spark):
    group = lambda **g: [dict(id=1, price=None, free=None, day=None, hour=None) | g]
    card = lambda **c: ranking.cards(scored_rows(spark, **c), ranking.Profile()).first()
    none = card(annotation="")
    assert (none.schedule, none.price, none.note) == (ranking.NO_SCHEDULE, ranking.NO_PRICE, ranking.NO_GROUP) and none.summary.startswith('Программа из направления "Техническая"')
    free = card(groups=group(price=0.0, free=3, day="saturday", hour=10), annotation="<b>Учим детей собирать роботов из наборов.</b> Потом ещё текст.")
    assert (free.schedule, free.price, free.note, free.summary) == ("Сб 10:00", "Бесплатно", "Сейчас свободных мест: 3.", "Учим детей собирать роботов из наборов.")
    assert card(groups=group(price=1500.5)).note == ranking.NO_NOTE


def scored_rows(spark, **changes):
    return ranking.score(candidate(spark, **changes), ranking.Profile())


def test_russian_collation(spark, tmp_path):
    """The collated order against a key that ranks letters, yo behind ye, case last."""
    letters = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
    names = ["Ёлка", "елка", "Ель", "яма", "Абак", "абак", "ежик", "ёж", "Жук", "едок"]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = [r.p_name for r in registry.queries()["srt_collation_ru"](spark, str(tmp_path)).collect()]
    ye = lambda n: [letters.index(c) for c in n.lower().replace("ё", "е")]
    assert got == sorted(names, key=lambda n: (ye(n), "ё" in n.lower(), n[0].isupper()))


def test_cards_brute(spark, sf_dir):
    """Cards against the tables, programme by programme."""
    queries = registry.queries()
    ids = [r.id for r in queries["rank_topk"](spark, sf_dir).collect()]
    cards = queries["rank_card"](spark, sf_dir).collect()
    assert [r.id for r in cards] == ids
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_partkey").isin(ids)).collect()}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_partkey").isin(ids)).collect()
    for r in cards:
        own = sorted((x.l_orderkey * 10 + x.l_linenumber, x) for x in lines if x.l_partkey == r.id)

        def points(x):
            price = 3 if x.l_extendedprice <= 30000 else -1 if x.l_extendedprice <= 37500 else -4
            return price + (x.l_shipdate.isoweekday() >= 6) + (1 if x.l_linenumber * 3 >= 17 else -1) + (x.l_quantity > 10)

        best = max(own, key=lambda k: (points(k[1]), -k[0]))[1]
        part = parts[r.id]
        assert r.label == f"{part.p_name} · {part.p_brand}"
        assert r.schedule == f"{ranking.SHORT_DAYS[best.l_shipdate.strftime('%A').lower()]} {best.l_linenumber * 3}:00"
        amount = Decimal(str(best.l_extendedprice)).quantize(Decimal(1), "ROUND_HALF_UP")
        assert r.price.replace(" ", "") == f"{amount}₽запериод"
        assert r.summary == "about ring work Лучше всего совпадает с запросом на интерес к конструированию и интерес к логике и устройству вещей."
        assert r.note == " ".join([ranking.BEST_SHOWN] * (len(own) > 1) + [f"{ranking.FREE_PLACES}{int(best.l_quantity) - 10}."])
        assert r.topics == (", ".join(part.p_name.split(" ")[:6]) if part.p_size % 4 else "")


def test_kept_tables_and_broken_documents(spark, tmp_path):
    from lumicat.sources import files

    calls = []

    def fetch():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "kept")
    assert [files.kept_table(spark, path, fetch, s).count() for s in (600, 600, 0, 600)] == [1, 1, 2, 2] and len(calls) == 2
    rows = files.docx_tables(spark.createDataFrame([("a", b"no zip"), ("b", b"")], "path string, content binary")).collect()
    assert all(r.text is None and r.error for r in rows) and len(rows) == 2


def test_running_totals_resume(spark):
    rows = spark.range(1, 101)
    first = sync.running_totals(rows.where("id <= 37"), "id")
    for before in (first, sync.running_totals(rows.where("id < 0"), "id"), None):
        assert tuple(sync.running_totals(rows, "id", before).first()) == (100, 5050, 100)
    assert tuple(sync.running_totals(rows, "id", spark.createDataFrame([(5, 5, 90)], "rows long, total long, last long")).first()) == (15, 5 + sum(range(91, 101)), 100)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_activities_are_found_once(spark, sf_dir):
    """No pattern normalises the text for itself, and terms, excluded terms and direction read one list of activities."""
    plan = plan_of(registry.queries()["nlu_activity_ontology"](spark, sf_dir))
    assert plan.count("regexp_replace(") == 1 and plan.count("баскетбол[а-я]*") <= 4


def test_raw_term_splits_a_text_once(spark):
    df = spark.createDataFrame([("Ищем шахматы, по робототехнику",), ("ищем",), ("",), (None,)], "t string").select(nlu.raw_term(F.col("t")).alias("r"))
    assert plan_of(df).count("split(") == 1
    assert [r.r for r in df.collect()] == ["шахмат", None, None, None]


@pytest.mark.parametrize("name", ["nlu_llm_heuristics", "nlu_age", "nlu_profile_confidence", "nlu_format", "nlu_direction"])
def test_texts_are_normalised_once_a_function(spark, sf_dir, name):
    assert plan_of(registry.queries()[name](spark, sf_dir)).count("regexp_replace(") <= 10


def test_topics_under_review_are_classified_once(spark, sf_dir):
    from lumicat.plans import topics as plan

    text = plan.top_review(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in text and "posexplode" not in text


def test_synonyms_are_looked_for_once_before_they_are_replaced(spark):
    from lumicat.operators import topic_rules, topics
    from lumicat.operators.rules import Taxonomy

    names = spark.createDataFrame([("робот на АРДУИНО и лего",), ("карта местности",), ("html, css",), ("xhtml",)], "n string")
    rules = topic_rules.taxonomy([])
    assert [r[0] for r in names.select(topics.same_words(F.col("n"), rules)).collect()] == ["робот на Arduino и LEGO", "карта местности", "HTML, CSS", "xhtml"]
    twice = Taxonomy((), synonyms=((r"(к)арта", "план"), (r"(м)естности\2?", "места")))
    assert names.where("n like 'карта%'").select(topics.same_words(F.col("n"), twice)).first()[0] == "план места"
    assert names.where("n like 'карта%'").select(topics.same_words(F.col("n"), Taxonomy(()))).first()[0] == "карта местности"
