"""Default rules of topics, and taxonomies from tables.

Content rules are long and belong to a catalogue, so they are read from a table
of the caller (``read_taxonomy``); rules that any catalogue shares are here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.operators import topics
from lumicat.operators.rules import Rule, Taxonomy

EDGE = "[^0-9a-zа-яё]"

# --- fixed values: service rules in order (code, needles, whether content-like topics are spared)

SERVICE = (
    ("assessment", ("диагност", "контроль", "тест", "аттеста", "зачет", "опрос", "экзамен", "викторин", "провероч", "норматив"), True),
    ("intro_final", ("вводн", "инструктаж", "повтор", "заключ", "итогов", "подведение итогов", "обобщение", "рефлексия"), True),
    ("schedule", ("режим", "расписан", "продолжительность", "учебн недел", "академическ", "год обуч", "срок осво", "срок реализации", "объем программы", "наполняемость", "периодичность"), False),
    ("materials_equipment", ("кабинет", "оборудован", "материал", "литератур", "пособие", "энциклопед", "издатель", "ноутбук", "стул", "стол", "накопитель", "ssd"), True),
    ("methods", ("практическая работа", "практическая", "практические", "беседа", "демонстрац", "наблюдение", "самостоятельная", "лекция", "группов", "индивидуальн"), True),
)

# --- fixed values: noise patterns in order, against the key

NOISE = (
    (rf"(^|{EDGE})(м\.|москва|санкт-петербург|петербург|пресс|просвещение|астрель|диалектика|бхв|наука|бином|лаборатория знаний|мозаика-синтез)({EDGE}|$)", "toc_fragment"),
    ("^(январь|февраль|март|апрель|май|июнь|июль|август|сентябрь|октябрь|ноябрь|декабрь)$", "too_generic"),
    (rf"^(каб\.?|кабинет|аудитория|зал|дюц|мбу|мау|моу)({EDGE}|$)", "location_fragment"),
    ("^-[0-9]+ +год", "ocr_noise"),
)
GENERIC = ("цели", "формы", "текст", "результат", "урок", "занятие", "макс", "транспорт", "информация", "интернет", "компьютерный", "компьютер", "практика", "теория", "введение", "специальная", "техническая", "тактическая", "подготовка")

# --- fixed values: spellings that mean the same, as whole words

SYNONYMS = (("3д", "3D"), ("тр[её]хмерн[а-яё]*", "3D"), ("ардуино", "Arduino"), ("лего", "LEGO"), ("пайтон", "Python"), ("джаваскрипт", "JavaScript"), ("скретч", "Scratch"), ("html", "HTML"), ("css", "CSS"), ("sql", "SQL"), ("ev3", "EV3"), ("wedo", "WeDo"))

# --- end of fixed values

#: Columns of a table of rules; ``position`` orders the rules of a kind.
SCHEMA = "kind string, position int, code string, name string, parent string, needles array<string>, phrases array<string>, pattern string, record_type string, guarded boolean"


def taxonomy(rows: Iterable, defaults: bool = True) -> Taxonomy:
    """A taxonomy from rows of ``SCHEMA``; kinds without a row are the default ones, or empty.

    Kinds: content (code, name, parent, needles, phrases), service (code, needles,
    guarded), manual (pattern, record_type, code), noise (pattern, code), generic
    (code is the word), synonym (pattern, name).
    """
    made: dict[str, list] = {k: [] for k in ("content", "service", "manual", "noise", "generic", "synonym")}
    for r in sorted(rows, key=lambda r: (r["kind"], r["position"])):
        if r["kind"] not in made:
            raise ValueError(f"rules have no kind {r['kind']}")
        needles, phrases = tuple(r["needles"] or ()), tuple(r["phrases"] or ())
        made[r["kind"]].append(
            {
                "content": lambda: Rule(r["code"], r["name"], r["parent"], needles, phrases), "service": lambda: (r["code"], needles, bool(r["guarded"])), "manual": lambda: (r["pattern"], r["record_type"], r["code"]),
                "noise": lambda: (r["pattern"], r["code"]), "generic": lambda: r["code"], "synonym": lambda: (r["pattern"], r["name"]),
            }[r["kind"]]()
        )
    usual = {"service": SERVICE, "noise": NOISE, "generic": GENERIC, "synonym": SYNONYMS} if defaults else {}
    chosen = {k: tuple(v) or usual.get(k, ()) for k, v in made.items()}
    return Taxonomy(content=chosen["content"], service=chosen["service"], manual=chosen["manual"], noise=chosen["noise"], generic=chosen["generic"], synonyms=chosen["synonym"])


def read_taxonomy(spark: SparkSession, path: str, defaults: bool = True) -> Taxonomy:
    """A taxonomy from JSON lines of ``SCHEMA``: some hundred rules, which become one expression."""
    return taxonomy(spark.read.schema(SCHEMA).json(path).collect(), defaults)


def classify_by_scope(rows: DataFrame, scopes: dict[str, tuple[str, Taxonomy]], other: Taxonomy) -> DataFrame:
    """Classified topics, each programme by the taxonomy of its scope.

    ``scopes`` maps a scope to a pattern of the lower-cased direction and its
    taxonomy, the first that hits; directions that none hits have ``other``.
    """
    direction, taken, parts = F.lower("direction"), F.lit(False), []
    for pattern, rules in [*scopes.values(), (None, other)]:
        hit = F.lit(True) if pattern is None else F.coalesce(direction.rlike(pattern), F.lit(False))
        own = rows.where(hit & ~taken)
        parts.append(topics.classify(topics.aggregate(topics.normalize(topics.distinct_names(own), rules)), rules))
        taken = taken | hit
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
