"""Topic pipeline on the lines of documents: a document is a programme, a line a topic row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumicat.operators import topic_rules, topics
from lumicat.operators.rules import Rule, Taxonomy
from lumicat.plans import scalars as sql
from lumicat.plans.registry import register
from lumicat.session import checkpointed, remove_folder, shared_folder, table

#: A taxonomy for the test texts.
TEST = Taxonomy(
    content=(
        Rule("articles", "Articles", "grammar", ("the", "ther"), ("of the", "in the")),
        Rule("german", "German", "language", ("ung", "heit", "keit"), ("und der",)),
        Rule("french", "French", "language", ("eau", "tion", "ment"), ("de la",)),
        Rule("spanish", "Spanish", "language", ("mente", "ado"), ("de la", "los")),
        Rule("notes", "Notes", "grammar", ("onan", "erin"), ()),
    ),
    service=(("assessment", ("exam", "wasan"), True), ("schedule", ("anone", "inin"), False), ("methods", ("edan", "atst"), True)),
    manual=(("^the .*ble$", "service", "organisation"), ("^en .*$", "content", "introductions"), ("^un[aeo]? ", "noise", "manual_noise")),
    noise=(("^(thet|thth)[a-z]*$", "location_fragment"), ("^ou[a-z]* ", "ocr_noise")),
    generic=("the", "er", "of", "rights", "de"),
)

_ROWS = """rows0 as (select doc_id as program_id, lang as direction, source as program_name, unnest(string_split(text, chr(10))) as topic_name,
  unnest(range(len(string_split(text, chr(10)))))::int as topic_order from documents),
rows1 as (select *, doc_id_key * 100000 + topic_order as topic_id, trim(coalesce(topic_name, '')) as raw, length(topic_name) % 7 as hours from (select *, program_id as doc_id_key from rows0))"""


def topic_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("program_id"), F.col("lang").alias("direction"), F.col("source").alias("program_name"), F.posexplode(F.split("text", "\n")).alias("topic_order", "topic_name"))
    return lines.select("*", (F.col("program_id") * 100000 + F.col("topic_order")).alias("topic_id"), (F.length("topic_name") % 7).alias("hours"), F.lit("").alias("activity_type"))


def _any(col: str, needles) -> str:
    return "(" + " or ".join(f"contains({col}, '{n}')" for n in needles) + ")" if needles else "false"


def _hits(col: str, needles) -> str:
    return "(" + " + ".join(["0", *[f"contains({col}, '{n}')::int" for n in needles]]) + ")"


def _content(rules: Taxonomy) -> str:
    return _any("topic_key", [n for r in rules.content for n in (*r.needles, *r.phrases)])


def _noise(rules: Taxonomy) -> str:
    fixed = "case when topic_key = '' then 'unknown' when length(topic_key) <= 2 then 'too_generic' when lower(raw) like 'table_row%' then 'ocr_noise' when regexp_matches(topic_key, '^[0-9 .,:;/-]+$') then 'ocr_noise' when regexp_matches(topic_key, '(^|[^0-9])(19[0-9][0-9]|20[0-2][0-9])\\.?$') and length(topic_key) < 120 then 'toc_fragment' when regexp_matches(raw, '\\.{4,}|…{2,}') then 'toc_fragment' "
    return fixed + " ".join(f"when regexp_matches(topic_key, '{p}') then '{r}'" for p, r in rules.noise) + f" when trim(topic_key, ' .-') in ({', '.join(repr(g) for g in rules.generic)}) then 'too_generic' else '' end"


def _manual(rules: Taxonomy, i: int) -> str:
    return "case " + " ".join(f"when regexp_matches(topic_key, '{m[0]}') then '{m[i]}'" for m in rules.manual) + " else '' end"


def _service(rules: Taxonomy) -> str:
    return "case " + " ".join(f"when {_any('topic_key', n)} and ({'not ' + _content(rules) if g else 'true'}) then '{c}'" for c, n, g in rules.service) + " else '' end"


def _cleaned(rules: Taxonomy) -> str:
    out = sql.clean("raw")
    for pattern, word in rules.synonyms:
        out = f"regexp_replace({out}, '(^|[^0-9a-zа-яё])(?:{pattern})([^0-9a-zа-яё]|$)', '\\1{word}\\2', 'gi')"
    return out


_ACTIVITY_TEXT = sql.key("' ' || raw")
_ACTIVITY = "case " + " ".join(f"when regexp_matches(activity_key, '{p}') then '{n}'" for n, p in sql.ACTIVITY_PATTERNS) + " else 'не определено' end"

def _normalized(rules: Taxonomy, rows: str) -> str:
    return f"""{rows},
cleaned as (select *, {_cleaned(rules)} as clean_name, {_ACTIVITY_TEXT} as activity_key from rows1),
keyed as (select *, {sql.key('clean_name')} as topic_key from cleaned),
noisy as (select *, {_noise(rules)} as noise_reason from keyed),
manual as (select *, case when noise_reason = '' then {_manual(rules, 1)} else '' end as man from noisy),
served as (select *, case when noise_reason = '' and man = '' then {_service(rules)} else '' end as service_code from manual),
normalized as (select program_id, direction, program_name, topic_id, topic_order, hours, topic_key, noise_reason, service_code,
  case when noise_reason <> '' then 'noise' when man <> '' then man when service_code <> '' then 'service' else 'content' end as record_type,
  ((case when noise_reason <> '' then 90 else least(95, 72 + case when clean_name <> '' and clean_name <> raw then 8 else 0 end + case when service_code <> '' then 8 else 0 end + case when length(clean_name) between 8 and 120 then 8 else 0 end) end)::decimal(18,4) / 100)::decimal(4,2) as confidence,
  {_ACTIVITY} as activity, coalesce(nullif(clean_name, ''), raw) as topic_name from served)"""


_NORMALIZED = _normalized(TEST, _ROWS)


@register("top_normalize", f"with {_NORMALIZED} select topic_id, md5(topic_name) as name_hash, md5(topic_key) as key_hash, record_type, service_code, confidence, activity from normalized")
def top_normalize(spark, sf_dir):
    out = topics.normalize(topic_rows(spark, sf_dir), TEST)
    return out.select("topic_id", F.md5("topic_name").alias("name_hash"), F.md5("topic_key").alias("key_hash"), "record_type", "service_code", "confidence", "activity")


@register("top_noise", f"with {_NORMALIZED} select noise_reason, count(*)::bigint as n from normalized group by 1")
def top_noise(spark, sf_dir):
    return topics.normalize(topic_rows(spark, sf_dir), TEST).groupBy("noise_reason").agg(F.count("*").alias("n"))


@register("top_service", f"with {_NORMALIZED} select program_id, service_code, count(*)::bigint as n from normalized where service_code <> '' group by 1, 2")
def top_service(spark, sf_dir):
    return topics.normalize(topic_rows(spark, sf_dir), TEST).where("service_code <> ''").groupBy("program_id", "service_code").agg(F.count("*").alias("n"))


@register("top_manual", f"with {_NORMALIZED}, m as (select record_type, {_manual(TEST, 2)} as code from normalized where noise_reason = '') select code, record_type, count(*)::bigint as n from m where code <> '' group by 1, 2")
def top_manual(spark, sf_dir):
    out = topics.normalize(topic_rows(spark, sf_dir), TEST).where("manual_code <> ''")
    return out.groupBy(F.col("manual_code").alias("code"), "record_type").agg(F.count("*").alias("n"))


@register("top_scope", "select doc_id, case when lang in ('fr', 'es') then 'romance' else 'other' end as scope from documents")
def top_scope(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").rlike("^(fr|es)"), "romance").otherwise("other").alias("scope"))


def _aggregated(rules: Taxonomy, rows: str) -> str:
    return f"""{_normalized(rules, rows)},
agg as (select program_id, record_type, coalesce(nullif(topic_key, ''), 'unknown') as topic_key, arg_min(topic_name, topic_id) as topic_name, count(*)::bigint as rows,
  min(topic_order) as first_order, sum(hours::decimal(18,4)) as hours_total, sum(case when activity = 'контроль' then hours else 0 end::decimal(18,4)) as hours_control,
  min(program_name) as program_name, min(direction) as direction from normalized group by 1, 2, 3)"""


_AGGREGATED = _aggregated(TEST, _ROWS)


def aggregates(spark, sf_dir):
    return topics.aggregate(topics.normalize(topics.distinct_names(topic_rows(spark, sf_dir)), TEST))


@register("top_aggregate", f"with {_AGGREGATED} select program_id, record_type, md5(topic_key) as key_hash, md5(topic_name) as name_hash, rows, first_order, hours_total::bigint as hours, hours_control::bigint as control from agg")
def top_aggregate(spark, sf_dir):
    out = aggregates(spark, sf_dir)
    return out.select("program_id", "record_type", F.md5("topic_key").alias("key_hash"), F.md5("topic_name").alias("name_hash"), "rows", "first_order", F.col("hours_total").cast("bigint").alias("hours"), F.col("hours_control").cast("bigint").alias("control"))


def _classified(rules: Taxonomy, rows: str) -> str:
    scores = " union all ".join(f"select {i} as ord, '{r.code}' as code, '{r.parent}' as parent, {_hits('tk', r.phrases)} as ph, {_hits('tk', r.needles)} as nd, least(4, {_hits('ck', r.needles)}) as cx, * from base" for i, r in enumerate(rules.content))
    return f"""{_aggregated(rules, rows)},
base as (select *, {sql.key('topic_name')} as tk, {sql.key('program_name')} as ck, {_service(rules)} as svc, {_manual(rules, 2)} as man2 from agg),
scores as ({scores}),
placed as (select *, ph * 6 + nd * 4 + cx as halves, row_number() over (partition by program_id, record_type, topic_key order by ph * 6 + nd * 4 + cx desc, ord) as rn from scores),
best as (select p.*, s.halves as second, (select 1) as one, t.tops from placed p
  join placed s on s.rn = 2 and (s.program_id, s.record_type, s.topic_key) = (p.program_id, p.record_type, p.topic_key)
  join (select program_id, record_type, topic_key, coalesce(string_agg(code || ':' || halves, ',' order by rn) filter (where rn <= 3 and halves > 0), '') as tops from placed group by 1, 2, 3) t
    on (t.program_id, t.record_type, t.topic_key) = (p.program_id, p.record_type, p.topic_key)
  where p.rn = 1),
classified as (select program_id, record_type, topic_key, topic_name, rows, hours_total,
  case when record_type = 'noise' then 'noise' when man2 <> '' then 'manual' when record_type = 'service' or svc <> '' then 'service' when ph + nd > 0 then parent else 'unknown_content' end as parent_code,
  case when record_type = 'noise' then 'unknown' when man2 <> '' then man2 when record_type = 'service' or svc <> '' then coalesce(nullif(svc, ''), 'methods') when ph + nd > 0 then code else 'unknown_content' end as category_code,
  ((case when record_type = 'noise' then 35 when man2 <> '' then 95 when record_type = 'service' or svc <> '' then case when svc <> '' then 86 else 62 end
    when ph + nd > 0 then greatest(35, least(96, 52 + least(32, halves * 4) + case when ph > 0 then 8 else 0 end + case when nd >= 2 then 6 else 0 end - case when second > 0 and halves - second < 3 then 18 else 0 end))
    when halves > 0 then 42 else 34 end)::decimal(18,4) / 100)::decimal(4,2) as class_confidence,
  case when record_type in ('noise') or man2 <> '' or record_type = 'service' or svc <> '' then '' else tops end as top_categories from best)"""


_CLASSIFIED = _classified(TEST, _ROWS)


def classified(spark, sf_dir):
    return topics.classify(aggregates(spark, sf_dir), TEST)


@register("top_classify", f"with {_CLASSIFIED} select program_id, record_type, md5(topic_key) as key_hash, parent_code, category_code, class_confidence from classified")
def top_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("program_id", "record_type", F.md5("topic_key").alias("key_hash"), "parent_code", "category_code", "class_confidence")


@register("top_score", f"with {_CLASSIFIED} select program_id, record_type, md5(topic_key) as key_hash, top_categories from classified where top_categories <> ''")
def top_score(spark, sf_dir):
    return classified(spark, sf_dir).where("top_categories <> ''").select("program_id", "record_type", F.md5("topic_key").alias("key_hash"), "top_categories")


@register("top_confidence", f"with {_CLASSIFIED} select class_confidence, count(*)::bigint as n from classified group by 1")
def top_confidence(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("class_confidence").agg(F.count("*").alias("n"))


_GOLD = f"""{_CLASSIFIED},
goldrows as (select c.topic_key, case when quality = 1 then 'good' else 'bad' end as gold_code from classified c join labels on doc_id = program_id where c.record_type = 'content' and rows >= 2),
gold as (select topic_key, gold_code from (select topic_key, gold_code, row_number() over (partition by topic_key order by count(*) desc, gold_code) as rn from goldrows group by 1, 2) where rn = 1),
labelled as (select c.program_id, c.record_type, c.topic_key, c.rows, c.hours_total, coalesce(gold_code, category_code) as category_code, case when gold_code is not null then 0.99 else class_confidence end::decimal(4,2) as class_confidence, gold_code is not null as from_gold
  from classified c left join gold g on c.topic_key = g.topic_key)"""


def labelled(spark, sf_dir):
    # labels come from the topics that they are given to, so topics are classified once and written
    made = checkpointed(classified(spark, sf_dir).select("program_id", "record_type", "topic_key", "rows", "hours_total", "category_code", "class_confidence"))
    rows = made.where("record_type = 'content' and rows >= 2").join(table(spark, sf_dir, "labels"), F.col("doc_id") == F.col("program_id")).select("topic_key", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold_code"))
    return topics.apply_gold(made, topics.golden_labels(rows))


@register("top_golden", f"with {_GOLD} select program_id, record_type, md5(topic_key) as key_hash, category_code, class_confidence, from_gold from labelled")
def top_golden(spark, sf_dir):
    return labelled(spark, sf_dir).select("program_id", "record_type", F.md5("topic_key").alias("key_hash"), "category_code", "class_confidence", "from_gold")


_REVIEW = "case when category_code = 'unknown_content' then 'unknown_content' when class_confidence < 0.6 then 'low_confidence' when category_code = 'unknown' and rows >= 2 then 'frequent_unknown' when record_type = 'noise' and hours_total >= 10 then 'high_hours_noise' end"


@register("top_review", f"with {_GOLD} select program_id, record_type, md5(topic_key) as key_hash, {_REVIEW} as reason from labelled where {_REVIEW} is not null")
def top_review(spark, sf_dir):
    return topics.review_queue(labelled(spark, sf_dir)).select("program_id", "record_type", F.md5("topic_key").alias("key_hash"), "reason")


@register(
    "top_eval",
    f"with {_CLASSIFIED}, judged as (select category_code, (category_code in ('articles', 'notes')) = (lang = 'en') as ok from classified join documents on doc_id = program_id where record_type = 'content') select category_code, count(*)::bigint as total, count(*) filter (where ok)::bigint as correct, round(count(*) filter (where ok)::decimal(18,6) / count(*), 4)::decimal(18,4) as accuracy from judged group by 1",
)
def top_eval(spark, sf_dir):
    made = classified(spark, sf_dir).where("record_type = 'content'").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("doc_id") == F.col("program_id"))
    ok = F.col("category_code").isin("articles", "notes") == (F.col("lang") == "en")
    out = made.groupBy("category_code").agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"))
    return out.withColumn("accuracy", F.round(F.col("correct").cast("decimal(18,6)") / F.col("total"), 4).cast("decimal(18,4)"))


@register("top_exports", f"with {_CLASSIFIED} select record_type, parent_code, category_code, count(*)::bigint as topics, count(distinct program_id)::bigint as programs, sum(hours_total)::bigint as hours from classified group by 1, 2, 3")
def top_exports(spark, sf_dir):
    out = classified(spark, sf_dir).groupBy("record_type", "parent_code", "category_code").agg(F.count("*").alias("topics"), F.count_distinct("program_id").alias("programs"), F.sum("hours_total").cast("bigint").alias("hours"))
    return out.orderBy(F.when(F.col("record_type") == "content", 0).when(F.col("record_type") == "service", 1).otherwise(2), F.desc("programs"), "category_code")


@register("top_annotate", "select source, case when regexp_matches(lower(text), 'rights reserved') then 'license' when regexp_matches(lower(text), '(^|[^a-z])idiot([^a-z]|$)') then 'abuse' else 'none' end as note, count(*)::bigint as n from documents group by 1, 2")
def top_annotate(spark, sf_dir):
    low = F.lower("text")
    note = F.when(low.rlike("rights reserved"), "license").when(low.rlike("(^|[^a-z])idiot([^a-z]|$)"), "abuse").otherwise("none")
    return table(spark, sf_dir, "documents").groupBy("source", note.alias("note")).agg(F.count("*").alias("n"))


@register("top_markup_apply", "with q as (select doc_id, case when quality = 1 then 'reviewed' else 'rejected' end as status from labels) select d.doc_id, coalesce(q.status, 'open') as status, case when q.status = 'reviewed' then 0.99 when q.status is not null then 0.5 else 0.34 end::decimal(4,2) as confidence from documents d left join q on d.doc_id = q.doc_id")
def top_markup_apply(spark, sf_dir):
    """Markup staged beside the queue: earlier marks of the batch go, new ones are applied in one join."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "reviewed").otherwise("rejected").alias("mark"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left")
    confidence = F.when(F.col("mark") == "reviewed", F.lit("0.99")).when(F.col("mark").isNotNull(), F.lit("0.50")).otherwise(F.lit("0.34")).cast("decimal(4,2)")
    return joined.select("doc_id", F.coalesce("mark", F.lit("open")).alias("status"), confidence.alias("confidence"))


#: Rules of a catalogue as rows of a table (kind, position, code, name, parent, needles, phrases, pattern, record_type).
CATALOGUE = (
    ("content", 0, "modeling_3d", "3D", "engineering", ["3d", "модел", "чертеж"], ["3d модел"], None, None),
    ("content", 1, "robotics", "Robots", "engineering", ["робот", "arduino", "lego", "датчик"], ["сборка робота"], None, None),
    ("content", 2, "programming", "Programs", "computing", ["программир", "python", "алгоритм", "html", "scratch"], ["язык python"], None, None),
    ("content", 3, "hiking", "Hikes", "tourism", ["поход", "ориентирован", "карт", "краевед"], ["родному краю"], None, None),
    ("manual", 0, "organisation", None, None, None, None, "^встреча с родител", "service"),
    ("manual", 1, "excursions", None, None, None, None, "^экскурсия ", "content"),
)
_MADE = topic_rules.taxonomy([dict(zip(("kind", "position", "code", "name", "parent", "needles", "phrases", "pattern", "record_type", "guarded"), (*r, None))) for r in CATALOGUE])
#: Topics of syllabuses, planted among the lines of the test texts.
PLANTED = (
    "3д моделирование деталей", "Сборка робота на ардуино", "Диагностика знаний", "Вводное занятие. Инструктаж", "Расписание занятий", "Основы программирования на пайтон", "Практическая работа с картой", "Январь", "Введение",
    "Поход по родному краю", "Ориентирование на местности", "Итоговая викторина о походах", "Работа с литературой", "Встреча с родителями", "Экскурсия в музей", "Чертеж и датчик", "Москва: Просвещение, 2012", "Беседа о дружбе",
)
_PLANTED_ROWS = _ROWS.replace("rows0 as (", "rows00 as (").replace(
    "rows1 as (",
    f"""planted as (select [{', '.join(f"'{x}'" for x in PLANTED)}] as p),
rows0 as (select program_id, direction, program_name, topic_order, case topic_order % 3 when 0 then p[1 + (program_id + topic_order) % {len(PLANTED)}] when 1 then p[1 + (program_id + topic_order) % {len(PLANTED)}] || ' ' || topic_name else topic_name end as topic_name from rows00, planted),
rows1 as (""",
)


def catalogue_rules(spark) -> Taxonomy:
    """The rules of ``CATALOGUE`` with the default ones, read back from a table."""
    path = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    spark.createDataFrame([(*r, None) for r in CATALOGUE], topic_rules.SCHEMA).write.json(path)
    rules = topic_rules.read_taxonomy(spark, path)
    remove_folder(spark, path)
    return rules


@register("top_classify_rules", f"with {_classified(_MADE, _PLANTED_ROWS)} select program_id, record_type, md5(topic_key) as key_hash, md5(topic_name) as name_hash, rows, parent_code, category_code, class_confidence, top_categories from classified")
def top_classify_rules(spark, sf_dir):
    """Service, noise, generic and synonym rules as they ship, content and manual rules from a table."""
    rules = catalogue_rules(spark)
    lines = topic_rows(spark, sf_dir)
    planted = F.get(F.array(*[F.lit(x) for x in PLANTED]), ((F.col("program_id") + F.col("topic_order")) % len(PLANTED)).cast("int"))
    kind = F.col("topic_order") % 3
    rows = lines.withColumn("topic_name", F.when(kind == 0, planted).when(kind == 1, F.concat(planted, F.lit(" "), F.col("topic_name"))).otherwise(F.col("topic_name")))
    rows = rows.withColumn("hours", F.length("topic_name") % 7)
    out = topics.classify(topics.aggregate(topics.normalize(topics.distinct_names(rows), rules)), rules)
    return out.select("program_id", "record_type", F.md5("topic_key").alias("key_hash"), F.md5("topic_name").alias("name_hash"), "rows", "parent_code", "category_code", "class_confidence", "top_categories")
