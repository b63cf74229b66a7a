"""Topic rows: normalise, aggregate, classify, override by gold labels, queue for review.

Order of precedence is noise, manual rule, service rule, content. Rows that
repeat a name within a programme are counted before any rule runs
(``distinct_names``), and codes found while normalising are carried to the
classification, so no rule runs twice for a topic. Only aggregates are scored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators.rules import Taxonomy, any_of, first_match, scored
from lumicat.operators.staging import staged

LOW_CONFIDENCE = 0.6
#: Letters and digits of words, whatever is beside them is the edge of a word.
WORD = "0-9a-zа-яё"


def _refers(pattern: str) -> bool:
    """Whether a pattern refers to its groups by number or name."""
    return re.search(r"\\[1-9k]", pattern) is not None


def looked_behind(pattern: str) -> str:
    """``pattern`` for tests of whether it hits: an edge in front, ``(^|[^...])``, is looked back at and not matched.

    A search tries the edge at every character of a text, where a look back costs a third of a group that matches.
    """
    edge = re.match(r"\(\^\|\[\^([^]\[^\\&]+)\]\)(?![*+?{])", pattern)
    return pattern if edge is None or _refers(pattern) else f"(?<![{edge[1]}]){pattern[edge.end():]}"


def noise_reason(key: Column, raw: Column, taxonomy: Taxonomy) -> Column:
    """Why a topic is noise, or an empty string: ordered tests, fixed ones first."""
    tests = [
        (F.coalesce(key, F.lit("")) == "", "unknown"),
        (F.length(key) <= 2, "too_generic"),
        (F.lower(raw).startswith("table_row"), "ocr_noise"),
        (key.rlike(r"^[0-9 .,:;/-]+$"), "ocr_noise"),
        ((F.length(key) < 120) & F.right(key, F.lit(6)).rlike(r"(^|[^0-9])(19[0-9][0-9]|20[0-2][0-9])\.?$"), "toc_fragment"),
        (raw.contains("....") | raw.contains("……"), "toc_fragment"),
        *[(key.rlike(looked_behind(pattern)), reason) for pattern, reason in taxonomy.noise],
        (F.btrim(key, F.lit(" .-")).isin(list(taxonomy.generic)) if taxonomy.generic else F.lit(False), "too_generic"),
    ]
    return first_match([(t, F.lit(r)) for t, r in tests], F.lit(""))


def service_code(key: Column, taxonomy: Taxonomy) -> Column:
    """First service rule that hits; guarded rules don't fire on content-like topics."""
    content = any_of(key, tuple(n for rule in taxonomy.content for n in (*rule.needles, *rule.phrases)))
    return first_match([(any_of(key, needles) & (~content if guarded else F.lit(True)), F.lit(code)) for code, needles, guarded in taxonomy.service], F.lit(""))


def manual_rule(key: Column, taxonomy: Taxonomy) -> Column:
    """Record type and code of the first manual rule whose pattern hits, both empty where none does."""
    both = lambda kind, code: F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"))
    out = F.when(F.lit(False), both("", ""))
    for pattern, kind, code in taxonomy.manual:
        out = out.when(key.rlike(looked_behind(pattern)), both(kind, code))
    return out.otherwise(both("", ""))


def same_words(name: Column, taxonomy: Taxonomy) -> Column:
    """Synonyms by their common spelling. Few names hold one, so one search for all, where words begin, comes before the twelve or more replacements."""
    out = name
    for pattern, word in taxonomy.synonyms:
        out = F.regexp_replace(out, rf"(?iu)(^|[^{WORD}])(?:{pattern})(?=[^{WORD}]|$)", f"$1{word}")
    if not taxonomy.synonyms or any(_refers(pattern) for pattern, _ in taxonomy.synonyms):
        return out  # references to groups mean others in a joined pattern
    begins = rf"(?iu)(?<![{WORD}])(?:{'|'.join(f'(?:{pattern})' for pattern, _ in taxonomy.synonyms)})"
    return F.when(name.rlike(begins), out).otherwise(name)


def distinct_names(rows: DataFrame) -> DataFrame:
    """One row per programme, topic name and activity: the first topic id, the number of rows, the hours of all.

    For ``aggregate``, which gives the same result from these as from all rows.
    """
    return rows.groupBy("program_id", "topic_name", "activity_type").agg(
        F.min("topic_id").alias("topic_id"),
        F.min("topic_order").alias("topic_order"),
        F.sum(F.coalesce("hours", F.lit(0)).cast("decimal(18,4)")).cast("decimal(18,4)").alias("hours"),
        F.min("direction").alias("direction"),
        F.min("program_name").alias("program_name"),
        F.count("*").alias("rows"),
    )


def normalize(rows: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Adds clean name, key, activity, noise reason, codes, record type and confidence to topic rows.

    ``rows`` has topic_name and activity_type.
    """
    raw = F.trim(F.coalesce("topic_name", F.lit("")))
    out = staged(staged(rows, _raw=raw), clean_name=fx.once(fx.clean_topic(F.col("_raw")), lambda c: same_words(c, taxonomy)))
    out = staged(out, topic_key=fx.normalize_key(F.col("clean_name")))
    out = staged(out, noise_reason=noise_reason(F.col("topic_key"), F.col("_raw"), taxonomy))
    out = staged(out, _rule=F.when(F.col("noise_reason") == "", manual_rule(F.col("topic_key"), taxonomy)))
    out = out.withColumns({"_manual": F.coalesce("_rule.kind", F.lit("")), "manual_code": F.coalesce("_rule.code", F.lit(""))})
    out = staged(out, service_code=F.when((F.col("noise_reason") == "") & (F.col("_manual") == ""), service_code(F.col("topic_key"), taxonomy)).otherwise(""))
    record = F.when(F.col("noise_reason") != "", "noise").when(F.col("_manual") != "", F.col("_manual")).when(F.col("service_code") != "", "service").otherwise("content")
    parts = F.lit(72) + F.when((F.col("clean_name") != "") & (F.col("clean_name") != F.col("_raw")), 8).otherwise(0) + F.when(F.col("service_code") != "", 8).otherwise(0) + F.when(F.length("clean_name").between(8, 120), 8).otherwise(0)
    confidence = F.when(F.col("noise_reason") != "", 90).otherwise(F.least(F.lit(95), parts))
    return (
        out.withColumn("record_type", record)
        .withColumn("confidence", (confidence.cast("decimal(18,4)") / 100).cast("decimal(4,2)"))
        .withColumn("activity", fx.activity_type(F.col("activity_type"), F.col("_raw")))
        .withColumn("topic_name", F.coalesce(F.nullif("clean_name", F.lit("")), F.col("_raw")))
        .drop("_raw", "_rule", "_manual", "clean_name")
    )


def aggregate(normalized: DataFrame) -> DataFrame:
    """One row per programme, record type and key; the name is that of the lowest topic id.

    Takes topic rows, or those of ``distinct_names`` with their number of rows.
    """
    rows = F.sum("rows") if "rows" in normalized.columns else F.count("*")
    key = F.coalesce(F.nullif("topic_key", F.lit("")), F.lit("unknown"))
    hours = F.coalesce("hours", F.lit(0)).cast("decimal(18,4)")
    return normalized.groupBy("program_id", "record_type", key.alias("topic_key")).agg(
        F.min(F.struct("topic_id", "topic_name"))["topic_name"].alias("topic_name"),
        rows.alias("rows"),
        F.min("topic_order").alias("first_order"),
        F.sum(hours).alias("hours_total"),
        F.sum(F.when(F.col("activity") == "контроль", hours).otherwise(F.lit(0).cast("decimal(18,4)"))).alias("hours_control"),
        F.min("direction").alias("direction"),
        F.min("program_name").alias("program_name"),
        # functions of the key where they are looked at
        F.min("service_code").alias("service_code"),
        F.min("manual_code").alias("manual_code"),
    )


def classify(aggregates: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Adds parent, category, class confidence and the top categories."""
    out = staged(aggregates, _context=fx.normalize_key(F.col("program_name")))
    out = staged(out, _s=scored(F.col("topic_key"), F.col("_context"), taxonomy.content)).withColumnsRenamed({"service_code": "_service", "manual_code": "_manual"})
    best, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    found = (best["phrases"] + best["needles"]) > 0
    halves, gap = -best["minus"], second["minus"] - best["minus"]
    points = (
        F.lit(52) + F.least(F.lit(32), halves * 4) + F.when(best["phrases"] > 0, 8).otherwise(0) + F.when(best["needles"] >= 2, 6).otherwise(0) - F.when((second["minus"] < 0) & (gap < 3), 18).otherwise(0)
    )
    noise, service = F.col("record_type") == "noise", (F.col("record_type") == "service") | (F.col("_service") != "")
    manual = (F.col("_manual") != "") & ~noise
    category = F.when(noise, "unknown").when(manual, F.col("_manual")).when(service, F.coalesce(F.nullif("_service", F.lit("")), F.lit("methods"))).when(found, best["code"]).otherwise("unknown_content")
    parent = F.when(noise, "noise").when(manual, "manual").when(service, "service").when(found, best["parent"]).otherwise("unknown_content")
    percent = F.when(noise, 35).when(manual, 95).when(service, F.when(F.col("_service") != "", 86).otherwise(62)).when(found, F.greatest(F.lit(35), F.least(F.lit(96), points))).otherwise(F.when(halves > 0, 42).otherwise(34))
    tops = F.transform(F.slice(F.filter("_s", lambda x: x["minus"] < 0), 1, 3), lambda x: F.concat(x["code"], F.lit(":"), (-x["minus"]).cast("string")))
    return (
        out.withColumn("parent_code", parent)
        .withColumn("category_code", category)
        .withColumn("class_confidence", (percent.cast("decimal(18,4)") / 100).cast("decimal(4,2)"))
        .withColumn("top_categories", F.when(parent.isin("noise", "manual", "service"), "").otherwise(F.array_join(tops, ",")))
        .drop("_s", "_service", "_manual", "_context")
    )


def apply_gold(classified: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold labels (topic_key, gold_code) win with confidence 0.99."""
    joined = classified.join(gold, "topic_key", "left")
    return joined.select(
        *[c for c in classified.columns if c not in ("category_code", "class_confidence")],
        F.coalesce("gold_code", "category_code").alias("category_code"),
        F.when(F.col("gold_code").isNotNull(), F.lit("0.99").cast("decimal(4,2)")).otherwise(F.col("class_confidence")).alias("class_confidence"),
        F.col("gold_code").isNotNull().alias("from_gold"),
    )


def review_queue(classified: DataFrame) -> DataFrame:
    """Classified topics that a person should look at, with the reason."""
    reason = (
        F.when(F.col("category_code") == "unknown_content", "unknown_content")
        .when(F.col("class_confidence") < LOW_CONFIDENCE, "low_confidence")
        .when((F.col("category_code") == "unknown") & (F.col("rows") >= 2), "frequent_unknown")
        .when((F.col("record_type") == "noise") & (F.col("hours_total") >= 10), "high_hours_noise")
    )
    return classified.withColumn("reason", reason).where("reason is not null")


def golden_labels(gold_rows: DataFrame) -> DataFrame:
    """topic_key, gold_code: the most frequent label of a key, the smallest code on ties."""
    counted = gold_rows.groupBy("topic_key", "gold_code").agg(F.count("*").alias("n"))
    return counted.groupBy("topic_key").agg(F.min(F.struct((-F.col("n")).alias("m"), "gold_code"))["gold_code"].alias("gold_code"))
