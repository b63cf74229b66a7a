"""Scalar functions, each over a whole table; key columns make rows comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.plans.registry import register
from lumicat.session import table

NBSP = "chr(160)"


def scalar(name: str, source: str, key: str, made: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """Registers a query of key columns and computed columns, and the same in SQL."""
    keys = key.split(",")

    def query(spark, sf_dir):
        return table(spark, sf_dir, source).select(*keys, *[c.alias(n) for n, c in made().items()])

    register(name, f"select {key}, {', '.join(f'{v} as {k}' for k, v in sql.items())} from {source}")(query)


def sub(value: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({value}, '{pattern}', '{to}', '{flags}')"


def norm(v: str) -> str:
    return f"replace(lower(coalesce({v}, '')), 'ё', 'е')"


def squeeze(v: str) -> str:
    return f"trim({sub(f'replace({v}, {NBSP}, chr(32))', r'[ \t\n\r\f\x0B]+', ' ')})"


def key(v: str) -> str:
    return squeeze(sub(f"translate({norm(v)}, '«»\"“”', '')", "[^0-9a-zа-я+#. -]+", " "))


def clean(v: str) -> str:
    out = squeeze(f"translate(coalesce({v}, ''), '–—«»', '--\"\"')")
    for _, pattern in fx.TOPIC_STRIPS:
        out = sub(out, pattern, "")
    return f"trim({out}, ' .;-')"


def _pattern(ways) -> str:
    both = lambda a, b: f"{a}.*{b}|{b}.*{a}"
    return "|".join(w[0] if len(w) == 1 else both(*w) for w in ways)


ACTIVITY_PATTERNS = [(name, _pattern(ways)) for name, *ways in fx.ACTIVITIES]

scalar("fn_normalize_text", "documents", "doc_id", lambda: {"h": F.md5(fx.normalize_text(F.col("text")))}, {"h": f"md5({norm('text')})"})
scalar("fn_normalize_query", "documents", "doc_id", lambda: {"h": F.md5(fx.normalize_query(F.col("text")))}, {"h": f"md5({squeeze(norm('text'))})"})
scalar("fn_normalize_search", "documents", "doc_id", lambda: {"h": F.md5(fx.normalize_search(F.col("text")))}, {"h": "md5(" + squeeze("translate(" + norm("text") + ", '«»\"“”''', '')") + ")"})
scalar("fn_normalize_key", "documents", "doc_id", lambda: {"h": F.md5(fx.normalize_key(F.col("text")))}, {"h": f"md5({key('text')})"})
scalar("fn_normalize_topic_py", "documents", "doc_id", lambda: {"h": F.md5(fx.normalize_topic(F.col("text")))}, {"h": f"md5(trim({key('text')}, ' .-'))"})
scalar("fn_clean_topic", "documents", "doc_id", lambda: {"h": F.md5(fx.clean_topic(F.col("text")))}, {"h": f"md5({clean('text')})"})
scalar("fn_strip_html", "pages", "page_id", lambda: {"h": F.md5(fx.strip_html(F.col("html")))}, {"h": "md5(" + squeeze("replace(" + sub("coalesce(html, '')", "<[^>]*>", " ") + ", '&nbsp;', ' ')") + ")"})
_decoded = "html"
for _name, _char in fx.ENTITIES:
    _decoded = f"replace({_decoded}, '{_name}', '{_char}')"
scalar("fn_decode_entities", "pages", "page_id", lambda: {"h": F.md5(fx.decode_entities(F.col("html")))}, {"h": f"md5({_decoded})"})
_flat = squeeze("coalesce(text, '')")
_first = f"regexp_extract({_flat}, '^(.{{30,220}}?[.!?])( |$)', 1)"
scalar("fn_first_sentence", "documents", "doc_id", lambda: {"sentence": fx.first_sentence(F.col("text"))}, {"sentence": f"case when {_first} <> '' then {_first} else left({_flat}, 220) end"})
scalar("fn_extract_number", "events", "event_id", lambda: {"n": fx.extract_number(F.col("props"))}, {"n": f"try_cast(nullif(regexp_extract({sub('props', r'[ \t]+', '')}, '[0-9]+', 0), '') as bigint)"})

_PRICE = lambda: F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 7 == 1, "Free of charge").when(F.col("p_partkey") % 7 == 2, F.concat(F.lit("1 "), F.col("p_size").cast("string"), F.lit("0,5 rub"))).otherwise(F.concat(F.lit("ab "), F.col("p_size").cast("string"), F.lit("0")))
_PRICE_SQL = "case when p_partkey % 7 = 0 then '' when p_partkey % 7 = 1 then 'Free of charge' when p_partkey % 7 = 2 then '1 ' || p_size || '0,5 rub' else 'ab ' || p_size || '0' end"
scalar(
    "fn_price_amount", "part", "p_partkey", lambda: {"price": fx.price_amount(_PRICE())},
    {"price": f"(case when {_PRICE_SQL} = '' then null when {norm(_PRICE_SQL)} like '%free%' then 0 else try_cast(nullif(regexp_extract({sub(f"translate({norm(_PRICE_SQL)}, ' ', '')", '^([^,]*),', r'\1.')}, '[0-9]+(\\.[0-9]+)?', 0), '') as decimal(18,4)) end)::decimal(18,4)"},
)
scalar("fn_format_price", "orders", "o_orderkey", lambda: {"label": fx.format_price(F.col("o_totalprice"))}, {"label": "replace(format('{:,}', round(o_totalprice::decimal(18,4), 0)::bigint), ',', ' ') || ' ₽'"})
scalar("fn_nullable_number", "customer", "c_custkey", lambda: {"n": fx.nullable_number(F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")))}, {"n": "try_cast(nullif(trim(case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then c_name else c_custkey::varchar end), '') as double)"})
scalar("fn_safe_float", "part", "p_partkey", lambda: {"n": fx.safe_float(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5"))))}, {"n": "coalesce(try_cast(replace(case when p_partkey % 3 = 0 then p_name else p_size || ',5' end, ',', '.') as decimal(18,4)), 0)::decimal(18,4)"})
scalar("fn_months_to_years", "part", "p_partkey", lambda: {"years": fx.months_to_years(F.col("p_size"))}, {"years": "floor((p_size + 6) / 12.0)::bigint"})
_BUCKET = "case when {0} between 3 and 4 then '3-4' when {0} between 5 and 6 then '5-6' when {0} between 7 and 9 then '7-9' when {0} between 10 and 12 then '10-12' when {0} between 13 and 18 then '13+' end"
scalar("fn_age_bucket", "part", "p_partkey", lambda: {"bucket": fx.age_bucket(F.col("p_size"))}, {"bucket": _BUCKET.format("p_size")})
_DAYNAME = "dayname(l_shipdate)"
_L = "l_orderkey,l_linenumber,l_partkey,l_suppkey"
scalar("fn_weekday", "lineitem", _L, lambda: {"day": fx.weekday(F.date_format("l_shipdate", "EEE"))}, {"day": f"lower({_DAYNAME})"})
scalar("fn_is_weekend", "lineitem", _L, lambda: {"weekend": fx.is_weekend(fx.weekday(F.date_format("l_shipdate", "EEE")))}, {"weekend": "isodow(l_shipdate) >= 6"})
scalar("fn_time_period", "events", "event_id", lambda: {"period": fx.time_period(F.date_format("ts", "HH:mm"))}, {"period": "case when hour(ts) < 12 then 'morning' when hour(ts) < 17 then 'day' else 'evening' end"})
scalar("fn_ru_plural", "part", "p_partkey", lambda: {"word": fx.ru_plural(F.col("p_partkey"), "тема", "темы", "тем")}, {"word": "case when p_partkey % 100 not between 11 and 14 and p_partkey % 10 = 1 then 'тема' when p_partkey % 100 not between 11 and 14 and p_partkey % 10 between 2 and 4 then 'темы' else 'тем' end"})
scalar("fn_age_label", "part", "p_partkey", lambda: {"label": fx.age_label(F.nullif(F.col("p_size") % 5, F.lit(0)), F.nullif(F.col("p_size") % 7, F.lit(0)))}, {"label": "case when p_size % 5 <> 0 and p_size % 7 <> 0 then (p_size % 5) || '-' || (p_size % 7) || ' лет' when p_size % 5 <> 0 then 'от ' || (p_size % 5) || ' лет' when p_size % 7 <> 0 then 'до ' || (p_size % 7) || ' лет' else '' end"})
scalar("fn_group_size_class", "part", "p_partkey", lambda: {"size_class": fx.group_size_class(F.col("p_size") % 20, F.col("p_size") % 20 + 4)}, {"size_class": "case when p_size % 20 + 2 <= 10 or p_size % 20 + 4 <= 10 then 'small' when p_size % 20 >= 15 or p_size % 20 + 2 >= 16 then 'large' else 'medium' end"})
_ACT = key("coalesce(source, '') || ' ' || coalesce(text, '')")
scalar("fn_activity_type", "documents", "doc_id", lambda: {"activity": fx.activity_type(F.col("source"), F.col("text"))}, {"activity": "case " + " ".join(f"when regexp_matches({_ACT}, '{p}') then '{n}'" for n, p in ACTIVITY_PATTERNS) + " else coalesce(nullif(source, ''), 'не определено') end"})
scalar("fn_url_program_id", "pages", "page_id", lambda: {"program_id": fx.url_program_id(F.col("url"))}, {"program_id": "try_cast(coalesce(nullif(regexp_extract(url, '[?&]id=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/program/([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1), '')) as bigint)"})
scalar("fn_url_links", "pages", "page_id", lambda: {"links": F.array_join(fx.url_links(F.concat(F.lit("see "), F.col("url"), F.lit(", and "), F.col("url"), F.lit("). http://x.test")), "example."), " ")}, {"links": "regexp_replace(url, '[.,;:!?)]+$', '')"})
scalar("fn_classifier_keys", "part", "p_partkey", lambda: {"keys": F.array_join(fx.classifier_keys(F.when(F.col("p_size") % 4 == 0, "unknown").otherwise(F.col("p_brand")), F.col("p_type")), "|")}, {"keys": "case when p_size % 4 = 0 then '' else 'code:' || p_brand || '|' end || 'name:' || lower(p_type)"})
scalar("fn_classifier_path", "part", "p_partkey", lambda: {"path": fx.classifier_path(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")))}, {"path": "case when p_size % 2 = 0 then p_type else p_type || ' / ' || p_name end"})
scalar("fn_taxonomy_path", "part", "p_partkey", lambda: {"path": fx.taxonomy_path(F.lit("content"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), F.col("p_name"))}, {"path": "'content > ' || case when p_size % 3 = 0 then '' else p_type || ' > ' end || p_name"})
scalar("fn_edu_form", "part", "p_partkey", lambda: {"form": fx.education_form((F.col("p_size") % 5).cast("string")), "label": fx.education_form_label(fx.education_form((F.col("p_size") % 5).cast("string")))}, {"form": "case when p_size % 5 in (1, 2, 3) then p_size % 5 end", "label": "case p_size % 5 when 1 then 'in person' when 2 then 'mixed' when 3 then 'remote' end"})
scalar("fn_md5_payload", "events", "event_id", lambda: {"h": F.md5(F.coalesce("props", F.lit("")))}, {"h": "md5(coalesce(props, ''))"})
scalar("fn_round_confidence", "part", "p_partkey", lambda: {"c": fx.round_confidence(F.col("p_size").cast("decimal(18,6)") / 40 - F.lit("0.1").cast("decimal(18,6)")).cast("decimal(18,3)")}, {"c": "round(least(greatest((p_size::decimal(18,6) / 40 - 0.1)::decimal(18,6), 0), 0.999)::decimal(18,6), 3)"})
scalar("fn_round_2", "lineitem", _L, lambda: {"r": fx.round_2(F.col("l_discount")).cast("decimal(18,2)")}, {"r": "round(l_discount::decimal(18,6), 2)"})
scalar("fn_truncate", "documents", "doc_id", lambda: {"head": F.left(F.col("text"), F.lit(80))}, {"head": "left(text, 80)"})
scalar("fn_base64_text", "documents", "doc_id", lambda: {"h": F.md5(F.translate(F.base64(F.encode(F.col("text"), "UTF-8")), "\r\n", "")), "same": F.decode(F.unbase64(F.base64(F.encode(F.col("text"), "UTF-8"))), "UTF-8") == F.col("text")}, {"h": "md5(base64(encode(text)))", "same": "text is not null"})
scalar("prj_case_map", "orders", "o_orderkey", lambda: {"rank": F.coalesce(F.create_map(*[F.lit(x) for i, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM"]) for x in (p, i)])[F.col("o_orderpriority")], F.lit(9))}, {"rank": "case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 9 end"})
scalar("prj_coalesce_default", "orders", "o_orderkey", lambda: {"open_price": F.coalesce(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")), F.lit(0.0)), "status": F.nullif("o_orderstatus", F.lit("P"))}, {"open_price": "coalesce(case when o_orderstatus = 'O' then o_totalprice end, 0)", "status": "nullif(o_orderstatus, 'P')"})
scalar("prj_json_object", "part", "p_partkey", lambda: {"payload": F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.struct(F.col("p_type").alias("name")).alias("direction")))}, {"payload": "json_object('id', p_partkey, 'name', p_name, 'direction', json_object('name', p_type))::varchar"})
scalar("jf_get", "events", "event_id", lambda: {"k": F.variant_get(F.parse_json("props"), "$.k", "bigint"), "k_text": F.get_json_object("props", "$.k")}, {"k": "(props::json->>'k')::bigint", "k_text": "props::json->>'k'"})
scalar("jf_placeholder", "events", "event_id", lambda: {"tag": F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("keyword:"), F.col("user_id").cast("string"))).otherwise(F.col("event_type")), "unresolved": F.col("user_id") % 3 == 0}, {"tag": "case when user_id % 3 = 0 then 'keyword:' || user_id else event_type end", "unresolved": "user_id % 3 = 0"})
scalar("flt_is_distinct", "part", "p_partkey", lambda: {"changed": ~F.nullif(F.col("p_size") % 3, F.lit(0)).eqNullSafe(F.nullif(F.col("p_size") % 2, F.lit(0)))}, {"changed": "nullif(p_size % 3, 0) is distinct from nullif(p_size % 2, 0)"})
