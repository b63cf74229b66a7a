"""Extraction and clustering queries; syllabus texts are made of the lines of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import calendars as calendar_tables
from lumicat.operators import cluster, extract, topic_clusters
from lumicat.operators.rules import Rule
from lumicat.plans.registry import register
from lumicat.session import checkpointed, table

_LINE = """case l_linenumber % 5 when 0 then 'Тема ' || l_linenumber || '. ' || p_name when 1 then l_linenumber || ' ' || p_name || ' ' || (p_size + 3) || ' ' || p_size || ' 3'
  when 2 then p_name || ' (' || p_size || ' ч)' when 3 then '1.' || l_linenumber || ' ' || upper(p_name) else p_name || ' ' || p_type end"""
_SYLLABUS = f"doc as (select l_orderkey as doc, l_linenumber * 1000000 + l_partkey as pos, {_LINE} as line from lineitem join part on l_partkey = p_partkey)"


def syllabus_lines(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, name, size = F.col("l_linenumber").cast("string"), F.col("p_name"), F.col("p_size").cast("string")
    kind = F.col("l_linenumber") % 5
    line = (
        F.when(kind == 0, F.concat(F.lit("Тема "), n, F.lit(". "), name))
        .when(kind == 1, F.concat_ws(" ", n, name, (F.col("p_size") + 3).cast("string"), size, F.lit("3")))
        .when(kind == 2, F.concat(name, F.lit(" ("), size, F.lit(" ч)")))
        .when(kind == 3, F.concat(F.lit("1."), n, F.lit(" "), F.upper(name)))
        .otherwise(F.concat_ws(" ", name, F.col("p_type")))
    )
    return joined.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("pos"), line.alias("line"))


@register("ext_normalize", "select doc_id, md5(regexp_replace(regexp_replace(text, '\\r\\n|\\r|\\f', chr(10), 'g'), '[ \\t]+', ' ', 'g')) as h from documents")
def ext_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(extract.normalize(F.col("text"))).alias("h"))


@register(
    "ext_logical_lines",
    """with l as (select conv_id * 1000 + turn as doc, unnest(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from conversations),
    t as (select doc, pos, trim(line) as line from l where trim(line) <> ''),
    m as (select *, lag(line) over (partition by doc order by pos) as before from t),
    g as (select *, sum(case when regexp_matches(line, '^[a-zа-яёéèçñ]') and length(line) > 3 and before is not null and not regexp_matches(before, '[.!?:;]$') then 0 else 1 end) over (partition by doc order by pos rows unbounded preceding) as grp from m)
    select doc, min(pos)::int as pos, md5(string_agg(line, ' ' order by pos)) as h from g group by doc, grp""",
)
def ext_logical_lines(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    return extract.logical_lines(talks).select("doc", "pos", F.md5("line").alias("h"))


_CLEAN = "trim(regexp_replace(regexp_replace({0}, ' *\\([0-9]+[^)]*\\)$', ''), '( +[0-9]+([.,][0-9]+)?){{1,3}}$', ''))"
_FOUND = " union all ".join(f"select doc, {i} as priority, pos, {_CLEAN.format(f"regexp_extract(line, '{p}', {g})")} as topic from doc where regexp_matches(line, '{p}')" for i, (p, g) in enumerate(extract.PATTERNS))
_TOPICS = f"""{_SYLLABUS}, found as ({_FOUND}),
  firsts as (select doc, arg_min(topic, priority * 100000000000 + pos) as topic, min(priority * 100000000000 + pos) as place from found where length(topic) between 3 and 180 and not regexp_matches(topic, '^[0-9 .,-]*$') group by doc, lower(topic)),
  topics as (select doc, row_number() over (partition by doc order by place) as ordinal, topic from firsts)"""


@register("ext_patterns", f"with {_TOPICS} select * from topics")
def ext_patterns(spark, sf_dir):
    return extract.topics(syllabus_lines(spark, sf_dir))


@register("ext_flatten", f"with {_TOPICS} select o_orderkey as doc, coalesce(n, 0)::bigint as topics, case when n is null then 'no topic rows' else '' end as warning from orders left join (select doc, count(*) as n from topics group by 1) on doc = o_orderkey")
def ext_flatten(spark, sf_dir):
    counts = extract.topics(syllabus_lines(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("doc"), "left")
    return joined.select(F.col("o_orderkey").alias("doc"), F.coalesce("n", F.lit(0)).alias("topics"), F.when(F.col("n").isNull(), "no topic rows").otherwise("").alias("warning"))


@register("ext_cleanup", "select p_partkey, case when p_size % 3 = 0 then null else p_name end as title from part")
def ext_cleanup(spark, sf_dir):
    """Titles with hours behind them, and header lines that are no topics."""
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Итого "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_name"), F.lit(" 2 1,5 0,5"))).otherwise(F.concat(F.col("p_name"), F.lit(" (12 часов)")))
    return table(spark, sf_dir, "part").select("p_partkey", extract.cleanup(raw).alias("title"))


_CALENDAR = "cal as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ordinal, p_name as topic, (l_linenumber + 1.5)::decimal(18,4) as total, l_linenumber::decimal(18,4) as theory, 1.5::decimal(18,4) as practice from lineitem join part on p_partkey = l_partkey)"


def calendars(spark, sf_dir):
    """One document per order: a header row, then a row per line with comma decimals."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber").cast("string")
    row = F.concat(F.lit("TABLE_ROW || "), n, F.lit(" || "), F.col("p_name"), F.lit(" || "), F.when(F.col("l_linenumber") % 2 == 0, F.concat((F.col("l_linenumber") + 1).cast("string"), F.lit(",5"))).otherwise("-"), F.lit(" || "), n, F.lit(" || 1,5"))
    lists = joined.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r")))).alias("rows"))
    return lists.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("STRUCTURED\nTABLE_ROW || № || Тема || Всего\n"), F.array_join(F.transform("rows", lambda r: r["r"]), "\n")).alias("text"))


@register("ext_calendar", f"with {_CALENDAR} select * from cal")
def ext_calendar(spark, sf_dir):
    return extract.table_rows(calendars(spark, sf_dir))


@register("ext_calendar_cells", f"with {_CALENDAR} select * from cal")
def ext_calendar_cells(spark, sf_dir):
    """The same calendars with a cell a line behind their header, and a row of totals."""
    cell = F.regexp_replace(F.regexp_replace("text", r" *\|\| *", "\n"), "TABLE_ROW\n", "")
    text = F.concat(F.lit("План\nТеория\nПрактика\n"), F.regexp_replace(cell, "STRUCTURED\n№\nТема\nВсего\n", ""), F.lit("\nИТОГО\n1\n2\n3\n"))
    # totals that are a dash are theory and practice together, as in the other layout
    rows = extract.cell_rows(calendars(spark, sf_dir).withColumn("text", text))
    return rows.withColumn("total", F.coalesce("total", (F.col("theory") + F.col("practice")).cast("decimal(18,4)")))


@register(
    "ext_calendar_choice",
    f"""with {_CALENDAR}, extra as (select doc, max(ordinal) + 1 as ordinal from cal where doc % 2 = 1 group by 1)
    select doc, ordinal, case when doc % 2 = 0 then 'Основа' end as section, topic, total, theory, practice from cal
    union all select doc, ordinal, null, 'Лишняя тема', 1, 1, 0 from extra""",
)
def ext_calendar_choice(spark, sf_dir):
    """Each order has its calendar as a table, with titles split over two rows, and as a plan of lines with a row more.

    Tables of even orders state a total that agrees with their rows, so they are chosen; of the others the plans.
    """
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, name = F.col("l_linenumber").cast("string"), F.col("p_name")
    total = F.concat((F.col("l_linenumber") + 1).cast("string"), F.lit(",5"))
    front, back = F.substring_index(name, " ", 1), F.expr("substring(p_name, length(substring_index(p_name, ' ', 1)) + 2)")
    halves = F.concat(F.lit("TABLE_ROW || "), n, F.lit(". || "), front, F.lit(" || || ||\nTABLE_ROW || || "), back, F.lit(" || "), n, F.lit(" || 1,5 || "), total)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", halves.alias("cells"), F.concat_ws(" ", n, name, total, n, F.lit("1,5 беседа")).alias("line"))
    lists = joined.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(row)).alias("rows"), (F.sum("l_linenumber") + 1.5 * F.count("*")).cast("decimal(18,1)").alias("sum"))
    of = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "\n")
    stated = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("\nTABLE_ROW || || Итого || || || "), F.col("sum").cast("string"))).otherwise("")
    text = F.concat(
        F.lit("Тема Всего Теория Практика\n"), of("line"), F.lit("\n99 Лишняя тема 1 1 -\nSTRUCTURED_DOCX_TABLE_BEGIN 1\nTABLE_ROW || № || Тема || Теория || Практика || Всего\nTABLE_ROW || || Раздел 1. Основа\n"),
        of("cells"), stated, F.lit("\nSTRUCTURED_DOCX_TABLE_END"),
    )
    return calendar_tables.calendar(lists.select("doc", text.alias("text")))


@register("ext_quality", f"with {_CALENDAR} select doc, count(*)::bigint as topics, true as passes, 0.82::decimal(4,2) as confidence from cal group by 1")
def ext_quality(spark, sf_dir):
    return extract.quality(extract.table_rows(calendars(spark, sf_dir)))


@register("ext_regress", f"with {_CALENDAR}, s as (select doc, count(*) as topics, sum(total) as hours from cal group by 1) select doc, case when doc % 5 = 0 and doc % 3 = 0 then 'topics,hours' when doc % 5 = 0 then 'topics' when doc % 3 = 0 then 'hours' else '' end as mismatches from s")
def ext_regress(spark, sf_dir):
    """Summaries against expected rows, of which some are wrong on purpose."""
    # both sides of the comparison read these sums, so texts are parsed once and the sums, a row per document, written
    rows = checkpointed(extract.table_rows(calendars(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("topics"), F.sum("total").alias("hours")))
    wanted = rows.select("doc", (F.col("topics") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0)).alias("topics"), (F.col("hours") + F.when(F.col("doc") % 3 == 0, 1).otherwise(0)).alias("hours"))
    return extract.regress(rows, wanted)


_TABLED = "replace(replace(replace(replace(html, '<p>', '<tr><td>'), '</p>', '</td></TR>'), '<li>', '<tr class=x><th>'), '</li>', '</th></tr>')"
_ROWS = rf"""list_filter(list_transform(regexp_extract_all({_TABLED}, '(?is)<tr\b[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<td\b[^>]*>(.*?)</td>', 1),
  lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0)"""


@register("src_html_tables", f"select page_id, len({_ROWS})::bigint as rows, md5(array_to_string(list_transform({_ROWS}, lambda r: array_to_string(r, '|')), '/')) as h from pages")
def src_html_tables(spark, sf_dir):
    """The test pages have no tables: their paragraphs become rows of cells, their menu entries rows without any."""
    html = F.col("html")
    for old, new in (("<p>", "<tr><td>"), ("</p>", "</td></TR>"), ("<li>", "<tr class=x><th>"), ("</li>", "</th></tr>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    cells = extract.html_cells(html)
    return table(spark, sf_dir, "pages").select("page_id", F.size(cells).cast("bigint").alias("rows"), F.md5(F.array_join(F.transform(cells, lambda r: F.array_join(r, "|")), "/")).alias("h"))


@register("src_doc_dispatch", "select page_id, case when regexp_extract(lower(url), '\\.([a-z0-9]+)$', 1) in ('txt','md','html','htm','json','csv') then 'text' end as route from pages")
def src_doc_dispatch(spark, sf_dir):
    from lumicat.sources import files

    return table(spark, sf_dir, "pages").select("page_id", files.route(F.col("url")).alias("route"))


# --- clustering; topics are part names

STOP = ["the", "and"]
_KEYED = "k as (select p_name as topic, count(*)::bigint as rows, count(distinct p_brand)::bigint as programs, sum(p_size)::bigint as hours from part group by 1)"


def _topics(spark, sf_dir):
    return cluster.aggregate(table(spark, sf_dir, "part").select(F.col("p_name").alias("topic"), F.col("p_brand").alias("program"), F.col("p_size").alias("hours")))


@register("clu_aggregate", f"with {_KEYED} select topic, rows, programs, hours, round(sqrt(rows) + sqrt(programs), 6) as weight from k")
def clu_aggregate(spark, sf_dir):
    return _topics(spark, sf_dir).select("topic", "rows", "programs", F.col("hours").cast("bigint").alias("hours"), F.round("weight", 6).alias("weight"))


_TOKENS = """w as (select topic, string_split(topic, ' ') as ws from k),
  tok as (select topic, 'word:' || unnest(ws) as token from w union all select topic, 'pair:' || ws[1] || ' ' || ws[2] from w
    union all select topic, 'char' || n || ':' || substr(x, i, n) from (select topic, unnest(ws) as x from w), range(3, 6) a(n), range(1, 30) b(i) where length(x) >= 4 and i <= length(x) - n + 1)"""


@register("clu_tokens", f"with {_KEYED}, {_TOKENS} select topic, token, count(*)::bigint as tf from tok group by 1, 2")
def clu_tokens(spark, sf_dir):
    return _topics(spark, sf_dir).select("topic", F.explode(cluster.tokens(F.col("topic"), STOP)).alias("token")).groupBy("topic", "token").agg(F.count("*").alias("tf"))


_TFIDF = f"""{_KEYED}, {_TOKENS}, c as (select topic, token, count(*) as tf from tok group by 1, 2),
  f as (select token, count(*) as df from c group by 1 having count(*) >= 2 order by 2 desc, 1 limit 4096),
  r as (select topic, token, (1 + ln(tf)) * (ln((1 + (select count(*) from k))::double / (1 + df)) + 1) as w from c join f using (token)),
  v as (select topic, token, w / sqrt(sum(w * w) over (partition by topic)) as value from r)"""


@register("clu_tfidf", f"with {_TFIDF} select topic, token, round(value, 6) as value from v")
def clu_tfidf(spark, sf_dir):
    return cluster.tfidf(_topics(spark, sf_dir), STOP).select("topic", "token", F.round("value", 6).alias("value"))


KEYWORDS = (Rule("metal", "Metal", "", ("bolt", "gear", "rod")), Rule("ring", "Ring", "", ("ring", "plate")), Rule("toys", "Toys", "", ("gizmo", "widget")))
_KEYWORD = "case when length(topic) < 3 or regexp_matches(topic, '^old ') then 'noise' when contains(topic, 'bolt') or contains(topic, 'gear') or contains(topic, 'rod') then 'metal' when contains(topic, 'ring') or contains(topic, 'plate') then 'ring' when contains(topic, 'gizmo') or contains(topic, 'widget') then 'toys' else 'other' end"


def _placed(spark, sf_dir):
    return _topics(spark, sf_dir).withColumn("cluster", cluster.keyword_cluster(F.col("topic"), KEYWORDS, "^old "))


@register("clu_keyword", f"with {_KEYED} select topic, {_KEYWORD} as cluster from k")
def clu_keyword(spark, sf_dir):
    return _placed(spark, sf_dir).select("topic", "cluster")


@register("clu_summary", f"with {_KEYED}, p as (select *, {_KEYWORD} as cluster, row_number() over (partition by {_KEYWORD} order by rows desc, topic) as rn from k) select cluster, count(*)::bigint as topics, sum(rows)::bigint as rows, sum(programs)::bigint as programs, sum(hours)::bigint as hours, string_agg(topic, '; ' order by rn) filter (where rn <= 3) as examples, row_number() over (order by sum(rows) desc, cluster) as number from p group by 1")
def clu_summary(spark, sf_dir):
    return cluster.summary(_placed(spark, sf_dir)).withColumn("hours", F.col("hours").cast("bigint"))


@register("agg_cluster_summary", f"with {_KEYED}, p as (select *, {_KEYWORD} as cluster from k) select cluster, sum(rows)::bigint as rows, row_number() over (order by sum(rows) desc, cluster) as number from p group by 1")
def agg_cluster_summary(spark, sf_dir):
    return cluster.summary(_placed(spark, sf_dir)).select("cluster", "rows", "number")


@register("clu_terms", f"with {_TFIDF}, p as (select topic, {_KEYWORD} as cluster from k), s as (select cluster, token, round(sum(value), 9) as s from v join p using (topic) where token not like 'char%' group by 1, 2), n as (select *, row_number() over (partition by cluster order by s desc, token) as rn from s) select cluster, string_agg(split_part(token, ':', 2), ',' order by rn) as terms from n where rn <= 12 group by 1")
def clu_terms(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    return cluster.cluster_terms(cluster.tfidf(topics, STOP), _placed(spark, sf_dir).select("topic", "cluster"))


@register("clu_name", f"with {_KEYED}, p as (select *, {_KEYWORD} as cluster from k) select cluster, case when cluster = 'metal' then 'Metal work' when cluster = 'toys' then 'Toys' else arg_min(topic, -rows * 1000 + (select count(*) from k b where b.topic < p.topic)) end as name from p group by 1")
def clu_name(spark, sf_dir):
    """A name by rule, else the topic with most rows."""
    best = _placed(spark, sf_dir).groupBy("cluster").agg(F.min(F.struct((-F.col("rows")).alias("m"), "topic"))["topic"].alias("topic"))
    return best.select("cluster", F.when(F.col("cluster") == "metal", "Metal work").when(F.col("cluster") == "toys", "Toys").otherwise(F.col("topic")).alias("name"))


@register("clu_kmeans")
def clu_kmeans(spark, sf_dir):
    """Weighted spherical k-means of the embeddings; tests check its invariants."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(1.0).alias("weight"))
    return cluster.kmeans(points, k=32, rounds=80).select("id", "cluster", F.round("similarity", 6).alias("similarity"), "settled")


@register("clu_kmeans_topics")
def clu_kmeans_topics(spark, sf_dir):
    """The same on the TF-IDF weights of topics, sparse throughout; ``tests/test_topic_clusters.py`` repeats it by brute force."""
    topics = _topics(spark, sf_dir)
    weights = cluster.tfidf(topics, STOP).select(F.col("topic").alias("id"), "token", "value")
    placed = topic_clusters.sparse_kmeans(weights, topics.select(F.col("topic").alias("id"), "weight"), k=8)
    return placed.select(F.col("id").alias("topic"), "cluster", F.round("similarity", 6).alias("similarity"), "settled")
