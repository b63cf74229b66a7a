"""Filters, joins, sorts, windows and set operations.

Catalogue entities stand on the driver's tables: programmes are parts, enrolment
groups line items, organisations suppliers, municipalities nations. Nothing is
broadcast by hint: adaptive execution broadcasts what its size allows, and large
keys stay splittable sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumicat.functions import text as fx
from lumicat.operators import dictionary
from lumicat.plans.registry import register
from lumicat.session import table

L_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# --- filters


@register("flt_eq_optional", "select s_suppkey, s_nationkey from supplier where s_nationkey = 7 union all select s_suppkey, s_nationkey from supplier")
def flt_eq_optional(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    some = lambda nation: supplier.where(F.col("s_nationkey") == nation) if nation else supplier
    return some(7).unionByName(some(None))


@register("flt_in_list", "select p_partkey, p_name from part where p_partkey in (1, 5, 9, 20)")
def flt_in_list(spark, sf_dir):
    wanted = [int(x) for x in dict.fromkeys([1, 5, "9", 5, 20])]
    return table(spark, sf_dir, "part").where(F.col("p_partkey").isin(wanted)).select("p_partkey", "p_name")


@register("flt_not_in", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 50)")
def flt_not_in(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@register("flt_range_overlap", "select p_partkey from part where (nullif(p_size % 5, 0) is null or p_size % 5 <= 3) and (nullif(p_size % 7, 0) is null or p_size % 7 >= 2)")
def flt_range_overlap(spark, sf_dir):
    low, high = F.nullif(F.col("p_size") % 5, F.lit(0)), F.nullif(F.col("p_size") % 7, F.lit(0))
    return table(spark, sf_dir, "part").where((low.isNull() | (low <= 3)) & (high.isNull() | (high >= 2))).select("p_partkey")


@register("flt_keyset", "select o_orderkey, o_custkey from orders where o_orderkey > 500")
def flt_keyset(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 500").select("o_orderkey", "o_custkey")


@register("flt_null_document", "select doc_id from documents where text is not null and source is not null")
def flt_null_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null and source is not null").select("doc_id")


@register("flt_scope", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_type = 'PROMO')")
def flt_scope(spark, sf_dir):
    scope = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(*L_KEYS).join(scope, "l_partkey", "left_semi").select(*L_KEYS)


@register("flt_like_prefix", "select p_partkey, p_name from part where p_name like 'red %'")
def flt_like_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").startswith("red ")).select("p_partkey", "p_name")


# --- joins


@register(
    "prj_denorm_program",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_type, s_name, n_name, r_name
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
)
def prj_denorm_program(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(*L_KEYS, "p_name", "p_type", "s_name", "n_name", "r_name")
    )


@register("join_inner_equi", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def join_inner_equi(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@register("join_left_dims", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20 left join region on n_regionkey = r_regionkey")
def join_left_dims(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("customer").join(t("nation").where("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("groups_count"), F.sum(F.col("l_quantity").cast("bigint")).alias("total_places"), F.count_if(F.col("l_linestatus") == "O").alias("open_groups"),
        F.min(F.col("l_extendedprice").cast("string")).alias("min_price_text"), F.max(F.col("l_extendedprice").cast("string")).alias("max_price_text"),
    )


_GROUPS_SQL = "select l_partkey, count(*)::bigint as groups_count, sum(l_quantity::bigint)::bigint as total_places, count(*) filter (where l_linestatus = 'O')::bigint as open_groups from lineitem group by l_partkey"


@register(
    "join_left_star_wide",
    f"""with g as ({_GROUPS_SQL}),
    s as (select l_partkey, string_agg(distinct s_name, '; ' order by s_name) as orgs from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey)
    select p_partkey, p_name, p_brand, p_type, p_size, coalesce(groups_count, 0) as groups_count, coalesce(total_places, 0) as total_places, coalesce(open_groups, 0) as open_groups, coalesce(orgs, '') as orgs
    from part left join g on g.l_partkey = p_partkey left join s on s.l_partkey = p_partkey""",
)
def join_left_star_wide(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    orgs = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set("s_name")), "; ").alias("orgs"))
    wide = table(spark, sf_dir, "part").join(_groups(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey").join(orgs, F.col("p_partkey") == F.col("l_partkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wide.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", zero("groups_count"), zero("total_places"), zero("open_groups"), F.coalesce("orgs", F.lit("")).alias("orgs"))


@register("join_left_on_json_key", "select event_id, n_name from events left join nation on (props::json->>'k')::int = n_nationkey")
def join_left_on_json_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    return events.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"), "left").select("event_id", "n_name")


@register("join_lateral_agg", "select o_orderkey, (select string_agg(p_name, ',' order by p_name, l_linenumber) from lineitem join part on p_partkey = l_partkey where l_orderkey = o_orderkey and l_returnflag = 'R') as names from orders")
def join_lateral_agg(spark, sf_dir):
    named = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = named.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("p_name")), ",").alias("names"))
    return table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "names")


@register("join_lateral_unnest", "select doc_id, (select string_agg(w, ',' order by w) from (select unnest(string_split(source || '-' || lang, '-')) as w)) as parts from documents")
def join_lateral_unnest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(F.split(F.concat_ws("-", "source", "lang"), "-")), ",").alias("parts"))


@register("join_bridge_nm", "select o_orderkey, string_agg(distinct p_name, '; ' order by p_name) as names from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by o_orderkey")
def join_bridge_nm(spark, sf_dir):
    bridge = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = bridge.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("p_name")), "; ").alias("names"))
    return table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "names")


@register(
    "join_one_to_many_nested",
    """select c_custkey, coalesce((select string_agg(o_orderkey || ':' || lines, '|' order by o_orderkey) from (
         select o_custkey, o_orderkey, string_agg(l_linenumber || '@' || lower(dayname(l_shipdate)), ',' order by l_linenumber, l_shipdate) as lines
         from orders join lineitem on o_orderkey = l_orderkey group by 1, 2) x where x.o_custkey = c_custkey), '') as nested from customer""",
)
def join_one_to_many_nested(spark, sf_dir):
    """Orders with their lines as nested arrays, then one text per customer to compare."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_shipdate"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "lines"))).alias("groups"))
    entry = lambda e: F.concat(e["l_linenumber"].cast("string"), F.lit("@"), fx.weekday(F.date_format(e["l_shipdate"], "EEE")))
    shown = F.array_join(F.transform("groups", lambda g: F.concat(g["o_orderkey"].cast("string"), F.lit(":"), F.array_join(F.transform(g["lines"], entry), ","))), "|")
    return table(spark, sf_dir, "customer").join(nested, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(shown, F.lit("")).alias("nested"))


_FANOUT = "select o_custkey, count(*)::bigint as groups_count, sum(o_total)::bigint as places from (select o_custkey, o_orderkey, floor(o_totalprice)::bigint as o_total from orders) {} group by o_custkey"


@register("join_fanout_agg", _FANOUT.format("left join lineitem on l_orderkey = o_orderkey"))
def join_fanout_agg(spark, sf_dir):
    """Literal form: groups are counted once per schedule entry."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(F.count("*").alias("groups_count"), F.sum(F.floor("o_totalprice")).alias("places"))


@register("join_fanout_agg_corrected", _FANOUT.format(""))
def join_fanout_agg_corrected(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("groups_count"), F.sum(F.floor("o_totalprice")).alias("places"))


@register("join_composite_key", "select a.l_orderkey, a.l_linenumber, count(*)::bigint as n from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey group by 1, 2")
def join_composite_key(spark, sf_dir):
    """Pairs per composite key, from counts: no pair is built."""
    lines = table(spark, sf_dir, "lineitem")
    sizes = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("size"))
    return lines.join(sizes, ["l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.sum("size").alias("n"))


@register("join_natural_text", "select p_partkey, c_custkey from part join customer on lower(p_type) = lower(c_mktsegment) or p_name = c_name")
def join_natural_text(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    by_type = part.join(customer, F.lower("p_type") == F.lower("c_mktsegment")).select("p_partkey", "c_custkey")
    by_name = part.join(customer, F.col("p_name") == F.col("c_name")).select("p_partkey", "c_custkey")
    return by_type.unionByName(by_name)


@register("join_values_table", "select p_partkey, label from part left join (values ('PROMO', 'Promoted'), ('SMALL', 'Compact'), ('LARGE', 'Bulky')) v(code, label) on p_type = code")
def join_values_table(spark, sf_dir):
    labels = spark.createDataFrame([("PROMO", "Promoted"), ("SMALL", "Compact"), ("LARGE", "Bulky")], "code string, label string")
    return table(spark, sf_dir, "part").join(labels, F.col("p_type") == F.col("code"), "left").select("p_partkey", "label")


@register("join_anti_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def join_anti_not_exists(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(pending, "c_custkey", "left_anti")


@register("join_anti_probe", "select distinct (props::json->>'k')::bigint as missing from events where (props::json->>'k')::bigint not in (select n_nationkey from nation)")
def join_anti_probe(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("missing")).distinct()
    return asked.join(table(spark, sf_dir, "nation"), F.col("missing") == F.col("n_nationkey"), "left_anti")


@register("join_semi_subquery", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def join_semi_subquery(spark, sf_dir):
    """DELETE ... WHERE key IN (subquery), as the rows that stay."""
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(*L_KEYS).join(gone, "l_orderkey", "left_anti").select(*L_KEYS)


@register("join_update_from", "select o_orderkey, coalesce(n, 0)::bigint as lines, case when coalesce(n, 0) > 0 then 'ready' else o_orderstatus end as status from orders left join (select l_orderkey, count(*) as n from lineitem where l_tax > 0.04 group by 1) on l_orderkey = o_orderkey")
def join_update_from(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").where("l_tax > 0.04").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", n.alias("lines"), F.when(n > 0, "ready").otherwise(F.col("o_orderstatus")).alias("status"))


@register("join_lookup_map", "select doc_id, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def join_lookup_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@register(
    "join_full_diff",
    """select coalesce(a.k, b.k) as k, case when a.k is null then 'extra' when b.k is null then 'missing' when a.v is distinct from b.v then 'changed' else 'same' end as change
    from (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 3 <> 0) a
    full join (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as v from orders where o_orderkey % 4 <> 0) b on a.k = b.k""",
)
def join_full_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v")).alias("a")
    b = orders.where("o_orderkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v")).alias("b")
    change = F.when(F.col("a.o_orderkey").isNull(), "extra").when(F.col("b.o_orderkey").isNull(), "missing").when(~F.col("a.v").eqNullSafe(F.col("b.v")), "changed").otherwise("same")
    return a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey"), "full_outer").select(F.coalesce("a.o_orderkey", "b.o_orderkey").alias("k"), change.alias("change"))


_TERM_SQL = "terms as (select distinct substr(w, 2, 3) as term from (select unnest(string_split(p_name, ' ')) as w from part) where length(w) >= 3)"


@register("join_theta_contains", f"with {_TERM_SQL} select p_partkey, string_agg(term, ',' order by term) as terms from part join terms on contains(p_name, term) group by p_partkey")
def join_theta_contains(spark, sf_dir):
    """Terms of a table (pieces of words) in the names of another."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    terms = part.select(F.explode(F.split("p_name", " ")).alias("w")).where(F.length("w") >= 3).select(F.substring("w", 2, 3).alias("term"))
    topics = part.select("p_name").distinct()
    found = dictionary.containing(topics, terms, "p_name", "p_name").groupBy("p_name").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))
    return part.join(found, "p_name").select("p_partkey", "terms")


_WORD_SQL = "terms as (select distinct lower(w) as term from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from benchmark))"


@register("join_dictionary", f"with {_WORD_SQL} select term, count(*)::bigint as n_docs, min(doc_id) as first_doc, max(doc_id) as last_doc from documents join terms on contains(lower(text), term) group by 1")
def join_dictionary(spark, sf_dir):
    """Every word of the benchmark items, anywhere in every document."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("w")).select(F.lower("w").alias("term"))
    # rows count, also those without an id and those that repeat one
    docs = table(spark, sf_dir, "documents").select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc"), F.lower("text").alias("text"))
    return dictionary.containing(docs, terms, "doc").groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc.doc_id").alias("first_doc"), F.max("doc.doc_id").alias("last_doc"))


_ASKED = "case c_custkey % 5 when 0 then p_name when 1 then 'a ' || p_name || ' (used)' when 2 then substr(p_name, 3, 5) when 3 then substr(p_name, 2) || c_mktsegment else c_name end"


@register(
    "join_fuzzy_name",
    f"""with names as (select distinct p_name as name from part), asked as (select distinct {_ASKED} as asked from customer join part on p_partkey = c_custkey)
      select asked, name from (
      select asked, name, row_number() over (partition by asked order by case when name = asked then 0 when contains(name, asked) then 1 else 2 end, name) as rn
      from asked join names on contains(name, asked) or contains(asked, name)) where rn = 1""",
)
def join_fuzzy_name(spark, sf_dir):
    """The names of parts that customers ask for: exact, then name holds request, then request holds name."""
    parts = table(spark, sf_dir, "part")
    asked = table(spark, sf_dir, "customer").join(parts, F.col("c_custkey") == F.col("p_partkey")).select(F.expr(_ASKED).alias("asked"))
    return dictionary.best_names(asked, parts.select(F.col("p_name").alias("name")))


# --- windows, sorts, limits


@register("win_row_number_global", "select p_brand, n, row_number() over (order by n desc, p_brand) as place from (select p_brand, count(*)::bigint as n from part group by 1)")
def win_row_number_global(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    # brands are few: the unpartitioned window sees one row for each
    return brands.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")).cast("bigint"))


@register("win_first_per_key", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as rn from lineitem) where rn = 1")
def win_first_per_key(spark, sf_dir):
    """First row per key by a partial aggregate instead of a sort of whole groups."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("f"))
    return first.select("l_partkey", "f.l_orderkey", "f.l_linenumber")


@register("win_topn_per_key", "select o_custkey, o_orderkey, rn from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3")
def win_topn_per_key(spark, sf_dir):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(by).cast("bigint")).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@register("win_best_of_array", "select l_orderkey, l_linenumber as best from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) as rn from lineitem) where rn = 1")
def win_best_of_array(spark, sf_dir):
    """The best element of a list that is never gathered: a maximum in parts."""
    best = F.max(F.struct("l_quantity", (-F.col("l_linenumber")).alias("n"), (-F.col("l_partkey")).alias("p")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((-best["n"]).alias("best"))


@register("win_topic_order", "select doc_id, ordinal::int as ordinal, md5(line) as h from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as ordinal from documents)")
def win_topic_order(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("ordinal"), F.md5("line").alias("h"))


@register("win_gap_top2", "select l_orderkey, (q[1] - coalesce(q[2], 0))::bigint as gap from (select l_orderkey, list(l_quantity order by l_quantity desc) as q from lineitem group by 1)")
def win_gap_top2(spark, sf_dir):
    """Two rows a key are kept, by Spark's group limit already before the shuffle."""
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))
    top = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.row_number().over(by).alias("rn")).where("rn <= 2")
    at = lambda n: F.max(F.when(F.col("rn") == n, F.col("l_quantity")))
    return top.groupBy("l_orderkey").agg((at(1) - F.coalesce(at(2), F.lit(0))).cast("bigint").alias("gap"))


@register("srt_multi", "select o_orderkey, o_orderpriority, o_custkey from orders order by o_orderpriority, o_custkey desc, o_orderkey")
def srt_multi(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderpriority", F.desc("o_custkey"), "o_orderkey").select("o_orderkey", "o_orderpriority", "o_custkey")


@register("srt_stable_score", "select p_partkey, p_size from part order by p_size desc, p_partkey")
def srt_stable_score(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").select("p_partkey", "p_size")


@register("srt_nulls_last", "select p_partkey, nullif(p_size % 4, 0) as k from part order by k nulls last, p_partkey")
def srt_nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 4, F.lit(0)).alias("k")).orderBy(F.asc_nulls_last("k"), "p_partkey")


@register("srt_array_position", "select p_partkey, list_position([9, 3, 7, 1], p_partkey)::bigint as place from part where p_partkey in (9, 3, 7, 1)")
def srt_array_position(spark, sf_dir):
    ids = [9, 3, 7, 1]
    return table(spark, sf_dir, "part").where(F.col("p_partkey").isin(ids)).select("p_partkey", F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("p_partkey")).alias("place")).orderBy("place")


@register("srt_collation_ru")
def srt_collation_ru(spark, sf_dir):
    """Order by Russian collation, for which DuckDB has no like; tests compare it."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return names.orderBy(F.collate("p_name", "ru")).select("p_name", "n")


@register("lim_topk_prefetch", "select p_partkey, p_name, p_size from part order by p_size desc, p_partkey limit 4")
def lim_topk_prefetch(spark, sf_dir):
    """Rank on narrow columns, join the details of the few that are left, rank again."""
    part = table(spark, sf_dir, "part")
    few = part.select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(12)
    return part.select("p_partkey", "p_name").join(few, "p_partkey").orderBy(F.desc("p_size"), "p_partkey").limit(4).select("p_partkey", "p_name", "p_size")


@register("lim_topk_deep", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
def lim_topk_deep(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


# --- set operations


@register("set_union_all", "select 'low' as segment, count(*)::bigint as n from part where p_size < 10 union all select 'mid', count(*) from part where p_size between 10 and 30 union all select 'high', count(*) from part where p_size > 30")
def set_union_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    branch = lambda name, test: part.where(test).agg(F.count("*").alias("n")).select(F.lit(name).alias("segment"), "n")
    return branch("low", "p_size < 10").unionByName(branch("mid", "p_size between 10 and 30")).unionByName(branch("high", "p_size > 30"))


@register("set_distinct", "select distinct p_brand, p_type from part")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@register("set_unique_by", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_size, p_partkey) as rn from part) where rn = 1")
def set_unique_by(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.struct("p_size", "p_partkey"))["p_partkey"].alias("p_partkey"))


@register("set_difference", "select p_partkey from part except select l_partkey from lineitem where l_discount > 0.09")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select("l_partkey"))


@register("set_intersects", "select o_orderkey, count(*) filter (where l_partkey % 10 = 3) > 0 as hit from orders join lineitem on o_orderkey = l_orderkey group by 1")
def set_intersects(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_partkey") % 10 == 3).alias("hit"))
    return table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "hit")


_OLD, _NEW = "o_orderkey % 4 <> 0", "o_orderkey % 3 = 0"


@register("set_conflict_ignore", f"select o_orderkey, o_orderstatus as status from orders where {_OLD} union all select o_orderkey, 'new' from orders where {_NEW} and not {_OLD}")
def set_conflict_ignore(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.where(_OLD).select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = orders.where(_NEW).select("o_orderkey", F.lit("new").alias("status")).dropDuplicates(["o_orderkey"])
    return old.unionByName(new.join(old, "o_orderkey", "left_anti"))


@register("set_upsert", f"select o_orderkey, 'new' as status from orders where {_NEW} union all select o_orderkey, o_orderstatus from orders where {_OLD} and not {_NEW}")
def set_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.where(_OLD).select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = orders.where(_NEW).select("o_orderkey", F.lit("new").alias("status"))
    return new.unionByName(old.join(new, "o_orderkey", "left_anti"))
