"""Aggregations, exports and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumicat.plans.registry import register
from lumicat.session import table


@register(
    "agg_topic_rollup",
    """with lines as (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
    keyed as (select lang, case when length(line) < 40 then 'short' else 'content' end as record_type, coalesce(nullif(lower(trim(line)), ''), 'unknown') as key, doc_id, pos, line, length(line) as chars from lines)
    select lang, record_type, md5(key) as key_hash, count(*)::bigint as topic_rows, count(distinct doc_id)::bigint as programs, min(pos)::bigint as first_order, sum(chars)::bigint as hours_total,
           sum(case when record_type = 'short' then chars else 0 end)::bigint as hours_control, md5(arg_min(line, doc_id * 1000000 + pos)) as name_hash
    from keyed group by lang, record_type, key""",
)
def agg_topic_rollup(spark, sf_dir):
    """Rows of a topic per direction and record type; the name is that of the first row."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select(
        "lang", "doc_id", "pos", "line", F.when(F.length("line") < 40, "short").otherwise("content").alias("record_type"), F.coalesce(F.nullif(F.lower(F.trim("line")), F.lit("")), F.lit("unknown")).alias("key")
    )
    rolled = keyed.groupBy("lang", "record_type", "key").agg(
        F.count("*").alias("topic_rows"),
        F.count_distinct("doc_id").alias("programs"),
        F.min("pos").cast("bigint").alias("first_order"),
        F.sum(F.length("line")).alias("hours_total"),
        F.sum(F.when(F.col("record_type") == "short", F.length("line")).otherwise(0)).alias("hours_control"),
        F.md5(F.min(F.struct("doc_id", "pos", "line"))["line"]).alias("name_hash"),
    )
    return rolled.withColumn("key_hash", F.md5("key")).drop("key")


@register(
    "agg_counter_topn",
    """with counted as (select lang, source, count(*)::bigint as n from documents group by 1, 2),
    placed as (select *, row_number() over (partition by lang order by n desc, source) as rn from counted)
    select lang, string_agg(source || ':' || n, ',' order by rn) as top from placed where rn <= 5 group by lang""",
)
def agg_counter_topn(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    placed = counted.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("rn <= 5")
    return placed.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"].cast("string"))), ",").alias("top"))


@register("agg_count_distinct_set", "select p_type, count(distinct p_brand)::bigint as brands, count(distinct p_name)::bigint as names from part group by 1")
def agg_count_distinct_set(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_name").alias("names"))


@register(
    "agg_category_summary",
    """select p_type, l_returnflag, count(*)::bigint as topics, count(distinct l_partkey)::bigint as programs, round(sum(l_quantity::decimal(18,6)), 2)::decimal(18,2) as hours
    from lineitem join part on l_partkey = p_partkey group by 1, 2""",
)
def agg_category_summary(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    out = joined.groupBy("p_type", "l_returnflag").agg(F.count("*").alias("topics"), F.count_distinct("l_partkey").alias("programs"), F.round(F.sum(F.col("l_quantity").cast("decimal(18,6)")), 2).cast("decimal(18,2)").alias("hours"))
    return out.orderBy(rank, F.desc("programs"), "p_type")


@register("agg_mode_first", "select p_brand, p_name from (select p_brand, p_name, row_number() over (partition by p_brand order by count(*) desc, min(p_partkey)) as rn from part group by 1, 2) where rn = 1")
def agg_mode_first(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return counted.groupBy("p_brand").agg(F.max(F.struct("n", (-F.col("first")).alias("minus_first"), "p_name"))["p_name"].alias("p_name"))


@register("agg_filter_count", "select p_type, count(*)::bigint as total, count(*) filter (where p_size > 40)::bigint as open_n, round(count(*)::decimal(18,6) / nullif(count(*) filter (where p_size > 40), 0), 2)::decimal(18,2) as ratio from part group by 1")
def agg_filter_count(spark, sf_dir):
    out = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 40).alias("open_n"))
    return out.withColumn("ratio", F.round(F.try_divide(F.col("total").cast("decimal(18,6)"), F.col("open_n").cast("decimal(18,6)")), 2).cast("decimal(18,2)"))


@register("agg_min_regex_numeric", "select l_suppkey, min(try_cast(nullif(regexp_replace(l_extendedprice::varchar, '[^0-9]', '', 'g'), '') as decimal(18,0))) as least from lineitem group by 1")
def agg_min_regex_numeric(spark, sf_dir):
    """Digits-only parse: decimal separators vanish, as in the published figures."""
    digits = F.nullif(F.regexp_replace(F.col("l_extendedprice").cast("string"), "[^0-9]", ""), F.lit(""))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(digits.try_cast("decimal(18,0)")).alias("least"))


@register(
    "agg_bucket_hist",
    """with b as (select case when p_retailprice is null then 'unknown' when p_retailprice = 0 then 'free' when p_retailprice < 950 then 'low' when p_retailprice < 1000 then 'mid' else 'high' end as segment from part)
    select s as segment, count(b.segment)::bigint as n from (values ('unknown'), ('free'), ('low'), ('mid'), ('high')) v(s) left join b on b.segment = s group by 1""",
)
def agg_bucket_hist(spark, sf_dir):
    price = F.col("p_retailprice")
    segment = F.when(price.isNull(), "unknown").when(price == 0, "free").when(price < 950, "low").when(price < 1000, "mid").otherwise("high")
    counts = table(spark, sf_dir, "part").groupBy(segment.alias("segment")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in ("unknown", "free", "low", "mid", "high")], "segment string")
    return names.join(counts, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))


@register("agg_group_count_join", "select n_name, count(c_custkey)::bigint as n from nation left join customer on n_nationkey = c_nationkey group by 1")
def agg_group_count_join(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@register("agg_string_ordered", "select p_brand, string_agg(distinct p_type, '; ' order by p_type) as types, string_agg(distinct p_name, '; ' order by p_name) filter (where p_size > 45) as large_names from part group by 1")
def agg_string_ordered(spark, sf_dir):
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(joined(F.col("p_type")).alias("types"), F.nullif(joined(F.when(F.col("p_size") > 45, F.col("p_name"))), F.lit("")).alias("large_names"))


@register("agg_json_ordered", "select r_regionkey, coalesce((select '[' || string_agg('{\"n_name\":\"' || n_name || '\"}', ',' order by n_name) || ']' from nation where n_regionkey = r_regionkey), '[]') as contacts, (select count(*) from nation where n_regionkey = r_regionkey)::bigint as n from region")
def agg_json_ordered(spark, sf_dir):
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name"))).alias("c"))
    joined = table(spark, sf_dir, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("r_regionkey", F.coalesce(F.to_json("c"), F.lit("[]")).alias("contacts"), F.coalesce(F.size("c"), F.lit(0)).cast("bigint").alias("n"))


@register("agg_minmax_text", "select p_brand, min(p_size::varchar) as low, max(p_size::varchar) as high from part group by 1")
def agg_minmax_text(spark, sf_dir):
    """Lexical, not numeric: sizes are compared as text."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.col("p_size").cast("string")).alias("low"), F.max(F.col("p_size").cast("string")).alias("high"))


@register("agg_count_cte", "with a as (select l_partkey, count(*)::bigint as topics from lineitem group by 1), b as (select l_partkey, count(*)::bigint as returned from lineitem where l_returnflag = 'R' group by 1) select a.l_partkey, topics, coalesce(returned, 0) as returned from a left join b on a.l_partkey = b.l_partkey")
def agg_count_cte(spark, sf_dir):
    """Both counts in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("topics"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@register("agg_scalar_subqueries", "select (select count(*) from part)::bigint as parts, (select count(*) from orders where o_orderstatus = 'O')::bigint as open_orders, (select count(*) from orders where o_orderstatus = 'P')::bigint as pending_orders, (select count(*) from customer)::bigint as customers, (select max(l_quantity) from lineitem) as most")
def agg_scalar_subqueries(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending_orders"))
    one = lambda n, total: t(n).agg(total).scalar()
    return orders.select(one("part", F.count("*")).alias("parts"), "open_orders", "pending_orders", one("customer", F.count("*")).alias("customers"), one("lineitem", F.max("l_quantity")).alias("most"))


@register("agg_dup_count", "select l_partkey, l_suppkey from (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by count(*) desc, l_suppkey) as rn from lineitem group by 1, 2) where rn = 1")
def agg_dup_count(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return counted.groupBy("l_partkey").agg((-F.max(F.struct("n", (-F.col("l_suppkey")).alias("m")))["m"]).alias("l_suppkey"))


@register(
    "agg_topic_profile",
    """with done as (select o_custkey, l_partkey, l_quantity::bigint as q, p_type from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey where o_orderstatus = 'F'),
    types as (select o_custkey, p_type, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, p_type) as rn from done group by 1, 2),
    tops as (select o_custkey, string_agg(p_type, ',' order by rn) as top_types from types where rn <= 3 group by 1)
    select c_custkey, count(distinct l_partkey)::bigint as topics, coalesce(sum(q), 0)::bigint as hours, coalesce(floor(sum(q)::double / nullif(count(q), 0)), 0)::bigint as average, coalesce(any_value(top_types), '') as top_types
    from customer left join done on c_custkey = done.o_custkey left join tops on c_custkey = tops.o_custkey group by c_custkey""",
)
def agg_topic_profile(spark, sf_dir):
    """Completed-programme profile per user: one aggregation by (user, type), then one by user."""
    t = lambda n: table(spark, sf_dir, n)
    done = t("orders").where("o_orderstatus = 'F'").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    # a part has one type, so distinct parts add up over types
    by_type = done.groupBy("o_custkey", "p_type").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    profile = by_type.groupBy("o_custkey").agg(
        F.sum("parts").alias("topics"), F.sum("q").alias("hours"), F.sum("n").alias("rows"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_type"))), 1, 3), lambda x: x["p_type"]), ",").alias("top_types"),
    )
    joined = t("customer").join(profile, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return joined.select("c_custkey", zero("topics").alias("topics"), zero("hours").alias("hours"), zero(F.floor(F.try_divide("hours", "rows"))).alias("average"), F.coalesce("top_types", F.lit("")).alias("top_types"))


@register("agg_range_intersect", "select p_brand, max(coalesce(nullif(p_size % 7, 0), 3))::bigint as low, min(coalesce(nullif(p_size % 19, 0), 18))::bigint as high, case when max(coalesce(nullif(p_size % 7, 0), 3)) <= min(coalesce(nullif(p_size % 19, 0), 18)) then true else false end as meets from part group by 1")
def agg_range_intersect(spark, sf_dir):
    low = F.max(F.coalesce(F.nullif(F.col("p_size") % 7, F.lit(0)), F.lit(3))).cast("bigint")
    high = F.min(F.coalesce(F.nullif(F.col("p_size") % 19, F.lit(0)), F.lit(18))).cast("bigint")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(low.alias("low"), high.alias("high")).withColumn("meets", F.col("low") <= F.col("high"))


@register("agg_topic_hours", "select l_orderkey, count(*)::bigint as topics, round(sum(l_quantity::decimal(18,6)), 2)::decimal(18,2) as total, round(sum(l_tax::decimal(18,6)), 2)::decimal(18,2) as theory, count(distinct l_returnflag)::bigint as sections from lineitem group by 1")
def agg_topic_hours(spark, sf_dir):
    total = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,6)")), 2).cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("topics"), total("l_quantity").alias("total"), total("l_tax").alias("theory"), F.count_distinct("l_returnflag").alias("sections"))


@register(
    "agg_accuracy",
    """with judged as (select d.lang, (case when n_chars >= 400 then 1 else 0 end) = quality as ok from documents d join labels l on d.doc_id = l.doc_id)
    select coalesce(lang, 'all') as label, count(*)::bigint as total, count(*) filter (where ok)::bigint as correct, round(count(*) filter (where ok)::decimal(18,6) / nullif(count(*), 0), 4)::decimal(18,4) as accuracy
    from judged group by grouping sets ((lang), ())""",
)
def agg_accuracy(spark, sf_dir):
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", ((F.col("n_chars") >= 400).cast("int") == F.col("quality")).alias("ok"))
    by = judged.rollup("lang").agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"))
    return by.select(F.coalesce("lang", F.lit("all")).alias("label"), "total", "correct", F.round(F.try_divide(F.col("correct").cast("decimal(18,6)"), F.col("total").cast("decimal(18,6)")), 4).cast("decimal(18,4)").alias("accuracy"))


@register("agg_status_counts", "select o_orderstatus as status, o_orderpriority as category, count(*)::bigint as n from orders group by 1, 2")
def agg_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))


@register("agg_group_places", "select l_partkey, sum(l_quantity::bigint) filter (where l_linestatus = 'O')::bigint as known, coalesce(sum(l_quantity::bigint) filter (where l_linestatus = 'O'), 0)::bigint as places from lineitem group by 1")
def agg_group_places(spark, sf_dir):
    nested = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_list(F.struct("l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))).alias("g"))
    places = F.filter("g", lambda x: (x["l_linestatus"] == "O") & (x["q"] > 0))
    total = F.aggregate(places, F.lit(0).cast("bigint"), lambda a, x: a + x["q"])
    return nested.select("l_partkey", F.when(F.size(places) > 0, total).alias("known"), total.alias("places"))


@register(
    "agg_confidence_mean",
    """select p_partkey, round(least(greatest(((p_size % 10) / 10.0 + 0.5)::decimal(18,6) / 2 - 0.12 * (p_size % 3) - 0.04 * (p_size % 2), 0), 0.999)::decimal(18,6), 3)::decimal(18,3) as confidence from part""",
)
def agg_confidence_mean(spark, sf_dir):
    """Mean of known confidences less penalties for missing fields and ambiguities."""
    known = F.array((F.col("p_size") % 10).cast("decimal(18,6)") / 10, F.lit(0.5).cast("decimal(18,6)"), F.lit(None).cast("decimal(18,6)"))
    kept = F.array_compact(known)
    mean = F.aggregate(kept, F.lit(0).cast("decimal(38,12)"), lambda a, x: (a + x).cast("decimal(38,12)")) / F.size(kept)
    value = mean - F.lit("0.12").cast("decimal(4,2)") * (F.col("p_size") % 3) - F.lit("0.04").cast("decimal(4,2)") * (F.col("p_size") % 2)
    clamped = F.least(F.greatest(value.cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")), F.lit("0.999").cast("decimal(18,6)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(clamped, 3).cast("decimal(18,3)").alias("confidence"))


# --- arrays, maps, JSON


@register("jf_array_elements", "select event_id, tag from (select event_id, unnest([event_type, 'user ' || user_id]) as tag from events)")
def jf_array_elements(spark, sf_dir):
    """Elements that are objects or plain strings, from JSON text."""
    payload = F.to_json(F.array(F.to_json(F.struct(F.col("event_type").alias("name"))), F.concat(F.lit("user "), F.col("user_id").cast("string"))))
    parts = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(payload, "array<string>")).alias("e"))
    return parts.select("event_id", F.coalesce(F.get_json_object("e", "$.name"), F.btrim("e", F.lit('"'))).alias("tag"))


@register("jf_array_field_ids", "select l_orderkey, sum(l_partkey)::bigint as total, count(*)::bigint as n from lineitem group by 1")
def jf_array_field_ids(spark, sf_dir):
    payloads = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("payload"))
    ids = F.from_json("payload", "array<bigint>")
    return payloads.select("l_orderkey", F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size(ids).cast("bigint").alias("n"))


@register("jf_build", """select o_custkey, '[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by o_orderkey) || ']' as orders from orders group by 1""")
def jf_build(spark, sf_dir):
    """Objects in an ordered JSON array per key."""
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("l"))
    return made.select("o_custkey", F.to_json("l").alias("orders"))


@register("jf_merge", "select user_id, max_by(event_type, event_id) as type, count(*)::bigint as n from events group by 1")
def jf_merge(spark, sf_dir):
    """Shallow merge of metadata in event order, the right side winning."""
    maps = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.struct("event_id", "event_type"))["event_type"].alias("type"))
    old, new = F.create_map(F.lit("type"), F.lit("none"), F.lit("n"), F.lit("0")), F.create_map(F.lit("type"), F.col("type"), F.lit("n"), F.col("n").cast("string"))
    left = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    merged = F.map_concat(left, new)
    return maps.select("user_id", merged["type"].alias("type"), merged["n"].cast("bigint").alias("n"))


@register("ar_map_entries", "select l_orderkey, lower(dayname(l_shipdate)) as day, count(*)::bigint as n from lineitem group by 1, 2")
def ar_map_entries(spark, sf_dir):
    day = F.create_map(*[F.lit(x) for x in ("Mon", "monday", "Tue", "tuesday", "Wed", "wednesday", "Thu", "thursday", "Fri", "friday", "Sat", "saturday", "Sun", "sunday")])[F.date_format("l_shipdate", "EEE")]
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", day.alias("day")).agg(F.count("*").alias("n"))
    schedule = counted.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("schedule"))
    return schedule.select("l_orderkey", F.explode("schedule").alias("day", "n"))


@register("ar_flatmap", "select l_orderkey, sum(l_quantity::bigint) filter (where l_quantity > 25)::bigint as large, bool_or(l_quantity > 45) as any_huge, bool_and(l_quantity > 5) as all_some from lineitem group by 1")
def ar_flatmap(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("bigint")).alias("q"))
    large = F.filter("q", lambda x: x > 25)
    total = F.aggregate(large, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return q.select("l_orderkey", F.when(F.size(large) > 0, total).alias("large"), F.exists("q", lambda x: x > 45).alias("any_huge"), F.forall("q", lambda x: x > 5).alias("all_some"))


@register("ar_slice", "select l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:3], '; ') as firsts from lineitem group by 1")
def ar_slice(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.array_distinct(F.collect_list("l_partkey"))).alias("p"))
    return parts.select("l_orderkey", F.array_join(F.slice("p", 1, 3).cast("array<string>"), "; ").alias("firsts"))


@register("ar_text_array_column", "select event_id, case when user_id % 2 = 0 then 1 else 0 end::bigint as n from events")
def ar_text_array_column(spark, sf_dir):
    """A scalar becomes an array of one, a missing value an empty array."""
    value = F.when(F.col("user_id") % 2 == 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.size(F.array_compact(F.array(value))).cast("bigint").alias("n"))


@register("ar_stable_stringify", "select event_id, '{\"k\":' || (props::json->>'k') || ',\"type\":\"' || event_type || '\"}' as j from events")
def ar_stable_stringify(spark, sf_dir):
    """Canonical JSON: keys sorted whatever their order was."""
    entries = F.array(F.struct(F.lit("type").alias("key"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value")), F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value")))
    body = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), body, F.lit("}")).alias("j"))


@register("fn_strip_json_keys", "select event_id, '{\"k\":' || (props::json->>'k') || '}' as j from events")
def fn_strip_json_keys(spark, sf_dir):
    """Volatile keys leave the payload before it is hashed or compared."""
    full = F.map_from_arrays(F.array(F.lit("k"), F.lit("distance"), F.lit("average_score")), F.array(F.get_json_object("props", "$.k").cast("bigint"), F.col("user_id"), F.lit(5).cast("bigint")))
    kept = F.map_filter(full, lambda k, v: ~k.isin("average_score", "distance", "program_reviews"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(kept).alias("j"))


@register("fn_earliest_hour", "select user_id, min(hour(ts))::bigint as earliest from events group by 1")
def fn_earliest_hour(spark, sf_dir):
    nested = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.date_format("ts", "HH:mm")).alias("times"))
    return nested.select("user_id", F.array_min(F.transform("times", lambda t: F.regexp_extract(t, "^([0-9]{1,2})", 1).cast("bigint"))).alias("earliest"))


@register("snk_copy_csv", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def snk_copy_csv(spark, sf_dir):
    """Writes a wide CSV with header to the shared folder and reads it again."""
    import uuid

    from lumicat.session import shared_folder
    from lumicat.sources import files

    part = table(spark, sf_dir, "part")
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    files.write_csv(part, path)
    return files.read_csv(spark, path, part.schema)
