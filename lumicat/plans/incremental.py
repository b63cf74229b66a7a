"""Synchronisation and incremental queries: orders as two catalogue versions, events as updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumicat.operators import run_ledger, sync
from lumicat.plans.registry import register
from lumicat.session import shared_folder, table, without_folder
from lumicat.sources import versions
from lumicat.streaming import session_state, sessions

_STATE = "o_orderkey % 10 <> 0"
_CURRENT = "o_orderkey % 7 <> 0"
_HASH = "md5('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || %s || '\"}')"
_NEW_STATUS = "case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end"
_SYNCED = f"""state as (select o_orderkey as id, {_HASH % 'o_orderstatus'} as hash, 'ready' as status from orders where {_STATE}),
    cur as (select o_orderkey as id, {_HASH % _NEW_STATUS} as hash from orders where {_CURRENT}),
    synced as (select coalesce(s.id, c.id) as id, coalesce(c.hash, s.hash) as hash, case when s.id is null then 'pending' when c.id is not null and s.hash is distinct from c.hash then 'pending' else s.status end as status,
      case when c.id is null then 'missing' else 'active' end as catalog_status from state s full join cur c on s.id = c.id)"""


def _versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    state = orders.where(_STATE).select(F.col("o_orderkey").alias("id"), sync.payload_hash("o_custkey", "o_orderstatus").alias("hash"), F.lit("ready").alias("status"))
    changed = orders.where(_CURRENT).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return state, changed.select(F.col("o_orderkey").alias("id"), sync.payload_hash("o_custkey", "o_orderstatus").alias("hash"))


@register("inc_catalog_sync", f"with {_SYNCED} select * from synced")
def inc_catalog_sync(spark, sf_dir):
    return sync.catalog_sync(*_versions(spark, sf_dir))


@register("inc_nightly", f"with {_SYNCED} select catalog_status, status, count(*)::bigint as n from synced group by 1, 2")
def inc_nightly(spark, sf_dir):
    """The counters of a nightly run."""
    return sync.catalog_sync(*_versions(spark, sf_dir)).groupBy("catalog_status", "status").agg(F.count("*").alias("n"))


def _nightly_steps(spark, sf_dir, current):
    """Orders of a catalogue -> what their lines are worth -> customers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr("cast(round(l_extendedprice * 100) as long)").alias("cents"))

    def worth(now, dirty):
        wanted = now("catalogue").join(dirty, "id")
        sums = lines.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
        return wanted.join(sums, "id", "left").select("id", "customer", F.when(F.col("status") == "X", 0).otherwise(F.coalesce("cents", F.lit(0))).cast("long").alias("cents"), F.coalesce("n", F.lit(0)).alias("n"))

    def customers(now, dirty):
        return now("worth").join(dirty, "customer", "left_semi").groupBy("customer").agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"), F.sum("n").alias("lines"))

    return [
        run_ledger.Step("catalogue", "id long, customer long, status string", ("id",), lambda now, dirty: current),
        run_ledger.Step("worth", "id long, customer long, cents long, n long", ("id",), worth, ("catalogue",), lambda now, changed: changed("catalogue").select("id")),
        run_ledger.Step("customers", "customer long, orders long, cents long, lines long", ("customer",), customers, ("worth",), lambda now, changed: changed("worth").select("customer")),
    ]


@register(
    "inc_nightly_run",
    f"""with l as (select l_orderkey, sum(round(l_extendedprice * 100)::bigint) as cents, count(*) as n from lineitem group by 1)
      select o_custkey as customer, count(*)::bigint as orders, sum(case when {_NEW_STATUS} = 'X' then 0 else coalesce(cents, 0) end)::bigint as cents, sum(coalesce(n, 0))::bigint as lines
      from orders left join l on l_orderkey = o_orderkey where {_CURRENT} group by 1""",
)
def inc_nightly_run(spark, sf_dir):
    """Two nights over two versions of the catalogue; the second works on what changed, and equals a rebuild."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    nights = [orders.where(_STATE), orders.where(_CURRENT).withColumn("status", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("status")))]
    base = f"{shared_folder(spark)}/nightly-{uuid.uuid4().hex}"
    for current in nights:
        steps = _nightly_steps(spark, sf_dir, current.drop("o_orderkey"))
        number = run_ledger.run_steps(spark, base, steps)
    return without_folder(run_ledger.rows_of(spark, base, steps[-1], number), base)


@register("inc_program_upsert", f"with state as (select o_orderkey as id, o_orderstatus as status from orders where {_STATE}) select id, case when id = 11 then 'Z' else status end as status from state union all select 100000000, 'Z'")
def inc_program_upsert(spark, sf_dir):
    state = table(spark, sf_dir, "orders").where(_STATE).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = spark.createDataFrame([(11, "Z"), (100000000, "Z")], "id long, status string")
    return new.unionByName(state.join(new, "id", "left_anti"))


@register("inc_error_state", f"with {_SYNCED}, err as (select event_id as id, event_type as message from events where event_type = 'error') select coalesce(s.id, e.id) as id, case when e.id is not null then 'error' else s.status end as status, case when s.id is null then 'missing' else catalog_status end as catalog_status, left(message, 1000) as error from synced s full join err e on s.id = e.id")
def inc_error_state(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("event_type").alias("message"))
    return sync.error_state(inc_catalog_sync(spark, sf_dir), errors)


@register(
    "inc_status_derive",
    """with t as (select l_orderkey, count(*) as topics, count(*) filter (where l_returnflag = 'R') as aggs from lineitem group by 1)
    select o_orderkey, case when o_orderstatus = 'P' then 'missing' when o_custkey % 13 = 0 then 'error' when o_custkey % 3 = 0 then 'ready' else 'pending' end as document,
      case when coalesce(topics, 0) > 0 and coalesce(aggs, 0) > 0 then 'ready' when o_custkey % 13 = 0 then 'error' when coalesce(topics, 0) > 0 then 'extracted' else 'pending' end as topics from orders left join t on l_orderkey = o_orderkey""",
)
def inc_status_derive(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("topics"), F.count_if(F.col("l_returnflag") == "R").alias("aggs"))
    url = F.when(F.col("o_orderstatus") != "P", "u")
    error, path = F.when(F.col("o_custkey") % 13 == 0, "e"), F.when(F.col("o_custkey") % 3 == 0, "p")
    joined = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", sync.document_status(url, error, path).alias("document"), sync.topics_status(F.col("topics"), F.col("aggs"), error).alias("topics"))


@register("inc_run_audit", f"with {_SYNCED} select 'finished' as status, count(*)::bigint as total, count(*) filter (where status = 'pending')::bigint as pending, count(*) filter (where catalog_status = 'missing')::bigint as missing from synced")
def inc_run_audit(spark, sf_dir):
    out = inc_catalog_sync(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("catalog_status") == "missing").alias("missing"))
    return out.select(F.lit("finished").alias("status"), "total", "pending", "missing")


@register("inc_on_demand", f"select distinct user_id as wanted from events where user_id not in (select o_orderkey from orders where {_STATE})")
def inc_on_demand(spark, sf_dir):
    """Ids asked for that the mirror lacks."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("wanted")).distinct()
    return asked.join(table(spark, sf_dir, "orders").where(_STATE), F.col("wanted") == F.col("o_orderkey"), "left_anti")


@register("inc_scoped_rebuild", "select l_partkey, case when l_partkey % 4 = 0 then count(*) * 10 else count(*) end::bigint as n from lineitem group by 1")
def inc_scoped_rebuild(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    scope = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return sync.replace_scope(old, old.withColumn("n", F.col("n") * 10), scope, "l_partkey")


@register("inc_replace_partition", "select l_suppkey, l_returnflag, case when l_suppkey = 7 then 0 else count(*) end::bigint as n from lineitem group by 1, 2")
def inc_replace_partition(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return sync.replace_scope(old, old.withColumn("n", F.lit(0).cast("bigint")), old.where("l_suppkey = 7"), "l_suppkey")


@register(
    "inc_partition_swap",
    """with g as (select l_returnflag as flag, l_suppkey as supplier, count(*) as n from lineitem group by 1, 2)
      select 1 as version, 'sums' as name, flag, count(*)::bigint as rows, sum(n)::bigint as n from g group by flag
      union all select 2, 'sums', flag, count(*), sum(case when flag = 'R' then n * 10 else n end)::bigint from g where flag <> 'A' group by flag
      union all select 1, 'totals', flag, 1, sum(n)::bigint from g group by flag
      union all select 2, 'totals', flag, 1, sum(case when flag = 'R' then n * 10 else n end)::bigint from g where flag <> 'A' group by flag""",
)
def inc_partition_swap(spark, sf_dir):
    """One partition rewritten and one dropped in a table, and its totals with it, in one step; both versions are read afterwards."""
    base = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"))
    totals = lambda df: df.groupBy("flag").agg(F.sum("n").alias("n"))
    old = versions.publish(spark, base, {"sums": versions.Change(sums, "flag"), "totals": versions.Change(totals(sums), "flag")})
    returned = versions.read(spark, base, "sums", old).where("flag = 'R'").withColumn("n", F.col("n") * 10)
    new = versions.publish(spark, base, {"sums": versions.Change(returned, "flag", drop=("A",)), "totals": versions.Change(totals(returned), "flag", drop=("A",))}, old)
    seen = [versions.read(spark, base, name, at).select(F.lit(at.number).alias("version"), F.lit(name).alias("name"), "flag", "n") for at in (old, new) for name in ("sums", "totals")]
    out = seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])
    return without_folder(out.groupBy("version", "name", "flag").agg(F.count("*").alias("rows"), F.sum("n").alias("n")), base)


@register("inc_keyset_loop", "select count(*)::bigint as rows, sum(o_orderkey)::bigint as total, max(o_orderkey) as last from orders")
def inc_keyset_loop(spark, sf_dir):
    """Running totals that go on behind the last key of an earlier, unfinished run."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    begun = sync.running_totals(orders.where("o_orderkey < 100"), "o_orderkey")
    return sync.running_totals(orders, "o_orderkey", begun)


@register("inc_webhook_offset", "select user_id, max(event_id) + 1 as next_offset from events group by 1")
def inc_webhook_offset(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("event_id") + 1).alias("next_offset"))


@register("inc_session_state", "select conv_id, max(turn) as turn, arg_max(role, turn) as role, md5(arg_max(text, turn)) as h from conversations group by 1")
def inc_session_state(spark, sf_dir):
    """Latest row per session, folded in the order of turns."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max(F.struct("role", "text")).alias("r")).select("conv_id", "turn", "r.role", "r.text")
    return sync.latest(rows, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", F.md5("text").alias("h"))


@register("inc_history_append", "select conv_id, count(*) filter (where role = 'assistant')::bigint as results, count(*)::bigint as turns from conversations group by 1")
def inc_history_append(spark, sf_dir):
    """Turns appended to the history of their sessions in three runs, then read as one."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    for run in range(3):
        turns.where(F.col("turn") % 3 == run).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return without_folder(spark.read.parquet(path).groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("results"), F.count("*").alias("turns")), path)


@register("inc_poll_offset", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def inc_poll_offset(spark, sf_dir):
    """The same state through Structured Streaming: offsets in a checkpoint, what is there, then stop."""
    events = table(spark, sf_dir, "events")
    base = f"{shared_folder(spark)}/poll-{uuid.uuid4().hex}"
    events.select("event_id", "user_id", "event_type").write.parquet(f"{base}/in")
    stream = sessions.event_stream(spark, f"{base}/in", events.select("event_id", "user_id", "event_type").schema)
    return without_folder(sessions.upsert_latest(stream, f"{base}/out", f"{base}/offsets", ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type"), base)


_GAP = 4 * 3600


@register(
    "inc_session_stream",
    f"""with e as (select user_id, event_id, ts, round(value * 100)::bigint as amount, event_type = 'signup' as reset, lag(ts) over w as before from events window w as (partition by user_id order by ts, event_id)),
      s as (select *, sum((before is null or reset or epoch_us(ts) - epoch_us(before) > {_GAP} * 1000000::bigint)::int) over (partition by user_id order by ts, event_id) as number from e)
      select user_id, min(ts) as start, max(ts) as last, count(*)::bigint as n, sum(amount)::bigint as amount from s group by user_id, number""",
)
def inc_session_stream(spark, sf_dir):
    """Sessions of users as keyed state: events land in three parts, the job runs behind each."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.expr("cast(round(value * 100) as long)").alias("amount"), (F.col("event_type") == "signup").alias("reset"))
    base = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    for low, high in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(f"{base}/in")
        session_state.run(sessions.event_stream(spark, f"{base}/in", events.schema, files_per_batch=100_000), f"{base}/out", f"{base}/state", _GAP)
    found = session_state.current(spark, f"{base}/out").select(F.col("key").alias("user_id"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "last")], "n", "amount")
    return without_folder(found, base)


@register("ext_windowed_counts", "select date_trunc('day', ts) as start, event_type, count(*)::bigint as n, sum(value::decimal(18,2))::decimal(28,2) as total from events group by 1, 2")
def ext_windowed_counts(spark, sf_dir):
    """An extra beyond the catalogue's operators."""
    return sessions.windowed_counts(table(spark, sf_dir, "events"))
