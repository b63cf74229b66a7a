"""Sources and sinks: round trips through the shared folder, compared with what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumicat.plans.registry import register
from lumicat.session import shared_folder, table
from lumicat.sources import csv_split, files

_PART = "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part"
_TEXTS = "select doc_id, coalesce(text, '') as text, lang from documents"


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@register("src_sql_query", "select count(*)::bigint as n, min(o_orderkey) as low, max(o_orderkey) as high from orders")
def src_sql_query(spark, sf_dir):
    """SQL text over a registered view."""
    return spark.sql("select count(*) as n, min(o_orderkey) as low, max(o_orderkey) as high from {orders}", orders=table(spark, sf_dir, "orders"))


@register("src_sql_exec", "select p_type, count(*)::bigint as n from part group by 1")
def src_sql_exec(spark, sf_dir):
    """A script of statements: a temporary view, then a query of it."""
    name = f"part_{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").createOrReplaceTempView(name)
    out = None
    for statement in f"create or replace temp view {name}_types as select p_type from {name}; select p_type, count(*) as n from {name}_types group by p_type".split(";"):
        out = spark.sql(statement)
    return out


@register("src_csv", _TEXTS)
def src_csv(spark, sf_dir):
    """Quotes, line breaks and empty cells survive a CSV round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    path = folder(spark)
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema, multi_line=True)


@register("src_csv_split", _TEXTS)
def src_csv_split(spark, sf_dir):
    """The same in splits: neither the writing nor the reading is bound to a task a file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    path = folder(spark)
    files.write_csv(docs, path)
    return csv_split.read_csv_split(spark, path, docs.schema)


@register("src_csv_bom", "select p_partkey::varchar as p_partkey, p_name from part")
def src_csv_bom(spark, sf_dir):
    path = folder(spark)
    files.write_csv_bom(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path)
    return files.read_csv_bom(spark, path)


@register("snk_csv_bom", "select count(*)::bigint as n from nation")
def snk_csv_bom(spark, sf_dir):
    path = folder(spark)
    files.write_csv_bom(table(spark, sf_dir, "nation"), path)
    return files.read_csv_bom(spark, path).where("n_name is not null").agg(F.count("*").alias("n"))


@register("snk_csv_minimal", _PART)
def snk_csv_minimal(spark, sf_dir):
    part, path = table(spark, sf_dir, "part"), folder(spark)
    files.write_csv(part, path)
    return files.read_csv(spark, path, part.schema)


@register("snk_csv_quoted", "select count(*)::bigint as n from part")
def snk_csv_quoted(spark, sf_dir):
    """Every cell is quoted: so many lines begin and end with a quote."""
    path = folder(spark)
    files.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path, quote_all=True)
    return spark.read.text(path).where(F.col("value").rlike('^"[0-9]+",".*"$')).agg(F.count("*").alias("n"))


@register("snk_json", "select p_partkey, p_name, p_size from part")
def snk_json(spark, sf_dir):
    part, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), folder(spark)
    files.write_json(part, path)
    return spark.read.schema(part.schema).json(path)


@register("snk_copy_in", "select c_custkey, c_name from customer")
def snk_copy_in(spark, sf_dir):
    """A staging load: a CSV as a temporary view."""
    customer, path, name = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), folder(spark), f"stage_{uuid.uuid4().hex}"
    files.write_csv(customer, path)
    files.read_csv(spark, path, customer.schema).createOrReplaceTempView(name)
    return spark.sql(f"select c_custkey, c_name from {name}")


@register("snk_batched_sql", "select o_orderkey, o_custkey from orders where o_orderstatus = 'O'")
def snk_batched_sql(spark, sf_dir):
    """A full reload: overwrite, whatever was there before."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), folder(spark)
    orders.write.mode("overwrite").parquet(path)
    orders.where("o_orderstatus = 'O'").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey")


@register(
    "snk_md_report",
    """with r as (select c_nationkey, count(*) as customers, max(c_custkey) as last from customer group by 1 order by customers desc, c_nationkey limit 8)
    select 1::bigint as n, '# Customers' as line union all select 2, '' union all select 3, '| nation | customers | last |' union all select 4, '| --- | --- | --- |'
    union all select 4 + row_number() over (order by customers desc, c_nationkey), '| ' || c_nationkey || ' | ' || customers || ' | ' || last || ' |' from r""",
)
def snk_md_report(spark, sf_dir):
    """A report of the eight largest groups, line by line."""
    groups = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), F.max("c_custkey").alias("last"))
    text = files.markdown(groups.orderBy(F.desc("customers"), "nation"), "Customers", most=8)
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "n bigint, line string")


@register("src_sql_file", "select p_brand, count(*)::bigint as n, max(p_size)::bigint as most from part where p_size > 10 group by 1")
def src_sql_file(spark, sf_dir):
    """A file of statements over a view, with comments and a semicolon inside a text."""
    name, path = f"part_{uuid.uuid4().hex}", folder(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView(name)
    script = f"-- sizes\ncreate or replace temp view {name}_large as\nselect *, 'a;b' as mark from {name} where p_size > 10;\n\n-- counts\nselect p_brand, count(*) as n, cast(max(p_size) as bigint) as most\nfrom {name}_large where mark = 'a;b' group by p_brand;\n"
    spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(path)
    return files.run_sql_file(spark, path)


@register("src_http_json", "select o_orderkey as id, o_orderstatus as status from orders")
def src_http_json(spark, sf_dir):
    """Landed API pages of 100 items each, read as items."""
    path = folder(spark)
    items = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).cast("int").alias("page")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("items"))
    files.write_json(items, path)
    return files.read_pages(spark, path, "struct<id: bigint, status: string>").select("id", "status")


@register("src_manifest", "select p_partkey::varchar as program_id, case when p_size % 2 = 0 then 'pdf' else 'docx' end as document_format from part")
def src_manifest(spark, sf_dir):
    path = folder(spark)
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("/docs/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".PDF").otherwise(".docx"))
    files.write_csv(part.select(F.col("p_partkey").alias("program_id"), F.col("p_name").alias("program_name"), F.lit("u").alias("program_portal_url"), name.alias("document_path")), path)
    return files.read_manifest(spark, path).select("program_id", "document_format")


@register("src_doc_text", "select n_nationkey::bigint as n, n_name as text from nation")
def src_doc_text(spark, sf_dir):
    """One text file per nation, read whole with its path."""
    path = folder(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    read = files.read_text(spark, f"{path}/*/part-*")
    return read.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("bigint").alias("n"), F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("text"))


@register("src_download", "select o_orderkey as program_id, 'u' || o_orderkey as url from orders where o_orderkey % 3 <> 0 or o_custkey % 5 = 0")
def src_download(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = orders.select(F.col("o_orderkey").alias("program_id"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    present = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("program_id"), (F.col("o_custkey") % 5).alias("bytes"))
    return files.usable_downloads(wanted, present)


@register("src_http_cached", "select n_name, count(*)::bigint as n from nation join customer on c_nationkey = n_nationkey group by 1")
def src_http_cached(spark, sf_dir):
    """A reference table that is fetched once and kept for ten minutes."""
    path = folder(spark)
    keep = lambda: files.kept_table(spark, path, lambda: table(spark, sf_dir, "nation"), seconds=600)
    keep()
    nation = keep()
    return nation.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@register("src_docx_tables", "select p_partkey, 'TABLE_ROW || ' || p_name || ' || ' || p_size as row from part")
def src_docx_tables(spark, sf_dir):
    """A DOCX per part is made in the tasks, then its tables are read."""

    def packed(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for key, name, size in zip(batch.p_partkey, batch.p_name, batch.p_size):
                cells = "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in (name, size))
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:tbl><w:tr><w:tc/></w:tr></w:tbl><w:tbl><w:tr>{cells}</w:tr><w:tr><w:tc></w:tc></w:tr></w:tbl></w:body></w:document>")
                out.append((str(key), buffer.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    made = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").mapInPandas(packed, "path string, content binary")
    return files.docx_tables(made).select(F.col("path").cast("bigint").alias("p_partkey"), F.get(F.split("text", "\n"), F.lit(1)).alias("row"))
