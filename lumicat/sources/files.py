"""File sources and sinks of the catalogue: CSV, JSON, text and documents by format."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values: formats by extractor, and the words that lead table lines
FORMATS = {"text": ["txt", "md", "html", "htm", "json", "csv"], "office": ["doc", "docx", "rtf"], "pdf": ["pdf"]}
TABLE_BEGIN, TABLE_END, TABLE_ROW = "STRUCTURED_DOCX_TABLE_BEGIN", "STRUCTURED_DOCX_TABLE_END", "TABLE_ROW"


def read_options() -> dict[str, str]:
    """Options of readers that tell a missing cell (null) from a quoted empty one (an empty text).

    A missing cell stands for ``nullValue``, and so does a cell that holds it: so it is a text that no file can hold by chance. By
    default a NUL before a quote would be taken for its escape and lost.
    """
    return {"quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "emptyValue": "", "nullValue": f"missing {uuid.uuid4().hex}", "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """Quoted cells with doubled quotes; a missing cell is null, a quoted empty one of text is empty, blank rows go.

    With ``multi_line`` cells may hold line breaks, and each file is one task.
    """
    return spark.read.options(**read_options()).csv(path, header=True, schema=schema, multiLine=multi_line)


def read_csv_bom(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """As text columns, with a byte order mark cut from the first header."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Cells as they are, with their white space; a null is a missing cell and an empty text a quoted one. With ``quote_all`` both are quoted."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A manifest of documents; required fields are checked per row, the format follows the extension."""
    rows = spark.read.json(path) if path.rsplit(".", 1)[-1].startswith("json") else read_csv_bom(spark, path, multi_line)
    for name in ("program_id", "program_name", "document_path"):
        if name not in rows.columns:
            raise ValueError(f"the manifest has no column {name}")
    checked = rows.withColumn("document_path", F.when(F.coalesce(F.trim("document_path"), F.lit("")) == "", F.raise_error(F.lit("a manifest row has no document_path"))).otherwise(F.col("document_path")))
    return checked.withColumn("document_format", F.coalesce(F.col("document_format"), extension(F.col("document_path"))) if "document_format" in rows.columns else extension(F.col("document_path")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route(path: Column) -> Column:
    """The extractor of a document: text, office or pdf; others are null."""
    ext = extension(path)
    out = F.when(F.lit(False), "")
    for name, extensions in FORMATS.items():
        out = out.when(ext.isin(extensions), name)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, route, content of all files below a folder; files of unknown formats go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", route(F.col("path")).alias("route"), "content").where("route is not null")


def markdown(df: DataFrame, title: str, most: int = 100) -> str:
    """A small report as a Markdown table; at most ``most`` rows come to the driver."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]]) + "\n"


def write_csv_bom(df: DataFrame, path: str) -> None:
    """One header with a byte order mark per file, cells quoted where needed."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_pages(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Landed API pages, a JSON object with ``items`` per line, as one row per item."""
    pages = spark.read.schema(f"page int, items array<{schema}>").json(path)
    return pages.select("page", F.inline("items"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _docx_lines(batches):
    """TABLE_ROW lines of the tables of DOCX files; a bar pair in a cell becomes a slash."""
    import io
    import zipfile
    from xml.etree import ElementTree

    import pandas as pd

    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def lines_of(content: bytes) -> list[str]:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{word}body")
        lines, number = [], 0
        # tables inside cells are no tables of the document
        for table in body.findall(f"{word}tbl") if body is not None else ():
            rows = []
            for row in table.findall(f"{word}tr"):
                cells = [" ".join(" ".join(t.text or "" for p in cell.findall(f"{word}p") for t in p.iter(f"{word}t")).split()).replace("||", "/") for cell in row.findall(f"{word}tc")]
                if any(cells):
                    rows.append(" || ".join([TABLE_ROW, *cells]))
            if rows:
                number += 1
                lines += [f"{TABLE_BEGIN} {number}", *rows, TABLE_END]
        return lines

    for batch in batches:
        out = []
        for path, content in zip(batch.path, batch.content):
            try:
                out.append((path, "\n".join(lines_of(content)), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as broken:
                out.append((path, None, f"{type(broken).__name__}: {broken}"))
        yield pd.DataFrame(out, columns=["path", "text", "error"])


def docx_tables(files: DataFrame) -> DataFrame:
    """path, text, error of (path, content) rows: tables with text only, as delimited lines.

    A broken file has a null text and says why in ``error``.
    """
    return files.select("path", "content").mapInPandas(_docx_lines, "path string, text string, error string")


def run_sql_file(spark: SparkSession, path: str) -> DataFrame | None:
    """Runs the statements of an SQL file in order; what the last one returns.

    Statements end at a semicolon at the end of a line; lines of comments go.
    """
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    lines = [x for x in text.splitlines() if not x.lstrip().startswith("--")]
    out = None
    for statement in "\n".join(x.rstrip() for x in lines).split(";\n"):
        if statement.strip(" ;\n"):
            out = spark.sql(statement.strip().rstrip(";"))
    return out


def kept_table(spark: SparkSession, path: str, fetch, seconds: float) -> DataFrame:
    """A reference table in a folder of its own, fetched anew where it is older than ``seconds`` or absent.

    ``fetch`` gives the DataFrame to keep. Everyone who reads meanwhile reads the folder as it was.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    made = [s for s in system.listStatus(where) if s.isDirectory()] if system.exists(where) else []
    done = sorted((s.getModificationTime(), s.getPath().toString()) for s in made if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    now = time.time()
    if done and now - done[-1][0] / 1000 < seconds:
        return spark.read.parquet(done[-1][1])
    fresh = f"{path}/{int(now * 1000)}"
    fetch().write.parquet(fresh)
    return spark.read.parquet(fresh)


def usable_downloads(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Documents still to fetch: wanted (program_id, url) without a usable present (program_id, bytes)."""
    return wanted.join(present.where("bytes > 0").select("program_id"), "program_id", "left_anti")
