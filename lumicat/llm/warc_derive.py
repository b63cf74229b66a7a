"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response record holds an HTTP message. From each, two records are made: a
``metadata`` record (``application/warc-fields``) that keeps the source headers
and names the conversion, and a ``conversion`` record with the plain text. Both
refer to the response by ``WARC-Refers-To``, keep its target URI and date, name
the payload digest of the source, and have ids that depend on the source id
only, so a task that runs again writes the same records. Everything is column
expressions, but for payloads that are no plain UTF-8 and for texts with rarer
character references, which pandas UDFs decode; records are laid out byte by byte
as WARC 1.1 asks, and blocks are cut by octets.

``read`` takes records from WARC files, compressed or not, and ``write`` makes
such files. A payload keeps its digest whatever its character set, transfer or
content coding; only the text is decoded.

Defined cases: a null or empty payload gives a conversion of an empty text. A
null URI leaves the WARC-Target-URI header out. A block longer than what there is
of the record ends with it, and one without a readable Content-Length is all but
the two line ends; both have ``complete`` false. A character set that is unknown
or wrong gives replacement characters. All members of a gzip payload and all frames of a zstd payload are
read, up to ``MOST_OCTETS``; a longer or cut one, and one in another coding that
is no text as it stands, whose text is empty, have ``complete`` false too. A payload that isn't coded as its header says stays as it is. Repeated rows give repeated records with equal ids.
``responses`` ignores extra columns; ``parse`` and ``derive`` carry them, but for
those named like the added ones, which are replaced.
"""

from __future__ import annotations

import codecs
import html as _html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.llm.text import staged, unused

CRLF = "\r\n"
#: Date of pages that come without one.
DATE = "2024-01-01T00:00:00Z"
#: Octets to which a compressed payload is inflated; what goes beyond is left out and the record is marked.
MOST_OCTETS = 64 << 20
#: What lies between two records.
SEPARATOR = CRLF * 2 + "WARC/1."


def record_id(*parts: Column) -> Column:
    """A urn:uuid of version 5 form from a SHA-1 of the parts."""
    h = F.sha1(F.concat_ws("|", *parts).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(payload: Column) -> Column:
    """A labelled digest; the algorithm is named as the standard allows."""
    return F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))


def header(*fields: tuple[str, Column]) -> Column:
    """WARC header lines; a field that is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def _size(block: Column) -> Column:
    return F.octet_length(block).cast("string")


def responses(pages: DataFrame, date: str | Column = DATE) -> DataFrame:
    """Response records of crawled pages: one HTTP message per row of ``pages``, with its date or one for all."""
    body = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), _size(body), F.lit(CRLF + CRLF), body)
    rows = pages.select("page_id", "url", http.alias("block"), digest(body).alias("payload_digest"), record_id(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).alias("record_id"), (F.lit(date) if isinstance(date, str) else date).alias("date"))
    top = header(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(F.col("block"))), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", _size(F.col("block"))),
    )
    return rows.select("page_id", F.concat(top, F.col("block"), F.lit(CRLF * 2)).alias("record"))


#: Columns that ``parse`` and ``derive`` add.
PARSED = ["record_id", "date", "uri", "payload_digest", "http_headers", "payload", "block_bytes", "complete"]
DERIVED = ["record_type", "record_id", "refers_to", "uri", "date", "source_digest", "block_digest", "block", "record"]


def parse(records: DataFrame) -> DataFrame:
    """Header fields, HTTP headers and decoded payload of response records, one per row.

    ``record`` is a string or bytes. The block is found by the blank line behind
    the header and cut by ``Content-Length``, in octets; other record types are
    left out.
    """
    head, raw, kind, left, block, http, body, coded, text = unused(records, "_head", "_raw", "_type", "_left", "_block", "_http", "_body", "_coded", "_decoded")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    own = [F.col(f"`{c}`") for c in records.columns if c not in ("record", *PARSED)]
    split = staged(records.select(*own, "record"), {head: F.substring_index(F.col("record").cast("string"), CRLF * 2, 1), raw: F.col("record").cast("binary")}, ("record",))
    size = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$", 1).try_cast("int")
    behind = F.greatest(F.octet_length(raw) - F.octet_length(head) - 4, F.lit(0))
    split = staged(split, {kind: field("WARC-Type"), left: behind, "block_bytes": size}).where(F.col(kind) == "response")
    cut = F.coalesce("block_bytes", F.greatest(F.col(left) - 2 * len(CRLF), F.lit(0)))
    split = staged(split, {block: F.substring(F.col(raw), F.octet_length(head) + 5, cut)}, (raw,))
    split = staged(split, {http: F.substring_index(F.col(block).cast("string"), CRLF * 2, 1)})
    split = staged(split, {body: F.expr(f"substring({block}, octet_length({http}) + 5)")}, (block,))
    split = staged(split, {coded: F.col(http).rlike(CODED) | ~F.is_valid_utf8(F.col(body).cast("string"))})
    split = staged(split, {text: _decode_payloads(F.when(F.col(coded), F.col(body)), F.when(F.col(coded), F.make_valid_utf8(http)))})
    return split.select(
        *own,
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Date").alias("date"),
        field("WARC-Target-URI").alias("uri"),
        field("WARC-Payload-Digest").alias("payload_digest"),
        F.col(http).alias("http_headers"),
        F.when(F.col(coded), F.col(text)["text"]).otherwise(F.col(body).cast("string")).alias("payload"),
        F.col("block_bytes").cast("long").alias("block_bytes"),
        (F.coalesce(F.col(left) >= F.col("block_bytes"), F.lit(False)) & F.coalesce(F.col(text)["whole"], F.lit(True))).alias("complete"),
    )


_CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)")
#: HTTP headers by which a payload may be no plain UTF-8.
CODED = r"(?im)^(content-encoding|transfer-encoding):|^content-type:.*charset[ \t]*=[ \t]*[\"']?[ \t]*(?!utf-?8\b)"


def _unchunked(data: bytes) -> bytes:
    parts, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = int(data[at:end].split(b";")[0].strip() or b"0", 16)
        if size <= 0:
            return b"".join(parts)
        parts.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def _inflated(data: bytes, bits: int, most: int) -> tuple[bytes, bool]:
    """All members of a compressed stream up to ``most`` octets, and whether that is all of it."""
    parts, size = [], 0
    while data:
        member = zlib.decompressobj(bits)
        try:
            parts.append(member.decompress(data, most - size + 1))
        except zlib.error:
            if not parts:
                raise
            return b"".join(parts), False
        size += len(parts[-1])
        if size > most:
            return b"".join(parts)[:most], False
        if not member.eof:
            return b"".join(parts), False
        data = member.unused_data if member.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(parts), True


def _unzstd(data: bytes, most: int) -> tuple[bytes, bool]:
    reader, parts, size = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True), [], 0
    while size <= most and (part := reader.read(min(1 << 20, most - size + 1))):
        parts.append(part)
        size += len(part)
    return b"".join(parts)[:most], size <= most


def _uncoded(data: bytes, coding: str, most: int) -> tuple[bytes, bool]:
    """A payload without one content coding. What isn't coded as its header says is often decoded already and stays as it is."""
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # gzip or zlib by its head, or bare
            try:
                return _inflated(data, bits, most)
            except zlib.error:
                pass
        return data, True
    if coding == "zstd":
        try:
            return _unzstd(data, most)
        except zstandard.ZstdError:
            return data, data[:4] != b"\x28\xb5\x2f\xfd"
    if coding in ("", "identity"):
        return data, True
    try:
        data.decode("utf-8")
        return data, True
    except UnicodeDecodeError:
        return b"", False


def decoded_payload(data: bytes, headers: str, most: int = MOST_OCTETS) -> tuple[str, bool]:
    """The text of a payload and whether it is whole: transfer and content codings undone, then the character set of header or page."""
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(":") for line in headers.split("\n"))}
    if "chunked" in fields.get("transfer-encoding", ""):
        try:
            data = _unchunked(data) or data
        except ValueError:
            pass
    whole = True
    for coding in reversed(fields.get("content-encoding", "").split(",")):
        data, all_of_it = _uncoded(data, coding.strip(), most)
        whole = whole and all_of_it
    named = _CHARSET.search(fields.get("content-type", "").encode()) or _CHARSET.search(data[:1024])
    for name in [named[1].decode()] if named else []:
        try:
            return codecs.lookup(name).decode(data, "replace")[0], whole
        except (LookupError, TypeError, ValueError):
            pass
    return data.decode("utf-8", "replace"), whole


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("whole", T.BooleanType())]))
def _decode_payloads(payloads: pd.Series, headers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if p is None else decoded_payload(p, h or "") for p, h in zip(payloads, headers)], columns=["text", "whole"], index=payloads.index)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces between separators as records: one that falls short of its Content-Length takes the next pieces too."""
    length = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")
    mark = SEPARATOR.encode()
    file, parts, have, need = None, [], 0, 0
    for batch in batches:
        out = []
        for name, piece in zip(batch.file, batch.piece):
            piece = bytes(piece)
            if parts and name != file:
                out.append((file, b"".join(parts), False))
                parts = []
            if not parts:
                file = name
                parts = [piece if piece.startswith(mark[4:]) else mark[4:] + piece]
                head, _, rest = parts[0].partition(b"\r\n\r\n")
                size = length.search(head)
                have, need = len(rest), int(size[1]) if size else 0
            else:
                parts += [mark, piece]
                have += len(mark) + len(piece)
            if have >= need:
                out.append((file, b"".join(parts), True))
                parts = []
        yield pd.DataFrame(out, columns=["file", "record", "complete"])
    if parts:
        yield pd.DataFrame([(file, b"".join(parts), False)], columns=["file", "record", "complete"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, record, complete: the records of WARC files, as bytes.

    Files are read as a stream and cut at ``SEPARATOR``, so no file is held
    whole; a separator inside a block is told from a true one by
    ``Content-Length``. Compressed files are one task each. Uncompressed ones
    may be split; those that hold WARC files in their records should be compressed.
    """
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(_whole, "file string, record binary, complete boolean")


def write(records: DataFrame, path: str) -> None:
    """Writes ``record`` of each row to gzip-compressed WARC files."""
    end = CRLF * 2
    body = F.expr(f"substring(cast(record as binary), 1, octet_length(record) - {len(end)})").cast("string")
    records.select(body.alias("value")).write.option("lineSep", end).option("compression", "gzip").text(path)


# fixed values: character references decoded in plain text
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


#: A reference that isn't among these: any other name, or a number.
OTHER_REFERENCE = "&(?!(?:" + "|".join(r[1:-1] for r, _ in REFERENCES) + ");)[#A-Za-z]"
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)")


def _decoded(match: re.Match) -> str:
    reference = match[0]
    if reference[1] == "#" and len(reference) > 32:
        digits = reference[2:].lstrip("xX").rstrip(";").lstrip("0")
        reference = "&#" + ("x" if reference[2] in "xX" else "") + (digits or "0")[:16] + ";"
    char = _html.unescape(reference)
    return " " + char[1:] if char[0:1] == "\xa0" else char


@F.pandas_udf(T.StringType())
def decode_all(texts: pd.Series) -> pd.Series:
    """All character references of HTML in one pass, a no-break space as a space; null stays null."""
    return texts.map(lambda t: None if t is None else _REFERENCE.sub(_decoded, t))


def stripped(html: Column) -> Column:
    """Scripts, styles, comments and tags cut, blocks on lines of their own; references are left."""
    text = F.regexp_replace(html, r"(?is)<(?:!--.*?-->|(script|style|head|noscript)\b.*?</\1\s*>)", " ")
    text = F.regexp_replace(text, r"\s(?:(?<! )|\s)\s*", " ")  # all white space but single spaces
    text = F.regexp_replace(text, r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|footer|header|aside|main|blockquote|body|html)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", "")


def _known_references(text: Column) -> Column:
    """REFERENCES decoded in one pass: what follows an ampersand begins with one of them or stays."""

    def piece(x: Column, i: Column) -> Column:
        out = F.when(i == 0, x)
        for reference, char in REFERENCES:
            out = out.when(F.startswith(x, F.lit(reference[1:])), F.concat(F.lit(char), F.substr(x, F.lit(len(reference)))))
        return out.otherwise(F.concat(F.lit("&"), x))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def plain_text(text: Column, other: Column) -> Column:
    """``stripped`` text with its references decoded: natively unless ``other`` says that REFERENCES hasn't them all.

    Lines lose the spaces at their ends; empty ones go.
    """
    decoded = F.when(other, decode_all(F.when(other, text))).otherwise(_known_references(text))
    return F.array_join(F.filter(F.transform(F.split(decoded, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response record: its ``metadata`` and ``conversion`` records.

    Columns: those of ``records`` but ``record``, then record_type, record_id,
    refers_to, uri, date, source_digest, block_digest, block and record.
    """
    own = [F.col(f"`{c}`") for c in records.columns if c not in (*PARSED, *DERIVED)]
    text, other, meta_id, text_id, kind = unused(records, "_text", "_other", "_meta_id", "_text_id", "_kind")
    source = staged(parse(records), {text: stripped(F.col("payload"))})
    source = staged(source, {other: F.col(text).rlike(OTHER_REFERENCE)})
    source = source.withColumn(text, plain_text(F.col(text), F.col(other)))
    source = source.withColumn(meta_id, record_id(F.lit("metadata"), F.col("record_id"))).withColumn(text_id, record_id(F.lit("conversion"), F.col("record_id")))
    header_lines = F.transform(F.filter(F.split("http_headers", CRLF), lambda x: x != ""), lambda x: F.concat(F.lit("http-header: "), x, F.lit(CRLF)))
    meta = F.concat(
        F.array_join(header_lines, ""), F.lit("source-payload-digest: "), F.coalesce("payload_digest", F.lit("-")), F.lit(CRLF),
        F.lit("payload-bytes: "), _size(F.col("payload")), F.lit(CRLF), F.lit("derived-record: "), F.col(text_id), F.lit(CRLF),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col(meta_id).alias("record_id"), meta.alias("block"), F.lit("application/warc-fields").alias(kind)),
        F.struct(F.lit("conversion").alias("record_type"), F.col(text_id).alias("record_id"), F.col(text).alias("block"), F.lit("text/plain; charset=utf-8").alias(kind)),
    )
    rows = source.select(*own, F.col("record_id").alias("refers_to"), "uri", "date", F.col("payload_digest").alias("source_digest"), F.inline(made))
    rows = rows.withColumn("block_digest", digest(F.col("block")))
    top = header(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("uri")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col(kind)), ("Content-Length", _size(F.col("block"))),
    )
    return rows.select(*own, *DERIVED[:-1], F.concat(top, F.col("block"), F.lit(CRLF * 2)).alias("record"))
