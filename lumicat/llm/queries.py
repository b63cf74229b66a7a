"""The queries of the llm operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm import decontam, html_diff, langid, line_dedup, line_quality, mixing, pii_gbt, reply_trees, secret_dfa, setsketch, source_audit, token_alignment, warc_derive
from lumicat.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op8_line_dedup"] = r"""
with split_lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from split_lines),
holders as (
  select key, min(doc_id) as first_doc, count(distinct doc_id) as n_docs
  from keyed where length(key) >= 10 group by key),
marked as (
  select k.doc_id, k.pos, k.line, coalesce(h.n_docs >= 2 and k.doc_id <> h.first_doc, false) as dropped
  from keyed k left join holders h on k.key = h.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""


@_query
def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


ORACLE_SQL["op4_poisson_mix"] = """
with sizes as (
  select coalesce(source, '(none)') as src, sum(length(coalesce(text, '')))::double as size from documents group by 1),
totals as (select sum(size) as all_size, sum(pow(size, 0.5)) as all_weight from sizes),
rates as (
  select src, case when size > 0 then pow(size, 0.5) * all_size / all_weight / size else 1.0 end as rate
  from sizes, totals),
drawn as (
  select d.*, r.rate,
         (('0x' || substr(md5('17|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents d join rates r on coalesce(d.source, '(none)') = r.src),
terms as (
  select src, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by src order by k) as cdf
  from (select src, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::bigint + 1)) as k from rates)),
counted as (
  select d.*, (select count(*) from terms t where t.src = coalesce(d.source, '(none)') and d.u >= t.cdf)::int as n_copies
  from drawn d)
select doc_id, text, lang, source, n_chars, round(rate, 9) as rate, n_copies, replica::int as replica,
       md5('17s|' || doc_id::varchar || '|' || replica::varchar) as shuffle_key
from (select *, unnest(range(1, n_copies + 1)) as replica from counted where n_copies > 0)
"""


@_query
def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE_SQL["op3_line_quality"] = r"""
with docs as (select row_number() over () as r, doc_id, text as raw, coalesce(text, '') as text, coalesce(source, '') as host from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs),
win as (
  select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
hashed as (select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from win),
counted as (select r, i, count(*) over (partition by r, a, b, c) as n from hashed),
covered as (select r, count(distinct i + d) as n_repeat from counted, range(0, 3) t(d) where n >= 2 group by r),
all_lines as (select r, host, doc_id, raw, unnest(string_split(text, chr(10))) as line from docs where raw is not null),
dup as (
  select r, count(*) - count(distinct line) as n_dup from all_lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
norm as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from all_lines),
held as (
  select r, host, key, any_value(doc_id) as doc_id, any_value(raw) as raw, count(*) as times, len(regexp_extract_all(key, '[^\x20\x09-\x0D]+')) as n
  from norm where key <> '' group by r, host, key),
sizes as (select host, count(*) as docs from (select distinct host, doc_id, raw from docs) group by 1),
holders as (select host, key, count(*) as n from (select distinct host, key, doc_id, raw from held) group by 1, 2),
template as (
  select host, key from holders h join sizes s using (host) where h.n > least(1000, greatest(5, s.docs * 0.1::double))),
template_words as (
  select r, sum(n * times)::bigint as tw, sum(times)::bigint as tl
  from held join template using (host, key) group by r),
base as (
  select w.doc_id, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words,
         coalesce(tw, 0)::bigint as n_template_words, coalesce(tl, 0)::bigint as n_template_lines
  from w left join dup using (r) left join covered using (r) left join template_words using (r))
select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
       and n_words - n_template_words >= n_words * 0.3::double as kept
from base
"""


@_query
def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_size=4)


@_query
def op6_secret_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_dfa.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@_query
def op2_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@_query
def op7_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query
def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derive(warc_derive.responses(table(spark, sf_dir, "pages")))


_DUCK_TEXT = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g')"
_DUCK_TEXT = rf"regexp_replace({_DUCK_TEXT}, '\s+', ' ', 'g')"
_DUCK_TEXT = rf"regexp_replace({_DUCK_TEXT}, '(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|footer|header|aside|main|blockquote|body|html)\b[^>]*>', chr(10), 'g')"
_DUCK_TEXT = rf"regexp_replace({_DUCK_TEXT}, '<[A-Za-z/!?][^>]*>', '', 'g')"
for _from, _to in warc_derive.REFERENCES:
    _DUCK_TEXT = "replace({}, '{}', '{}')".format(_DUCK_TEXT, _from.replace("'", "''"), _to.replace("'", "''"))
_DUCK_TEXT = rf"regexp_replace(regexp_replace({_DUCK_TEXT}, ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def _duck_id(*parts: str) -> str:
    h = f"sha1({" || '|' || ".join(parts)})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"


ORACLE_SQL["op5_warc_derivatives"] = f"""
with source as (
  select page_id, url as uri, coalesce(html, '') as payload, {_DUCK_TEXT} as plain, '{warc_derive.DATE}' as date,
         {_duck_id("'response'", "page_id::varchar", "coalesce(url, '')")} as refers_to,
         'sha256:' || sha256(coalesce(html, '')) as source_digest, chr(13) || chr(10) as nl
  from pages),
ids as (select *, {_duck_id("'metadata'", "refers_to")} as meta_id, {_duck_id("'conversion'", "refers_to")} as text_id from source),
made as (
  select *, 'metadata' as record_type, meta_id as record_id, 'application/warc-fields' as kind,
         'http-header: HTTP/1.1 200 OK' || nl || 'http-header: Content-Type: text/html; charset=utf-8' || nl
         || 'http-header: Content-Length: ' || octet_length(encode(payload))::varchar || nl
         || 'source-payload-digest: ' || source_digest || nl || 'payload-bytes: ' || octet_length(encode(payload))::varchar || nl
         || 'derived-record: ' || text_id || nl as block
  from ids
  union all
  select *, 'conversion', text_id, 'text/plain; charset=utf-8', plain from ids)
select page_id, record_type, record_id, refers_to, uri, date, source_digest, 'sha256:' || sha256(block) as block_digest, block,
       'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || refers_to || nl
       || 'WARC-Date: ' || date || nl || coalesce('WARC-Target-URI: ' || uri || nl, '') || 'WARC-Block-Digest: sha256:' || sha256(block) || nl
       || 'Content-Type: ' || kind || nl || 'Content-Length: ' || octet_length(encode(block))::varchar || nl || nl || block || nl || nl as record
from made
"""


@_query
def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_gbt.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii_gbt.KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(pii_gbt.listed(F.col("base")), 256).alias("base_sha256"), pii_gbt.listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))


#: fixed value: what both turns of the conversation beside the table say
OWN_TURN = "\\### Assistant: </turn> ok"


@_query
def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN_TURN).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = reply_trees.format_trees(reply_trees.chains(turns))
    read = out.select("conv_id", "formatted", reply_trees.read_turns(F.col("formatted")).alias("t"), reply_trees.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op12_reply_trees"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<turn ' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') || '>' || text || '</turn>' || chr(10))
           + len(regexp_extract_all(text, '<\\*/?turn')))::bigint as formatted_chars
from turns group by conv_id
"""


@_query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL["op11_source_audit"] = r"""
with docs as (select row_number() over () as d, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
terms as (
  select d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term, count(*) as n from terms group by lang, term having count(distinct d) >= 3),
groups as (select distinct lang, source from docs),
sizes as (select lang, count(*) as v, sum(n) as total from kept group by lang),
held as (select t.lang, source, term, count(*) as n from terms t join kept using (lang, term) group by all),
totals as (select lang, source, sum(n) as total from held group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(h.n, 0) as n,
         (1 + (1000000000::hugeint * (coalesce(h.n, 0) + 1)) // (coalesce(t.total, 0) + s.v))::hugeint as p,
         (1 + (1000000000::hugeint * (k.n + 1)) // (s.total + s.v))::hugeint as q
  from groups g join kept k on g.lang = k.lang join sizes s on g.lang = s.lang
  left join totals t on t.lang = g.lang and t.source = g.source
  left join held h on h.lang = g.lang and h.source = g.source and h.term = k.term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from groups a join groups b on a.lang = b.lang and a.source <> b.source
  where a.lang not in (select lang from sizes)),
telling as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank
  from (select * from pairs union all select * from telling))
select * from ranked where part = 'pair' or rank <= 200
"""


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
