"""The registered queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import alignment, bpe, extraction, hmm, langid, lexical, mixing, pii, quality, secrets, simhash, topk, warc
from tidewire.llm.common import table, tokenizer_path
from tidewire.session import Scratch, attach, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(attach(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _quoted(items) -> str:
    return ", ".join(f"'{item}'" for item in items)


QUALITY_SQL = rf"""
with texts as (
  select row_number() over () as r, doc_id, lang, coalesce(text, '') as body from documents),
split as (
  select r, doc_id, lang, body,
         list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from texts),
windows as (
  select r, i, array_to_string(ws[i:i + 4], ' ') as shingle
  from (select r, ws, unnest(range(1, len(ws) - 3)) as i from split)),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, shingle) as n from windows) where n > 1),
repeated as (
  select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
counted as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(repeated.n, 0)::bigint as n_repeat_words, len(ls) as n_lines,
         len(list_filter(ws, lambda w: trim(lower(w), '{quality.MARKS.replace("'", "''")}') in ({_quoted(quality.STOP_WORDS)}))) as n_function,
         coalesce(lower(regexp_extract(lang, '^[A-Za-z]+')) in ({_quoted(quality.STOP_LANGUAGES)}), false) as spoken,
         len(list_filter(ws, lambda w: regexp_matches(w, '\pL'))) as n_letter
  from split left join repeated using (r)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when base_failed then false
            else word_chars / n_words between 2.0 and 20.0 and n_symbols / n_words <= 0.6 and n_letter / n_words >= 0.6
                 and (n_function / n_words >= 0.02 or n_words < 50 or not spoken) and n_dup_lines / n_lines <= 0.4 and n_repeat_words / n_words <= 0.2
       end as kept
from judged"""


@query("op8_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), rules=quality.CORPUS_RULES, lang="lang")
    return rows.select("doc_id", *[f"quality.{name}" for name in
                                   ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
typed as (
  select *, min(page_id) over (partition by h) as first from p)
select page_id, strlen(body)::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from typed"""


@query("op1_warc", WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    files = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"), scratch)
    found = warc.read_warc(files)
    return found.select(warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        warc.page_id(F.col("refers_to")).alias("refers_to"))


TOP_K_SQL = """
with scaled as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from scaled q join scaled c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""


@query("op9_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _sql_kind(number: int, kind: secrets.Kind) -> str:
    pattern = kind.pattern.replace("'", "''")
    return f"""
  select r, {number} as kind, unnest(range(1, len(m) + 1)) as n, unnest(m) as match, unnest(v) as value, unnest(g[:len(m)]) as gap,
         unnest(g[2:]) as next
  from (select r, regexp_extract_all(body, '{pattern}', 0) as m, regexp_extract_all(body, '{pattern}', {kind.value}) as v,
               regexp_split_to_array(body, '{pattern}') as g from texts where regexp_matches(body, '{pattern}'))"""


SECRETS_SQL = f"""
with texts as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as body from documents),
found as ({' union all '.join(_sql_kind(number, kind) for number, kind in enumerate(secrets.KINDS))}),
placed as (
  select *, sum(length(gap) + length(match)) over (partition by r, kind order by n)::bigint as "end" from found),
held as (
  select r, doc_id, source, sha256(body) as digest, "right"(gap, {secrets.CONTEXT}) as before, "left"(next, {secrets.CONTEXT}) as after, kind, "end" - length(match) as start, "end", sha256(value) as hash,
         len(list_distinct(regexp_extract_all(value, '.', 0))) >= 6
           and not regexp_matches(value, '(?i)example|changeme|placeholder|dummy|sample|your|xxxx|\\*\\*\\*\\*') as looks_live
  from placed join texts using (r)
  where length(value) >= case kind when 0 then 6 else 1 end
    and (kind <> 4 or regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]'))),
per_text as (
  select hash, digest, min(before) as before, min(after) as after, min(source) as owner from held group by hash, digest),
per_use as (
  select hash, 'before' as side, before as near, min(owner) as owner from per_text group by hash, before
  union all select hash, 'after', after, min(owner) from per_text group by hash, after),
shared as (
  select hash, min(owners) as owners
  from (select hash, side, count(distinct coalesce('=' || owner, 'null')) as owners from per_use group by hash, side) group by hash),
allowed as (
  select greatest({secrets.MAX_OWNERS}, length(bin(count(distinct coalesce('=' || source, 'null')))) - 1) as most from texts),
judged as (
  select *, case when owners > most then 'copied' when looks_live then 'live' else 'weak' end as status
  from held join shared using (hash), allowed),
kept as (
  select *, concat(['assign', 'access', 'hex', 'vendor', 'opaque'][kind + 1], ':', start, ':', "end") as span
  from judged where kind < 3 or status = 'live'),
each as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans,
         count(*) filter (status = 'live') as n_live, count(*) filter (status = 'copied') as n_copied
  from kept group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from texts left join each using (r)"""


@query("op4_secret_scans", SECRETS_SQL)
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(kind.name) for kind in secrets.KINDS])
    base = [number for number, kind in enumerate(secrets.KINDS) if kind.base]
    spans = F.col("spans")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(spans, test)).cast("long")

    def of_kind(number: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == number

    return found.select(
        "doc_id", *[count(of_kind(number)).alias(f"n_{secrets.KINDS[number].name}") for number in base],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"), count(lambda s: s["status"] == "live").alias("n_live"),
        count(lambda s: s["status"] == "copied").alias("n_copied"))


@query("op7_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighed(table(spark, sf_dir, "documents"))


@query("op5_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.trained(docs))


@query("op3_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detected(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(name) for name in pii.KINDS])
    spans = F.col("spans")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def of_kind(number: int) -> Callable[[Column], Column]:
        return lambda s: s["base"] & (s["kind"] == number)

    base = F.filter(spans, lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(F.filter(spans, of_kind(number))).cast("long").alias(f"n_{pii.KINDS[number]}") for number in range(pii.BASE_KINDS)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_added"))


LEXICAL_SQL = r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
asked as (
  select distinct item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where item_id is not null),
corpus as (
  select count(*) filter (len(ts) > 0)::bigint as n_docs, sum(len(ts))::bigint as n_terms from texts),
held as (
  select r, term, count(*)::bigint as tf from (select r, unnest(ts) as term from texts) group by r, term),
weighted as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * coalesce(df, 0) + 1)))::bigint as w
  from (select distinct term from asked) left join (select term, count(*)::bigint as df from held group by term) using (term), corpus),
sized as (
  select r, doc_id, 100 - 90 + ((90 * len(ts)::bigint * n_docs) // n_terms) as m from texts, corpus where len(ts) > 0),
scored as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weighted using (term) join held using (term) join sized using (r) group by item_id, r, doc_id),
placed as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 10"""


@query("op11_lexical_search", LEXICAL_SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


@query("op12_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
