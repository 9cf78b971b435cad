"""The queries of this subpackage over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, languages, merkle, mixing, ngram_join, pii, quality_rules, repeats, revisits, sentence_pieces, token_files, topk, url_filter
from .common import LOWER, UPPER, table


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "; ")
    return found.withColumn("merged", merged)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_held_out(table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality_rules.judge(table(spark, sf_dir, "documents"))
    return m.select("doc_id", *(f"metrics.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "broken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.listing(pages)).drop("url")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"), plant=True)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_revisits, op2_mixing, op3_token_files, op4_kneser_ney, op5_sentence_pieces, op6_quality_rules, op7_pii, op8_ngram_join, op9_url_filter, op10_topk, op11_languages, op12_repeats, op13_merkle)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_CANONICAL = f"""
case when {_HOST} <> '' then regexp_replace(regexp_replace({_HOST}, ':(80|443)$', ''), '^www\\.', '') || regexp_replace({_PATH}, '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
     lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&'), ''), '') end"""
_LABELS = ", ".join(f"'{x}'" for x in url_filter.LISTED_LABELS)


def _rules(out: str) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    return "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p if out == 'rule' else v}'" for h, p, v in rules) + " end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _up(table: str, tree: str) -> str:
    """Levels over rows (tree, level, idx, h): every eight become their digest while a tree has several."""
    return f"""select * from {table} union all
  select {tree}, level + 1, idx // 8, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over (partition by {tree}) as n from X) where n > 1 group by {tree}, level, idx // 8"""


#: Eight steps of the division by the polynomial, for each byte; then the checksum over the digits of the id.
_CRC = """(select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) order by i) as t from (select unnest(range(256)) as i))"""

ORACLE: dict[str, str] = {
    "op13_merkle": f"""
with recursive crc as {_CRC},
d as (select doc_id, lang, {_leaf("text")} as leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} as low,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as crc from documents, crc),
l as (select *, case when crc % 3 = 0 then low else leaf end as tested, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx from d),
base as (select lang as tree, 0 as level, idx, leaf as h from l),
lv as ({_up("base", "tree").replace("X", "lv")}),
tops as (select tree, arg_max(h, level) as h from lv group by tree),
seat as (select tree, row_number() over (order by tree nulls first) - 1 as seat, h from tops),
base2 as (select 0 as tree, 0 as level, seat as idx, h from seat),
tv as ({_up("base2", "tree").replace("X", "tv")}),
root as (select arg_max(h, level) as root from tv),
-- one row a leaf and level: the leaf's own node is left out of its run
path as (select l.doc_id, l.leaf, l.tested, l.lang, l.idx, s.seat, s.h as subroot from l join seat s on l.lang is not distinct from s.tree),
runs as (select tree, level, idx // 8 as run, list(h order by idx) as hs from lv group by all having true),
multi as (select r.* from runs r join (select tree, level from lv group by all having count(*) > 1) m on r.tree is not distinct from m.tree and r.level = m.level),
truns as (select level, idx // 8 as run, list(h order by idx) as hs from tv group by all),
tmulti as (select r.* from truns r join (select level from tv group by all having count(*) > 1) m on r.level = m.level),
steps as (
  select p.doc_id, p.leaf, p.idx, p.lang, m.level as step, m.hs, ((p.idx // (8 ** m.level)::bigint) % 8)::bigint as place from path p join multi m on p.lang is not distinct from m.tree and m.run = p.idx // (8 ** (m.level + 1))::bigint
  union all
  select p.doc_id, p.leaf, p.idx, p.lang, 1000 + m.level, m.hs, ((p.seat // (8 ** m.level)::bigint) % 8)::bigint from path p join tmulti m on m.run = p.seat // (8 ** (m.level + 1))::bigint),
way as (select lang, idx, list({{hs: hs, place: place}} order by step) as way from steps group by all),
f as (select p.*, coalesce(way, []) as way from path p left join way w on p.lang is not distinct from w.lang and p.idx = w.idx),
g as (select doc_id, leaf, subroot, sha256(array_to_string(flatten(list_transform(way, lambda x: list_concat(x.hs[: x.place], x.hs[x.place + 2 :]))), '')) as proof_sha256,
  list_reduce(list_prepend({{hs: [tested], place: 0::bigint}}, way), lambda a, x: {{hs: [sha256(array_to_string(list_concat(x.hs[: x.place], a.hs, x.hs[x.place + 2 :]), ''))], place: 0::bigint}}).hs[1] as folded_root from f)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from g, root""",
    "op1_revisits": rf"""
with k as (select *, unnest(range(0, (page_id % 5) + 1)) as k from pages),
a as (select (page_id * 8 + k)::bigint as record_id, url, page_id as p, k, (1600000000 + (page_id * 977) % 5000000 + k * 40000)::bigint as ts, sha1(coalesce(html, '')) as sha, octet_length(encode(coalesce(html, '')))::bigint as bytes,
  (k = 0 and page_id % 11 <> 4) or (k = 3 and page_id % 2 = 0) as is_full from k),
b as (select *, case when is_full then 200 when k = 0 then 404 else 304 end as status, '"' || substr(sha, 1, 12) || case when k in (3, 4) and p % 2 = 0 then '-2' else '' end || '"' as own, {_CANONICAL} as canonical from a),
c as (select *, case when status = 304 and p % 13 in (6, 7) then null when status = 304 and p % 7 = 3 then '"stale"' when status = 304 and p % 7 = 5 then 'W/' || own else own end as etag,
  case when status = 304 and p % 13 = 7 then null else 'day ' || (p % 1000) end as modified from b),
d as (select r.record_id, r.canonical, r.ts, r.etag, r.modified, f.record_id as response_id, f.ts as response_ts, f.sha as digest, f.bytes as n_bytes, f.etag as f_etag, f.modified as f_modified,
  row_number() over (partition by r.record_id order by f.ts desc, f.record_id desc) as rn
  from c r left join c f on f.is_full and f.canonical = r.canonical and (f.ts < r.ts or f.ts = r.ts and f.record_id < r.record_id) where r.status = 304),
e as (select *, case when response_id is null then 'unmatched' when etag is not null then case when regexp_replace(etag, '^W/', '') is not distinct from regexp_replace(f_etag, '^W/', '') then 'resolved' else 'mismatch' end
  when modified is not null then case when modified is not distinct from f_modified then 'resolved' else 'mismatch' end else 'unchecked' end as verdict from d where rn = 1)
select record_id, canonical, ts, response_id, response_ts, digest, n_bytes, verdict, case when verdict = 'resolved' then
  'content-length=' || n_bytes || '; content-type=text/html; date=' || ts || '; etag=' || coalesce(etag, f_etag) || '; last-modified=' || coalesce(modified, f_modified) end as merged from e""",
    "op2_mixing": rf"""
with d as (select doc_id, source, {_WORDS} as w from documents),
s as (select doc_id, source, len(w)::bigint as size,
  -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/17'), 1, 12))::bigint + 0.5) / 281474976710656.0) / (case when len(w) > 0 then len(list_distinct(w)) / len(w) else 0 end + 0.1) as key from d),
p as (select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from s group by source),
r as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as ratio, sum(source_size) over () * 1.5::double as total from p),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
t as (select source, source_size, round(least(cap, coalesce((select arg_min(level, ratio) from l where ratio >= level), ratio) * weight), 6) as target from l),
b as (select *, case when source_size > 0 then floor(round(target) / source_size)::bigint else 0 end as epochs from t),
x as (select s.*, b.source_size, b.target, b.epochs, round(b.target)::bigint - b.epochs * b.source_size as rest_budget,
  coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from s join b on s.source is not distinct from b.source)
select doc_id, source, size, source_size, target, epochs::bigint as epochs, greatest(0, least(size, rest_budget - before))::bigint as rest,
  (epochs * size + greatest(0, least(size, rest_budget - before)))::bigint as taken from x""",
    "op6_quality_rules": rf"""
with a as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
b as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as ls,
  list_sort(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: {{g: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], i: i}})) as g from a),
c as (select *, list_filter(g, lambda x, i: (i < len(g) and x.g = g[i + 1].g) or (i > 1 and x.g = g[i - 1].g)) as rep from b),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  len(list_distinct(flatten(list_transform(rep, lambda x: [x.i, x.i + 1, x.i + 2]))))::bigint as n_repeat_words, len(ls) as n_lines,
  length(regexp_replace(t, '[^A-Z]+', '', 'g')) as up, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) as letters,
  len(list_filter(w, lambda x: list_contains([{', '.join(f"'{x}'" for x in quality_rules.STOP_WORDS)}], lower(rtrim(x, '.,;:!?'))))) as stops,
  len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) as bullets, len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) as dots from c),
r as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, list_filter([
  case when n_words < 50 then 'too_short' end, case when n_words > 1000000 then 'too_long' end,
  case when n_words = 0 or word_chars / n_words < 2 or word_chars / n_words > 15 then 'word_length' end,
  case when n_words > 0 and n_symbols / n_words > 0.2 then 'symbols' end, case when letters > 0 and up / letters > 0.5 then 'shouting' end,
  case when n_words = 0 or stops / n_words < 0.02 then 'stop_words' end, case when n_lines > 0 and n_dup_lines / n_lines > 0.5 then 'duplicate_lines' end,
  case when n_lines > 0 and bullets / n_lines > 0.9 then 'bullet_lines' end, case when n_lines > 0 and dots / n_lines > 0.5 then 'ellipsis_lines' end], lambda x: x is not null) as broken from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(broken) = 0 as kept, broken from r""",
    "op10_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from r where rank <= 20""",
    "op9_url_filter": rf"""
with a as (select page_id, {_HOST} as host, {_PATH} as path, {_CANONICAL} as canon from pages),
l as (select distinct canon from a where canon is not null and list_has_any(string_split(host, '.'), [{_LABELS}]))
select page_id, host, path, canon is not null and canon in (select canon from l) as listed, {_rules("rule")} as rule,
  coalesce({_rules("verdict")}, case when canon is not null and canon in (select canon from l) then 'block' else 'allow' end) as verdict from a""",
}
