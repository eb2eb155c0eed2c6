"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express.

opN_<name> are the operators' whole results. SQL can't express the verdicts of models, encodings and containers; for operators where it
can express the other columns, a query of its own selects those through the same operator.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .collocations import collocations
from .filter_audit import audit_filters
from .html_text import extract_pages
from .mixing import document_targets, mix_sources
from .near_dedup import near_duplicates
from .quality import quality_verdicts
from .sentence_pieces import encode_pieces, load
from .sharding import assign_shards
from .simhash import simhash_duplicates
from .token_counts import token_counts
from .toxicity import toxicity
from .transport_stream import media_digests
from .url_filter import url_rules, url_verdicts

#: The public tokenizers' folder; a parameter of the deployment.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, size=5)


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_table(spark, sf_dir, "documents"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), load(f"{TOKENIZERS}/piece_bpe_32k.model"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), shards=16)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=30, top=2000).drop("n_words")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_table(spark, sf_dir, "documents"), most=4, size=4)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of the stored texts."""
    return op2_transport_streams(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix."""
    return document_targets(_table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 3))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule statistics and the base rule."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and what the rules decide; verdict is null where none fits."""
    return url_rules(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards before and after one more is appended."""
    return op9_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "grown_shard")


QUERIES = [
    op1_minhash_near_dedup, op2_transport_streams, op3_entropy_mixing, op4_quality_rules, op5_token_counts, op6_toxicity, op7_url_filter, op8_sentence_pieces, op9_sharding, op10_html_text,
    op11_collocations, op12_filter_audit, op13_simhash_near_dedup, media_payloads, mixing_targets, quality_statistics, host_rules, shard_law,
]

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

#: Links are found on shared shingles of distinct sets: sets of equal shingles are one class first.
SQL["op1_minhash_near_dedup"] = f"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
 sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
 named as (select doc_id, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as class, s from sets),
 classes as (select class, min(doc_id) as rep, any_value(n) as n, any_value(s) as s from named where n > 0 and doc_id is not null group by class),
 tokens as (select rep, n, class, hash(unnest(s)) as t from classes),
 pairs as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as common from tokens a join tokens b on a.t = b.t and a.class < b.class and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
 links as (select a, b from pairs where 100 * common >= 85 * (na + nb - common)),
 both_ways as (select a, b from links union select b, a from links union select x.doc_id, c.rep from named x join classes c using (class) where x.doc_id is not null union select c.rep, x.doc_id from named x join classes c using (class) where x.doc_id is not null),
 reach(doc_id, other) as (select a, a from both_ways union select r.doc_id, b.b from reach r join both_ways b on b.a = r.other),
 component as (select doc_id, min(other) as component_id from reach group by doc_id)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(c.component_id, n.doc_id) as component_id, coalesce(n.doc_id = coalesce(c.component_id, n.doc_id), true) as kept from named n left join component c on c.doc_id = n.doc_id"""

#: Every occurrence of every phrase is listed, then counted; products are 128 bits wide.
SQL["op11_collocations"] = rf"""
with p as (select row_number() over () as k, lang, piece from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents)),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
 total as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
 g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from w, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m)),
 f as (select lang, m, phrase, count(*) as f from g group by all having count(*) >= 30),
 cand as (select *, string_split(phrase, ' ') as w from f where m > 1),
 cuts as (select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f) // (l.f::hugeint + r.f) as score
  from (select *, unnest(generate_series(1, m - 1)) as k from cand) c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
 best as (select lang, phrase, any_value(a) as a, min(struct_pack(score := score, k := k, l := l, r := r)) as b from cuts group by lang, phrase),
 inner_ as (select lang, f, array_to_string(w[i:i + j - 1], ' ') as phrase from (select lang, f, w, m, j, unnest(generate_series(1, m - j + 1)) as i from (select *, unnest(generate_series(2, m - 1)) as j from cand where m > 2))),
 gone as (select distinct b.lang, b.phrase from best b join inner_ i on i.lang = b.lang and i.phrase = b.phrase and 100 * i.f::hugeint >= 80 * b.a::hugeint),
 ranked as (select lang, phrase, a, b.l as l, b.r as r, cast(b.score as bigint) as score, row_number() over (partition by lang order by b.score desc, a desc, encode(phrase)) as rank from best anti join gone using (lang, phrase))
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, score from ranked join total using (lang) where rank <= 2000"""

#: A document's first failing step in an order is where it is removed.
SQL["op12_filter_audit"] = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
 flags as (select k, doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(min(doc_id) over (partition by text) < doc_id, false)] as f from d),
 marks as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
 cell as (select part, f, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from flags left join marks using (doc_id) group by part, f),
 l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
 o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 hit as (select part, filter_order, n, good, toxic, list_transform(string_split(filter_order, ''), lambda x: f[unicode(x) - 64]) as h, len(list_filter(f, lambda x: x)) as fails from cell, o),
 steps as (select part, filter_order, step, filter_order[step] as x, n, good, toxic, h[step] as fails_here, len(list_filter(h[:step - 1], lambda x: x)) > 0 as gone, fails from hit, (select unnest([1, 2, 3, 4, 5]) as step)),
 sums as (select part, filter_order, step, x, sum(case when not gone and not fails_here then n else 0 end) as kept, sum(case when not gone and fails_here then n else 0 end) as removed, sum(case when gone and fails_here then n else 0 end) as redundant,
  sum(case when fails_here and fails = 1 then n else 0 end) as unique_fails, sum(case when not gone and fails_here then good else 0 end) as good_lost, sum(case when not gone and fails_here then toxic else 0 end) as toxic_lost from steps group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
 cast(sum(removed) over (partition by part, x) as bigint) as shapley from sums"""

SQL["media_payloads"] = """select doc_id, n as n_bytes, p as payload_bytes, sha256(encode(coalesce(text, '')) || from_hex(repeat('00', cast(p - n as int)))) as payload_sha256
 from (select doc_id, text, cast(strlen(coalesce(text, '')) as bigint) as n, greatest(64, cast(ceil(strlen(coalesce(text, '')) / 64) as bigint) * 64) as p from documents)"""

#: The water level is the largest of those that each number of stopped sources would need.
SQL["mixing_targets"] = f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size from documents),
 s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, encode(source)) as place from d group by source),
 w as (select *, ([5, 2, 1])[(place - 1) % 3 + 1] as w, 3.0::double * source_size as full_ from s),
 l as (select *, (sum(source_size) over () - coalesce(sum(full_) over (order by full_ / w, place rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by full_ / w, place rows between current row and unbounded following) as needed from w),
 t as (select source, source_size, least(w * max(needed) over (), full_) as target from l)
select doc_id, size, source_size, round(target, 3) as target from d join t on d.source is not distinct from t.source"""

SQL["quality_statistics"] = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
 w as (select k, doc_id, text, regexp_extract_all(text, '{_WORD}') as w from d),
 g as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select k, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) > 2)),
 r as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from (select k, i, count(*) over (partition by k, g) as c from g) where c > 1) group by k),
 l as (select k, sum(c - 1) as n from (select k, x, count(*) as c from (select k, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by k, x) group by k)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
 cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words, len(w) < 50 or 100 * coalesce(r.n, 0) > 50 * len(w) as base_failed
from w left join l on l.k = w.k left join r on r.k = w.k"""

SQL["host_rules"] = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
 p as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
 rules(h, s, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
 f as (select p.page_id, p.host, p.path, arg_max(h || s, length(h || s)) as rule, arg_max(v, length(h || s)) as verdict from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by all)
select p.page_id, p.host, p.path, any_value(f.rule) as rule, any_value(f.verdict) as verdict from (select row_number() over () as k, * from p) p left join f on f.page_id is not distinct from p.page_id and f.host = p.host and f.path = p.path group by p.k, p.page_id, p.host, p.path"""


def _jump(shards: int) -> str:
    return f"""select k, b as shard from (select k, b, row_number() over (partition by k order by b desc) as n from jumps where b < {shards}) where n = 1"""


#: Keys that still jump step on together; 128-bit arithmetic stands in for the 64-bit one.
SQL["shard_law"] = f"""
with recursive d as (select row_number() over () as k, doc_id, strlen(coalesce(text, '')) + 1 as size from documents),
 jumps(k, key, b, j) as (select k, case when coalesce(doc_id, -1) < 0 then coalesce(doc_id, -1)::hugeint + 18446744073709551616 else doc_id::hugeint end, -1::bigint, 0::bigint from d
  union all select k, n, j, floor((j + 1) * (2147483648.0::double / ((n // 8589934592)::double + 1)))::bigint from (select k, j, (key * 2862933555777941757 + 1) % 18446744073709551616 as n from jumps where j < 17))
select d.doc_id, cast(d.size as bigint) as size, 'key' as law, cast(a.shard as int) as shard, cast(b.shard as int) as grown_shard from d join ({_jump(16)}) a on a.k = d.k join ({_jump(17)}) b on b.k = d.k"""


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
