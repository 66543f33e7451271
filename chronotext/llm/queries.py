"""The registered queries with their production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .balanced_packing import pack_balanced, pieces_of
from .common import table
from .decontamination import find_leaks
from .fingerprints import fingerprint_documents
from .jaccard import jaccard_components
from .packing import digest_columns as packed_digests
from .packing import pack_documents
from .phrases import mine_phrases
from .pieces import digest_columns as piece_digests
from .pieces import encode_documents
from .resampling import resample
from .secrets import digest_columns, scan_secrets
from .substrings import digest_columns as repeat_digests
from .substrings import remove_repeats
from .toxicity import fit_toxicity, score_documents
from .url_filters import judge_urls
from .vector_codes import compress
from .vector_codes import digest_columns as code_digests

TOKENIZERS = "/opt/tokenizers"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(remove_repeats(table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn sample alone."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan_secrets(table(spark, sf_dir, "documents"), owner_col="source", repo_cols=["source", "lang"]))


def op7_token_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return packed_digests(pack_documents(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.tiktoken"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    model = f"{tokenizers}/piece_bpe_32k.model"
    return piece_digests(encode_documents(table(spark, sf_dir, "documents"), model, dropout=0.1, seed=1), model)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n_words=4, p=85, q=100)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(compress(table(spark, sf_dir, "embeddings")))


def op13_cost_balanced_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Ids by the rank file of the same vocabulary, equal to those of ``byte_bpe_50k.json``."""
    return pieces_of(pack_balanced(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.tiktoken"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_url_filters": op1_url_filters,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_secret_scans": op6_secret_scans,
    "op7_token_packing": op7_token_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_vector_code_compression": op12_vector_code_compression,
    "op13_cost_balanced_packing": op13_cost_balanced_packing,
}


def _lloyd_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Assignments and codebooks of every round as one query each."""
    assign = """
a{i} as materialized (select k, j, min(struct_pack(d := d, e := e)) as best from (
  select p.k, p.j, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts p join c{i} c using (j)) group by k, j)"""
    update = """
s{i} as materialized (select j, e, list(s order by pos) as x from (
  select j, e, pos, cast((s - ((s % n) + n) % n) // n as bigint) as s from (
    select a.j, a.best.e as e, u.pos, sum(p.x[u.pos]) as s, count(*) as n from a{i} a join parts p using (k, j), unnest(range(1, len(p.x) + 1)) as u(pos) group by all)) group by j, e),
c{n} as materialized (select c.j, c.e, coalesce(s.x, c.x) as x from c{i} c left join s{i} s using (j, e))"""
    steps = ",".join((assign + "," + update).format(i=i, n=i + 1) for i in range(rounds)) + "," + assign.format(i=rounds)
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id nulls last, embedding) as k, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select k, j, x[j * (len(x) // {parts}) + 1 : (j + 1) * (len(x) // {parts})] as x from kept, unnest(range(0, {parts})) as u(j)),
c0 as materialized (select j, k - 1 as e, x from parts where k <= {entries}),{steps},
books as (select sha256(string_agg(array_to_string(x, ','), ',' order by j, e)) as codebooks_sha256 from c{rounds}),
coded as (select k, string_agg(printf('%02x', best.e), '' order by j) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by k)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join kept using (k), books
"""


ORACLE = {
    "op12_vector_code_compression": _lloyd_sql(),
    "op11_phrase_collocations": r"""
with pieces as materialized (
  select coalesce(lang, 'und') as lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from (
    select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)),
totals as materialized (select lang, sum(len(w)) as n from pieces group by lang),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as g from pieces, unnest(range(1, 6)) as u(k), unnest(range(1, len(w) - k + 2)) as v(i)),
f as materialized (select lang, k, g, count(*) as a from grams group by all having count(*) >= 100),
inner_parts as (
  select distinct lang, array_to_string(w[i : i + m - 1], ' ') as g, a from (select lang, k, a, string_split(g, ' ') as w from f where k > 2),
    unnest(range(2, k)) as u(m), unnest(range(1, k - m + 2)) as v(i)),
kept as materialized (select lang, k, g, a, string_split(g, ' ') as w from f where k > 1 and not exists (select 1 from inner_parts p where p.lang = f.lang and p.g = f.g and p.a >= f.a)),
cuts as (
  select c.lang, c.g, c.a, j, x.a as l, y.a as r, t.n, cast(1000 * cast(c.a as hugeint) * t.n // (cast(x.a as hugeint) * y.a) as bigint) as score
  from (select *, unnest(range(1, k)) as j from kept) c join totals t using (lang)
  join f x on x.lang = c.lang and x.g = array_to_string(c.w[1 : j], ' ') join f y on y.lang = c.lang and y.g = array_to_string(c.w[j + 1 :], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, g) as rank, g as phrase, a, l, r, cast(n as bigint) as n, score
from best qualify rank <= 2000
""",
    "op3_substring_dedup": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
least as (select x, min(doc_id) as d from win group by x having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from win join least using (x) where d < doc_id),
g as (select doc_id, list(j) as js, count(*) as n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(js, i)) end, ' ')) as kept_sha256
from w left join g using (doc_id)
""",
    "op9_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) end as g from w),
e as (select doc_id, len(g) as n, unnest(g) as g from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select s.doc_id, cast(len(g) as bigint) as n_shingles, c.component_id
from s join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
""",
    "op1_url_filters": r"""
with parts as (
  select page_id, coalesce(case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end, '') as host,
    coalesce(case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) end, '') as path
  from pages),
rules(rhost, rpath, rverdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked as (
  select page_id, host, path, rhost || rpath as rule, rverdict,
    row_number() over (partition by page_id order by length(rhost || rpath) desc, length(rhost) desc) as rn
  from parts left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from ranked where rn = 1
""",
}
