"""The driver's queries on whole tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, embedding_dedup, line_dedup, order_minhash, pii, secret_scan, token_counts, toxicity, url_filter

#: The rules and the listed hosts of ``op1_url_filter``.
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
BLOCKED_HOSTS = [
    "casino-win.example.com",
    "free-bets.example.com",
    "cheap-pills.example.com",
    "spam-farm.example.com",
    "ads-track.example.com",
    "adult-x.example.net",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, BLOCKED_HOSTS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    thinned = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return thinned.select("doc_id", "n_lines", "n_kept", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_order_minhash": op4_order_minhash,
        "op5_line_dedup": op5_line_dedup,
        "op6_secrets": op6_secrets,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_bpe": op8_bpe,
        "op9_token_counts": op9_token_counts,
        "op10_pii": op10_pii,
    }


_OP1_SQL = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), r(verdict, h, x) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), b(h) as (
  values ('casino-win.example.com'), ('free-bets.example.com'), ('cheap-pills.example.com'), ('spam-farm.example.com'), ('ads-track.example.com'), ('adult-x.example.net')
), j as (
  select page_id, host, path,
         (select r.h || r.x from r where (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.x) order by length(r.h || r.x) desc limit 1) as rule,
         exists (select 1 from b where host = b.h or ends_with(host, '.' || b.h)) as listed_host
  from p
)
select page_id, host, path, rule,
       case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' when listed_host then 'block' else 'allow' end as verdict,
       listed_host
from j
"""


def _op6_sql() -> str:
    """Places as sums of lengths of the pieces between matches, as in the operator."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    kinds, spans = [], []
    for n, k in enumerate(secret_scan.KINDS):
        p = q(k.pattern)
        kinds.append(f"regexp_extract_all(t, {p}, 0) as m{n}, regexp_extract_all(t, {p}, {k.group}) as v{n}, string_split_regex(t, {p}) as b{n}")
        upto = f"list_sum(list_transform(b{n}[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{n}[:i - 1], lambda x: length(x))), 0)"
        spans.append(f"list_filter(list_transform(range(1, len(m{n}) + 1), lambda i: {{'start': {upto}, 'ord': {n}, 'size': length(m{n}[i]), 'kind': '{k.name}', 'value': v{n}[i]}}), lambda x: length(x.value) >= {k.least})")
    show = lambda a: f"list_aggregate(list_transform({a}, lambda x: x.kind || ':' || x.start::bigint || ':' || (x.start + x.size)::bigint), 'string_agg', ',')"
    every = " || ".join(spans)
    base = f"list_filter(s, lambda x: x.ord < {len(secret_scan.BASE)})"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.kind = '{k.name}'))::bigint as n_{k.name}" for k in secret_scan.BASE)
    return f"""
with d as (select row_number() over () as rn, doc_id, source, coalesce(text, '') as t from documents),
m as (select rn, doc_id, source, {", ".join(kinds)} from d),
f as (select rn, doc_id, source, list_sort({every}) as s from m),
e as (select rn, doc_id, source, unnest(list_transform(s, lambda x: x.value)) as value from f),
o as (select value, count(distinct coalesce(source, '')) as owners, count(distinct coalesce(source, '') || ':' || coalesce(doc_id::varchar, '')) as repos from e group by 1),
w as (select rn, max(owners) as n_owners, max(repos) as n_repos, count(*) filter (where owners >= {secret_scan.WIDE_OWNERS} or repos >= {secret_scan.WIDE_REPOS} or regexp_matches(lower(value), {q(secret_scan.PLACEHOLDER)})) as n_shared,
             count(*) filter (where not (owners >= {secret_scan.WIDE_OWNERS} or repos >= {secret_scan.WIDE_REPOS} or regexp_matches(lower(value), {q(secret_scan.PLACEHOLDER)}))) as n_owner_specific
      from e join o using (value) group by 1)
select doc_id, {counts}, sha256(coalesce({show(base)}, '')) as base_sha256, coalesce({show("s")}, '') as spans,
       coalesce(n_shared, 0)::bigint as n_shared, coalesce(n_owner_specific, 0)::bigint as n_owner_specific,
       coalesce(n_owners, 0)::bigint as n_owners, coalesce(n_repos, 0)::bigint as n_repos
from f left join w using (rn)
"""


#: Every pair of equal label, and components by reachability.
_OP7_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e, row_number() over () as rn from embeddings
), ok as (
  select * from v where label is not null and vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), l as (
  select a.rn, a.vec_id, b.rn as rn2, b.vec_id as other from ok a join ok b on a.label = b.label and a.rn <> b.rn and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, to_id) as (
  select vec_id, other from l union select r.vec_id, l.other from reach r join l on l.vec_id = r.to_id
), c as (select vec_id, min(to_id) as least from reach group by 1),
n as (select rn, count(*) as n_links from l group by 1)
select v.vec_id, coalesce(n.n_links, 0)::bigint as n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) as kept
from v left join n on n.rn = v.rn left join c on c.vec_id = v.vec_id
"""


# DuckDB's distance counts bytes, so characters of several bytes are looked at one by one.
_SAME = "(levenshtein(a.line, b.line) <= 1 or (levenshtein(a.line, b.line) <= 4 and len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) <= 1))"
_LONGER = "(levenshtein(a.line, b.line) <= 1 or (levenshtein(a.line, b.line) <= 4 and len(list_filter(range(0, a.n + 1), lambda i: left(b.line, i) || substr(b.line, i + 2) = a.line)) > 0))"

#: All pairs of distinct long lines of near length, and classes by reachability.
_OP5_SQL = f"""
with recursive o as (
  select doc_id as id, unnest(range(len(string_split(text, chr(10)))))::int as pos, unnest(string_split(text, chr(10))) as line from documents where doc_id is not null and text is not null
), u as (
  select distinct line, length(line) as n from o where length(line) >= {line_dedup.MIN_CHARS}
), l as (
  select a.line as x, b.line as y from u a join u b on b.n = a.n and a.line <> b.line where (left(a.line, a.n // 2) = left(b.line, a.n // 2) or right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)) and {_SAME}
  union all
  select a.line, b.line from u a join u b on b.n = a.n + 1 where (left(a.line, a.n // 2) = left(b.line, a.n // 2) or right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)) and {_LONGER}
), e as (select x, y from l union select y, x from l),
r(x, z) as (select x, y from e union select r.x, e.y from r join e on e.x = r.z),
c as (select x as line, least(x, min(z)) as root from r group by x),
k as (select o.id, o.pos, coalesce(c.root, o.line) as root, c.line is not null as near, o.line, len(string_split_regex(o.line, '[ \\t\\r\\n]+')) >= {line_dedup.PASSAGE_WORDS} as passage from o left join c using (line) where length(o.line) >= {line_dedup.MIN_CHARS}),
f as (select root, count(distinct id) as docs, min((id, pos)) as first, min(id) as first_id, bool_or(passage) as passage from k group by root),
q as (select distinct k.id, f.first_id from k join f using (root) where f.passage and f.docs between 2 and {line_dedup.MAX_DOCS} and k.id <> f.first_id),
s as (select doc_id as id, string_split_regex(max(text), '[ \\t\\r\\n]+') as w from documents where doc_id in (select id from q union select first_id from q) group by doc_id),
v as (select id, list_distinct(list_transform(range(1, greatest(len(w) - {line_dedup.WINDOW - 1}, 1) + 1), lambda i: w[i:i + {line_dedup.WINDOW - 1}])) as w from s),
y as (select q.id, q.first_id from q join v a on a.id = q.id join v b on b.id = q.first_id where len(list_intersect(a.w, b.w)) >= {line_dedup.SIMILAR} * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
g as (select distinct k.id, k.pos from k join f using (root) where (k.id, k.pos) <> f.first and (f.docs > {line_dedup.MAX_DOCS} or (f.passage and f.docs > 1 and not exists (select 1 from y where y.id = k.id and y.first_id = f.first_id)))),
w as (select o.id, o.pos, o.line, length(o.line) < {line_dedup.MIN_CHARS} or row_number() over (partition by o.id, o.line order by o.pos) = 1 as stays from o anti join g on o.id = g.id and o.pos = g.pos),
t as (select id, count(*) as n_kept, string_agg(line, chr(10) order by pos) as text from w where stays group by id)
select doc_id, coalesce(len(string_split(text_in, chr(10))), 0)::bigint as n_lines, coalesce(n_kept, 0)::bigint as n_kept, coalesce(n_near, 0)::bigint as n_near, sha256(coalesce(out_text, '')) as text_sha256
from (select d.doc_id, d.text as text_in, t.n_kept, t.text as out_text, m.n_near from documents d left join t on t.id = d.doc_id left join (select id, count(*) filter (where near) as n_near from k group by id) m on m.id = d.doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1_SQL, "op5_line_dedup": _OP5_SQL, "op6_secrets": _op6_sql(), "op7_embedding_dedup": _OP7_SQL}
