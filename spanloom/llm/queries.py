"""Queries of this package for ``__spark_entry__``: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, bpe, chat, crf_language, decontaminate, filter_audit, jaccard_join, quality, quality_rules, secrets, token_files, warc, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark, sf_dir):
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    return quality.graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    return crf_language.languages(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    return backoff_lm.backoff_scores(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op8_chat_formatting(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "select cast(-7 as bigint) as conv_id, cast({} as bigint) as turn, '{}' as role, '</s>[INST] ok [/INST]' as text"
    more = spark.sql(" union all ".join(odd.format(k, role) for k, role in enumerate(("user", "assistant"))))
    return chat.chat_digests(conversations.unionByName(more))


def op9_warc(spark, sf_dir):
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark, sf_dir):
    return yinyang.centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_token_files(spark, sf_dir):
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"))


_OPERATORS = (op1_secret_scans, op2_bpe, op3_decontamination, op4_jaccard_join, op5_quality_classifier, op6_language_id, op7_lm_scoring, op8_chat_formatting, op9_warc, op10_quality_rules, op11_filter_audit, op12_centroid_clustering, op13_token_files)
QUERIES = {f.__name__: f for f in _OPERATORS}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+')"
_PLAIN = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assignment and floored means, one after the other, by plain nearest centroids."""
    near = """select vec_id, n, v, c, d from (select v.vec_id, v.n, v.v, c.c, list_sum(list_transform(generate_series(1, 64), lambda i: (v.v[i] - c.m[i]) * (v.v[i] - c.m[i]))) as d,
 row_number() over (partition by v.n order by list_sum(list_transform(generate_series(1, 64), lambda i: (v.v[i] - c.m[i]) * (v.v[i] - c.m[i]))), c.c) as place from v, {} c) where place = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({near.format(f'c{r}')})")
        steps.append(f"s{r} as materialized (select c, list(m order by i) as m from (select c, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) as bigint) as m from (select c, generate_subscripts(v, 1) as i, unnest(v) as x from a{r}) group by c, i) group by c)")
        steps.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(s{r}.m, c{r}.m) as m from c{r} left join s{r} on s{r}.c = c{r}.c)")
    return f"""with v as materialized (select vec_id, row_number() over () as n, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
 c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, v as m from v qualify row_number() over (order by sha256('3:' || vec_id)) <= {k}),
 {", ".join(steps)}, z as materialized ({near.format(f"c{rounds}")})
 select vec_id, cast(z.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by z.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.m, ',')) as centroid_sha256
 from z join c{rounds} on c{rounds}.c = z.c"""


#: DuckDB text for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_decontamination": f"""with w as (select doc_id, {_PLAIN} as w from documents),
 b as (select item_id, {_PLAIN} as w from benchmark),
 bw as (select distinct item_id, least(13, len(w)) as l, list_slice(w, i, i + least(13, len(w)) - 1) as g from (select item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0)),
 ls as (select distinct l from bw),
 dw as (select doc_id, l, i, list_slice(w, i, i + l - 1) as g from (select doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) as i from w, ls)),
 h as (select dw.doc_id, dw.l, dw.i, bw.item_id from dw join bw on dw.g = bw.g and dw.l = bw.l),
 hw as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + l - 1)) as p from h) group by doc_id),
 it as (select doc_id, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by doc_id)
 select w.doc_id, cast(len(w) as bigint) as n_words, coalesce(hw.n, 0) as n_hit, coalesce(it.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hw.n, 0) > 0 and 20 * coalesce(hw.n, 0) >= len(w) as contaminated
 from w left join hw on hw.doc_id = w.doc_id left join it on it.doc_id = w.doc_id""",
    "op4_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
 s as (select distinct doc_id, g from (select doc_id, list_slice(w, i, i + least(5, len(w)) - 1) as g from (select doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) as i from w where len(w) > 0))),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 links as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.i >= 80 * (x.n + y.n - p.i)),
 r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join links l on l.a = r.b),
 c as (select a as doc_id, min(b) as component_id from r group by a)
 select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id from w left join n on n.doc_id = w.doc_id join c on c.doc_id = w.doc_id""",
    "op7_lm_scoring": f"""with w as (select doc_id, {_WORDS} as w from documents),
 t as (select doc_id, i, w[i] as word, case when i > 1 then w[i - 1] || ' ' || w[i] end as two from (select doc_id, w, unnest(generate_series(1, len(w))) as i from w)),
 g as (select doc_id, word as g from t union all select doc_id, two from t where two is not null),
 own as (select doc_id, g, count(*) as c from g group by 1, 2), allc as (select g, sum(c) as c from own group by g),
 els as (select own.doc_id, own.g, allc.c - own.c as c from own join allc on allc.g = own.g),
 n as (select (select count(*) from t) as n), size as (select doc_id, count(*) as d from t group by doc_id),
 x as (select t.doc_id, t.i, ln(greatest(u.c, 1) / greatest(n.n - size.d, 1)) as l1, b.c as c2, bu.c as ctx2
  from t cross join n join size on size.doc_id = t.doc_id join els u on u.doc_id = t.doc_id and u.g = t.word
  left join els b on b.doc_id = t.doc_id and b.g = t.two left join els bu on bu.doc_id = t.doc_id and bu.g = split_part(t.two, ' ', 1)),
 m as (select doc_id, count(*) as n, sum(case when i = 1 then l1 when c2 > 0 then ln(c2 / ctx2) else l1 + ln(0.4) end) as s from x group by doc_id)
 select w.doc_id, coalesce(m.n, 0) as n_words, round(m.s / m.n, 6) as score from w left join m on m.doc_id = w.doc_id""",
    "op8_chat_formatting": """with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
 select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(23 + length(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) as bigint) as formatted_chars
 from c group by conv_id""",
    "op9_warc": """with p as (select page_id, coalesce(html, '') as h from pages), f as (select page_id, h, case when strlen(h) >= 100 then min(page_id) over (partition by h) else page_id end as first from p)
 select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f""",
    "op11_filter_audit": r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 first as (select t, min(doc_id) as id from d group by t), l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
 f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, concat(case when len(w) < 200 then 'A' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' end,
  case when 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 3 * length(d.t) then 'C' end, case when regexp_matches(d.t, '[#$%&*|]') then 'D' end, case when d.doc_id > first.id then 'E' end) as x
  from d join first on first.t = d.t left join l on l.doc_id = d.doc_id),
 g as (select part, x, good, toxic, count(*) as n from f group by all),
 one as (select unnest(['A', 'B', 'C', 'D', 'E']) as y),
 o as (select a.y || b.y || c.y || d.y || e.y as filter_order from one a, one b, one c, one d, one e where b.y <> a.y and c.y not in (a.y, b.y) and d.y not in (a.y, b.y, c.y) and e.y not in (a.y, b.y, c.y, d.y)),
 s as (select filter_order, step, substr(filter_order, step, 1) as y, substr(filter_order, 1, step - 1) as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
 r as (select part, filter_order, cast(step as integer) as step, y, sum(n * here) as removed, sum(n * (fails - here)) as redundant, sum(n) - sum(n * least(1, fails + early)) as kept,
  sum(case when x = y then n else 0 end) as unique_fails, sum(n * here * good) as good_lost, sum(n * here * toxic) as toxic_lost
  from (select *, fails * (1 - early) as here from (select g.*, s.*, case when contains(x, y) then 1 else 0 end as fails, case when len(translate(x, before, '')) < len(x) then 1 else 0 end as early from g, s)) group by all)
 select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
 cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, y) as bigint) as shapley from r""",
    "op12_centroid_clustering": _clusters_sql(),
}
