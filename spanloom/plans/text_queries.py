"""Queries over text, paths, observations, state tables and artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import plugins, registers, state, store
from .derived import Source, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run

    return register


# --- text scans -----------------------------------------------------------------------------------------
@query("op063_secret_shapes", "select doc_id from documents where doc_id % 3 = 0")
def _(s):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    word = F.when(F.col("doc_id") % 3 == 0, h).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(h, 1, 30), F.lit(":"), F.substring(h, 1, 30))).otherwise(F.substring(h, 1, 39))
    return s.table("documents").where(X.secret_shape(word)).select("doc_id")


@query("op064_settings", """select doc_id, concat('{"a":1,"b":{', case when doc_id % 2 = 0 then '' else concat('"k":"', doc_id, '"') end, '},"l":["x"]}') as settings from documents""")
def _(s):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    inner = F.when(F.col("doc_id") % 2 == 0, h).otherwise(F.col("doc_id").cast("string"))
    text = F.concat(F.lit('{"a": 1, "b": {"k": "'), inner, F.lit('"}, "l": ["'), h, F.lit('", "x"], "s": "'), h, F.lit('"}'))
    return s.table("documents").select("doc_id", plugins.settings_without_secrets(text).alias("settings"))


_RED = [
    (r"(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]"),
    (r"\b(?:github_pat_|ghp_|gho_|ghu_|ghs_|ghr_|sk-)[A-Za-z0-9_-]{8,}", "[REDACTED TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED AWS ACCESS KEY]"),
    (r"""(?i)\b(api_?key|api-key|access_?token|access-token|auth_?token|auth-token|password|secret)\b(\s*[:=]\s*["'']?)([^\s"'',;}\]\[]{4,})""", r"\1\2[REDACTED]"),
]


def _redaction_sql() -> str:
    text, hits = "text", []
    for pattern, by in _RED:
        hits.append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"select doc_id, sha({text}) as redacted_sha256, {' + '.join(hits)} as hits from documents"


@query("op067_redaction", _redaction_sql())
def _(s):
    text, hits = X.redacted(F.col("text"))
    return s.table("documents").select("doc_id", X.content_hash(text).alias("redacted_sha256"), hits.alias("hits"))


@query("op229_line_scan", "select doc_id, i as line, l like '%password%' as assigns, l like '%|%' as tables from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where l like '%password%' or l like '%|%'")
def _(s):
    lines = s.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return lines.where(F.col("l").contains("password") | F.col("l").contains("|")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("line"), F.col("l").contains("password").alias("assigns"), F.col("l").contains("|").alias("tables"))


@query("op240_url_path", "select page_id, case when p = '' and url like '%://%' then '/' else p end as path from (select page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') as p from pages)")
def _(s):
    return s.table("pages").select("page_id", X.url_path(F.col("url")).alias("path"))


@query("op241_route_match", "select page_id from (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') as p from pages) where regexp_full_match(p, '/en/[^/]+')")
def _(s):
    return s.table("pages").where(X.route_matches(F.lit("/en/:id"), X.url_path(F.col("url")))).select("page_id")


@query("op242_join_route", "select p_partkey, concat('/', trim(p_brand, '/'), '/', p_size) as route from part")
def _(s):
    return s.table("part").select("p_partkey", X.join_route(F.concat(F.lit("/"), F.trim("p_brand", F.lit("/")), F.lit("/")), F.concat(F.lit("/"), F.col("p_size").cast("string"))).alias("route"))


@query("op243_route_pattern", "select o_orderkey, case when o_orderkey % 2 = 0 then 'GET' else 'ANY' end as method, concat('/o/', o_custkey) as path from orders")
def _(s):
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "GET ").otherwise(""), F.lit("/o/"), F.col("o_custkey").cast("string"))
    method, path = X.route_pattern(text)
    return s.table("orders").select("o_orderkey", method.alias("method"), path.alias("path"))


@query("op244_snake_case", "select distinct p_type, lower(regexp_replace(regexp_replace(replace(p_type, ' ', ''), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as snake from part")
def _(s):
    return s.table("part").select("p_type", X.snake_case(F.replace("p_type", F.lit(" "), F.lit(""))).alias("snake")).distinct()


@query("op245_paths_match", "select c_custkey as k, c_custkey % 4 in (0, 1, 2) as same from customer")
def _(s):
    n, k = (F.col("c_custkey") % 30).cast("string"), F.col("c_custkey") % 4
    source = F.concat(F.lit("src/"), n, F.lit(".ts"))
    # the same, the same with other slashes, longer, shorter
    observed = F.when(k == 0, F.concat(F.lit("./src/"), n, F.lit(".ts"))).when(k == 1, F.concat(F.lit("src\\"), n, F.lit(".ts"))).when(k == 2, F.concat(F.lit("/app/src/"), n, F.lit(".ts"))).otherwise(F.concat(n, F.lit(".ts")))
    return s.table("customer").select(F.col("c_custkey").alias("k"), X.paths_match(observed, source).alias("same"))


@query("op246_normal_path", "select distinct c_custkey % 20 as k, concat('src/', c_custkey % 20) as path from customer")
def _(s):
    n = F.col("c_custkey") % 20
    return s.table("customer").select(n.alias("k"), X.normal_path(F.concat(F.lit("./src/x/../"), n.cast("string"), F.lit("/./"))).alias("path")).distinct()


@query("op247_hash_prefixes", "select doc_id, sha(text) as hash, substr(sha(text), 1, 16) as h16, substr(sha(text), 1, 8) as h8 from documents")
def _(s):
    h = X.content_hash(F.col("text"))
    return s.table("documents").select("doc_id", h.alias("hash"), F.substring(h, 1, 16).alias("h16"), F.substring(h, 1, 8).alias("h8"))


@query("op248_channel_kind", "select event_type, case event_type when 'click' then 'kafka-topic' when 'error' then 'sqs-queue' end as kind, count(*) as n from events group by all")
def _(s):
    system = F.when(F.col("event_type") == "click", "Kafka").when(F.col("event_type") == "error", "AWS_sqs").otherwise(F.concat(F.lit("apache.kafka."), "event_type"))
    return s.table("events").groupBy("event_type", X.channel_kind(system).alias("kind")).agg(F.count("*").alias("n"))


@query("op250_hop_weights", "select conf, case conf when 'Confirmed' then 1.0 when 'InferredStrong' then 0.6 when 'InferredWeak' then 0.3 else 0.0 end as weight, count(*) as n from edges group by all")
def _(s):
    return s.edges.groupBy("conf", X.hop_weight(F.col("conf")).alias("weight")).agg(F.count("*").alias("n"))


@query("op251_mermaid_ids", "select id, concat(regexp_replace(id, '[^A-Za-z0-9]', '_', 'g'), '_', substr(sha(id), 1, 8)) as mermaid from nodes")
def _(s):
    return s.nodes.select("id", X.mermaid_id(F.col("id")).alias("mermaid"))


@query("op251_markdown_safe", "select doc_id, sha(replace(replace(replace(text, '|', '\\|'), chr(10), ' '), chr(13), ' ')) as safe_sha256 from documents where text is not null")
def _(s):
    return s.table("documents").where("text is not null").select("doc_id", X.content_hash(X.markdown_safe(F.col("text"))).alias("safe_sha256"))


@query("op253_first_json_object", """select event_id, concat('{"a": "}", "b": {"c": ', event_id, '}}') as found from events""")
def _(s):
    text = F.concat(F.lit('noise } {"a": "}", "b": {"c": '), F.col("event_id").cast("string"), F.lit("}} {tail"))
    return s.table("events").select("event_id", plugins.json_object_in(text).alias("found"))


@query("op252_byte_spans", "select doc_id, case when position(' de ' in text) > 0 then strlen(left(text, position(' de ' in text) - 1)) else 0 end as byte_start, case when position(' de ' in text) > 0 then strlen(left(text, position(' de ' in text) - 1)) + 4 else strlen(text) end as byte_end from documents where text is not null")
def _(s):
    start, end = X.span_of(F.col("text"), F.lit(" de "))
    return s.table("documents").where("text is not null").select("doc_id", start.cast("bigint").alias("byte_start"), end.cast("bigint").alias("byte_end"))


@query("op254_cost", "select doc_id, round(strlen(text) / 4.0 * 3.0 / 1e6 + 500 * 15.0 / 1e6, 9) as usd from documents where text is not null")
def _(s):
    return s.table("documents").where("text is not null").select("doc_id", F.round(X.est_usd(F.octet_length("text"), 3.0, 15.0), 9).alias("usd"))


@query("op255_edge_identity", "select concat(src, ' ', label, ' ', dst) as identity from edges")
def _(s):
    return s.edges.select(X.edge_identity(F.col("src"), F.col("label"), F.col("dst")).alias("identity"))


@query("op256_typed_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(s):
    return s.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("op257_basis_hash", "select o_custkey as task, sha(string_agg(distinct o_orderpriority, '|' order by o_orderpriority)) as basis_hash from orders group by o_custkey")
def _(s):
    return s.table("orders").groupBy(F.col("o_custkey").alias("task")).agg(X.content_hash(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|")).alias("basis_hash"))


@query("op068_auth_state", "select event_id, case cast(event_id % 6 as int) when 0 then true when 1 then false when 2 then true when 3 then false end as auth from events")
def _(s):
    k = F.col("event_id") % 6
    props = F.when(k == 0, '{"authenticated": true, "auth": "none"}').when(k == 1, '{"auth": {"authenticated": false}}').when(k == 2, '{"auth": "Protected"}').when(k == 3, '{"auth": "public"}').when(k == 4, '{"auth": "anonymous", "authenticated": "false"}').otherwise('{"x": 1}')
    return s.table("events").select("event_id", X.auth_state(props).alias("auth"))


@query("op070_attribute_coalesce", "select o_orderkey, coalesce(case when o_orderstatus = 'F' then o_orderpriority end, case when o_orderkey % 2 = 0 then c_name end, c_mktsegment) as value from orders join customer on c_custkey = o_custkey")
def _(s):
    span = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    resource = F.when(F.col("o_orderkey") % 2 == 0, F.col("c_name"))
    return s.table("orders").join(s.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.coalesce(span, resource, F.col("c_mktsegment")).alias("value"))


# --- state tables ---------------------------------------------------------------------------------------
def _jobs(s):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("cancelled")
    return s.table("orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))


_STATUS = "case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'cancelled' end"


@query("op016_guarded_update", f"select o_orderkey as id, case when {_STATUS} = 'running' and o_orderkey % 3 = 0 then 'failed' else {_STATUS} end as status from orders")
def _(s):
    jobs = _jobs(s)
    return store.guarded_update(jobs, jobs.where("id % 3 = 0").withColumn("status", F.lit("failed")), "id")


@query("op017_clear_finished", f"select o_orderkey as id from orders where {_STATUS} = 'running'")
def _(s):
    return state.clear_finished(_jobs(s)).select("id")


@query("op018_list_jobs", f"select o_orderkey as id, {_STATUS} as status from orders")
def _(s):
    return registers.newest(_jobs(s), "id")


@query("op019_replace_findings", "select l_orderkey as repo, l_returnflag as detector, l_linenumber as f from lineitem where l_orderkey % 10 > 0 or l_returnflag <> 'R' union all select distinct l_orderkey, 'R', 99 from lineitem where l_orderkey % 10 = 0 and l_returnflag = 'R'")
def _(s):
    old = s.table("lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_returnflag").alias("detector"), F.col("l_linenumber").alias("f"))
    new = old.where("repo % 10 = 0 and detector = 'R'").select("repo", "detector").distinct().withColumn("f", F.lit(99))
    return store.replace_partition(old, new, ["repo", "detector"])


@query("op020_finding_counts", "select l_shipdate::date::varchar as day, count(*) filter (l_returnflag = 'R') as r, count(*) filter (l_returnflag = 'A') as a from lineitem group by 1")
def _(s):
    return s.table("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))


@query("op021_history_append", "select o_orderkey as id, o_orderstatus as kind from orders union all select -1, 'new'")
def _(s):
    return state.append(s.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind")), s.spark.createDataFrame([(-1, "new")], "id long, kind string"))


@query("op022_history_top", "select o_orderkey as id, o_totalprice from orders order by o_orderkey desc limit 20")
def _(s):
    return registers.newest(s.table("orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id", 20)


@query("op147_limit_history", "select event_id, event_type from events order by event_id desc limit 50")
def _(s):
    return registers.newest(s.table("events").select("event_id", "event_type"), "event_id", 50)


@query("op144_candidate_cap", "select p_partkey from part where p_size > 20 order by p_partkey limit 8")
def _(s):
    return s.table("part").where("p_size > 20").select("p_partkey").orderBy("p_partkey").limit(8)


@query("op023_latest_coverage", "select o_custkey as repo, max_by(o_totalprice, o_orderkey) as latest from orders group by o_custkey")
def _(s):
    return registers.latest(s.table("orders").withColumnRenamed("o_custkey", "repo"), "repo", "o_totalprice", "o_orderkey")


@query("op024_egress_bytes", "select c_custkey as tier, coalesce(sum(o_custkey), 0) as bytes from customer left join orders on o_custkey = c_custkey group by c_custkey")
def _(s):
    return s.table("customer").join(s.table("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("tier")).agg(F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("bytes"))


@query("op025_policies", "select c_custkey as tier from customer where c_mktsegment <> 'BUILDING' or c_acctbal > 0")
def _(s):
    tiers = s.table("customer").select(F.col("c_custkey").alias("tier"), F.lit(True).alias("enabled"), (F.col("c_mktsegment") == "BUILDING").alias("cloud"), (F.col("c_acctbal") > 0).alias("consent"))
    return state.allowed_policies(tiers).select("tier")


@query("op026_decisions_upsert", "select o_custkey as assertion, max_by(o_orderstatus, o_orderkey) as decision from orders group by o_custkey")
def _(s):
    d = s.table("orders").select(F.col("o_custkey").alias("assertion"), F.col("o_orderstatus").alias("decision"), F.col("o_orderkey").alias("seq"))
    return store.upsert(d.limit(0).select("assertion", "decision"), d, ["assertion"])


@query("op027_reapplied", "with b as (select doc_id, sha(text) as basis_hash from documents) select a.doc_id as decision, b.doc_id as task from b a join b on a.basis_hash = b.basis_hash and a.doc_id % 2 = 0 and b.doc_id % 2 = 1")
def _(s):
    b = s.table("documents").select("doc_id", X.content_hash(F.col("text")).alias("basis_hash"))
    return state.reapplied(b.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "decision"), b.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "task")).select("decision", "task")


@query("op028_plugin_gates", "select p_partkey as plugin, p_brand as content_hash from part where p_size > 10 and p_partkey % 3 > 0")
def _(s):
    p = s.table("part").select(F.col("p_partkey").alias("plugin"), F.col("p_brand").alias("content_hash"), "p_size", "p_retailprice")
    return state.active_plugins(p.where("p_size > 10"), p.where("plugin % 3 > 0")).select("plugin", "content_hash")


@query("op264_active_set", "select p_partkey as plugin, p_brand as content_hash from part where p_size > 25 and p_partkey % 2 = 0")
def _(s):
    p = s.table("part").select(F.col("p_partkey").alias("plugin"), F.col("p_brand").alias("content_hash"), "p_size", "p_retailprice")
    return state.active_plugins(p.where("p_size > 25"), p.where("plugin % 2 = 0")).select("plugin", "content_hash")


@query("op029_tier_settings", "select c_custkey as tier, case when c_custkey % 3 = 0 then 'local' when c_mktsegment = 'BUILDING' then 'cloud' else 'local' end as provider, c_custkey % 3 > 0 and c_mktsegment = 'BUILDING' and c_acctbal > 0 as consent from customer")
def _(s):
    tiers = s.table("customer").select(F.col("c_custkey").alias("tier"), F.when(F.col("c_mktsegment") == "BUILDING", "cloud").otherwise("local").alias("provider"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).alias("consent"))
    return state.change_provider(tiers, tiers.where("tier % 3 = 0").select("tier", F.lit("local").alias("to")))


@query("op263_discovery", "select p_brand as plugin, min_by(p_partkey, case when p_size % 2 = 0 then 0 else 1000000 end + p_partkey) as chosen, count(*) - 1 as shadowed from part group by p_brand")
def _(s):
    found = s.table("part").select(F.col("p_brand").alias("plugin"), F.col("p_partkey").alias("root"), (F.col("p_size") % 2).alias("priority"))
    return state.discovered(found)


@query("op142_first_and_last", "select o_custkey, min_by(o_orderkey, o_totalprice) as a, max_by(o_orderkey, o_totalprice) as z from orders group by o_custkey")
def _(s):
    return s.table("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_totalprice").alias("a"), F.max_by("o_orderkey", "o_totalprice").alias("z"))


@query("op143_budget", "with l as (select conv_id, turn, role, sum(strlen(text) + 1) over (partition by conv_id order by turn) as used from conversations) select conv_id, turn, used from l where used <= 900")
def _(s):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return s.table("conversations").withColumn("used", F.sum(F.octet_length("text") + 1).over(w)).where("used <= 900").select("conv_id", "turn", F.col("used").cast("bigint").alias("used"))


@query("op145_presentational_ids", "select n_name, printf('US-R-%04d', row_number() over (order by n_name)) as ref from nation")
def _(s):
    return store.numbered(s.table("nation").select("n_name"), "n_name", "US-R-%04d")


@query("op148_distinct_thresholds", "select distinct round(l_discount, 3) as threshold from lineitem")
def _(s):
    return s.table("lineitem").select(F.round("l_discount", 3).alias("threshold")).distinct()


@query("op163_cache_deleted", "select o_orderkey as file from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 40)")
def _(s):
    return state.deleted_files(s.table("orders").select(F.col("o_orderkey").alias("file")), s.table("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("file")))


@query("op166_repo_overlap", "select o_custkey, bool_or(o_orderpriority in ('1-URGENT', '2-HIGH')) as covered from orders group by o_custkey")
def _(s):
    urgent = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return s.table("orders").groupBy("o_custkey").agg(F.arrays_overlap(F.collect_set("o_orderpriority"), urgent).alias("covered"))


@query("op270_parse_cache", "with n as (select doc_id, sha(text) as h from documents), o as (select doc_id, case when doc_id % 10 = 0 then 'old' else sha(text) end as h from documents where doc_id % 7 > 0) select n.doc_id as path, case when o.h = n.h then 'reused' else 'parsed' end as action from n left join o on o.doc_id = n.doc_id")
def _(s):
    now = s.table("documents").select(F.col("doc_id").alias("path"), X.content_hash(F.col("text")).alias("hash"))
    cache = now.where("path % 7 > 0").withColumn("hash", F.when(F.col("path") % 10 == 0, "old").otherwise(F.col("hash")))
    return state.cache_plan(now, cache)


# --- export ---------------------------------------------------------------------------------------------
@query("op045_snapshot", "select kind, line from (select 'node' as kind, concat_ws(' ', id, label) as line from nodes union all select 'edge', concat_ws(' ', src, label, dst) from edges)")
def _(s):
    n = s.nodes.orderBy("id").select(F.lit("node").alias("kind"), F.concat_ws(" ", "id", "label").alias("line"))
    return n.unionAll(s.edges.orderBy("src", "dst", "label").select(F.lit("edge"), F.concat_ws(" ", "src", "label", "dst")))
