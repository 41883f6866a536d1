"""Queries of enrichment: module resolution, observed state and traces, decisions, semantic proposals, escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, resolve, semantic
from ..operators.lineage import written
from ..sources import extractors, observations
from .derived import Source, oracle
from .graph_queries import _SCORE, _STEPS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run

    return register


def text(*parts):
    """Strings and columns, joined."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


# --- resolution -------------------------------------------------------------------------------------------
@query("op084_deferred_handlers", "with d as (select p_brand, p_size, max(p_partkey) as handler from part group by 1, 2) select c_custkey as endpoint, concat('sym:', handler) as handler from customer join d on p_brand = concat('Brand#', c_nationkey % 8) and p_size = c_custkey % 50")
def _(s):
    pending = s.table("customer").select(F.col("c_custkey").alias("endpoint"), text("Brand#", F.col("c_nationkey") % 8).alias("package_dir"), (F.col("c_custkey") % 50).cast("int").alias("exported"))
    symbols = s.table("part").select(text("sym:", F.col("p_partkey")).alias("id"), F.col("p_brand").alias("package_dir"), F.col("p_size").alias("simple_name"), F.col("p_partkey").alias("seq"))
    return enrich.handled_endpoints(pending, symbols).select("endpoint", "handler")


@query(
    "op087_module_targets",
    """with i as (select o_orderkey, o_custkey % 4 as d, o_orderkey % 5 as k from orders)
 select concat('p', d, '/src/', o_orderkey, '.ts') as importer,
  case k when 0 then concat('@app/x', o_orderkey % 7) when 1 then '@app/exact' when 2 then 'lib/util' when 3 then 'pkg' end as spec,
  case when k = 3 then 'packages/pkg/main.ts' when k = 1 then 'p1/src/only.ts' when k = 2 then 'p1/src/lib/util/index.ts' else concat('p1/src/app/x', o_orderkey % 7, '.tsx') end as target,
  case when k = 3 then 'workspace-package' when k = 2 then 'tsconfig-baseurl' else 'tsconfig-paths' end as via
 from i where k = 3 or (k < 3 and d = 1 and not (k = 0 and o_orderkey % 7 > 4))""",
)
def _(s):
    # folder p1 has patterns and a base URL; p0 shadows the root's patterns with none; p2 and p3 see the root's
    o = s.table("orders")
    k, d = F.col("o_orderkey") % 5, F.col("o_custkey") % 4
    spec = F.when(k == 0, text("@app/x", F.col("o_orderkey") % 7)).when(k == 1, "@app/exact").when(k == 2, "lib/util").when(k == 3, "pkg").otherwise("unknown")
    imports = o.select(text("p", d, "/src/", F.col("o_orderkey"), ".ts").alias("importer"), spec.alias("spec"))
    options = '{"compilerOptions": {"baseUrl": "./src", // here\n "paths": {"@app/*": ["gone/*", "app/*",], "@app/exact": ["only.ts"]}}}'
    docs = s.spark.createDataFrame([("p1/tsconfig.json", options), ("p1/tsconfig.build.json", '{"compilerOptions": {"baseUrl": "other"}}'), ("p0/tsconfig.json", "{}"), ("tsconfig.json", '{"compilerOptions": {"paths": {"@app/*": ["root/*"]}}}')], "path string, text string")
    paths = observations.tsconfig_paths(docs)
    packages = observations.package_entries(s.spark.createDataFrame([("packages/pkg/package.json", '{"name": "pkg", "exports": {".": {"require": "./r.js", "import": "./lost.js"}}, "module": "./main.ts"}')], "path string, text string"))
    real = ["p1/src/only.ts", "p1/src/lib/util/index.ts", "packages/pkg/main.ts", "other/lib/util.ts"] + [f"p1/src/app/x{i}.tsx" for i in range(5)]
    files = s.spark.createDataFrame([(x,) for x in real], "path string")
    out = enrich.module_targets(imports, paths.select("dir", "config_path", "base_url").distinct(), paths.where("pattern is not null").select("config_path", "pattern", "targets"), packages, files)
    return out.select("importer", "spec", "target", "via")


@query(
    "op091_terraform_state",
    """select concat('res:r@', case when s_suppkey % 3 = 2 then 'module.m' else 'aws_sqs_queue.q' end, s_suppkey) as id, case when s_suppkey % 5 = 4 then null when s_suppkey % 3 = 2 then case when s_nationkey % 2 = 0 then '{"module_resources":2}' end else concat('{"url":"', s_name, '"}') end as observed,
  case when s_suppkey % 5 < 4 and s_nationkey % 2 = 0 then case when s_suppkey % 3 = 2 then 'module' else 'aws_sqs_queue' end else 'unknown' end as type, s_suppkey % 5 = 4 and s_nationkey % 2 = 0 as placeholder from supplier""",
)
def _(s):
    n = F.col("s_suppkey")
    module, placeholder = n % 3 == 2, F.col("s_nationkey") % 2 == 0
    address = F.when(module, text("module.m", n)).otherwise(text("aws_sqs_queue.q", n))
    resources = s.table("supplier").select(text("res:r@", address).alias("id"), address.alias("address"), F.lit("unknown").alias("type"), F.lit("l").alias("logical_id"), placeholder.alias("placeholder"))
    seen = s.table("supplier").where("s_suppkey % 5 < 4")
    state = seen.where(~module).select(address.alias("address"), F.lit("aws_sqs_queue").alias("type"), text('{"url":"', F.col("s_name"), '"}').alias("values"))
    modules = seen.where(module).select(address.alias("address"), F.lit(2).alias("resources"))
    return enrich.observed_resources(resources, state, modules).select("id", "observed", "type", "placeholder")


@query("op091_state_modules", "select concat('module.m', s_suppkey) as address, 1 as resources from supplier")
def _(s):
    doc = text('{"values":{"root_module":{"resources":[],"child_modules":[{"address":"module.m', F.col("s_suppkey"), '","resources":[{"address":"a","type":"t"}]}]}}}')
    return observations.terraform_modules(s.table("supplier").select(F.lit("p").alias("path"), doc.alias("text"))).select("address", "resources")


_BACKED = "select concat('res:', s_suppkey) as src, concat('chan:', case when s_suppkey % 2 = 0 then 'sqs-queue' else 'sns-topic' end, ':E', s_suppkey % 60) as dst from supplier where s_suppkey % 4 < 3 and s_suppkey % 60 in (select user_id % 40 from events where event_type = case when s_suppkey % 2 = 0 then 'click' else 'error' end)"


def _backed(s):
    n = F.col("s_suppkey")
    attribute = F.when(n % 2 == 0, "url").otherwise("arn")
    inner = text('{"', attribute, '":"', F.when(n % 4 == 3, "[redacted]").otherwise(text("E", n % 60)), '"}')
    observed = F.when(n % 3 == 0, inner).when(n % 3 == 1, text('{"outputs":', inner, ',"inputs":{"url":"no","arn":"no"}}')).otherwise(text('{"inputs":', inner, "}"))
    res = s.table("supplier").select(text("res:", n).alias("id"), F.when(n % 2 == 0, "aws_sqs_queue").otherwise("aws_sns_topic").alias("type"), observed.alias("observed"))
    kinds = F.when(F.col("event_type") == "click", "sqs-queue").when(F.col("event_type") == "error", "sns-topic")
    channels = s.table("events").select(text("chan:", kinds, ":E", F.col("user_id") % 40).alias("id")).where("id is not null").distinct()
    return enrich.backing_edges(res, channels)


@query("op093_backings", _BACKED)
def _(s):
    return _backed(s)


@query("op093_stale_backings", f"select src, dst, 'BACKS' as label, 'state' as extractor from ({_BACKED}) b union all select 'res:old', 'chan:kept', 'BACKS', 'manual' union all select 'res:old', 'chan:kept', 'GRANTS', 'state'")
def _(s):
    stored = s.spark.createDataFrame([("res:old", "chan:gone", "BACKS", "state"), ("res:old", "chan:kept", "BACKS", "manual"), ("res:old", "chan:kept", "GRANTS", "state")], "src string, dst string, label string, extractor string")
    fresh = _backed(s).select("src", "dst", F.lit("BACKS").alias("label"), F.lit("state").alias("extractor"))
    return enrich.refreshed_edges(stored, fresh, "BACKS", ["state"])


_TRACED = """with g as (select concat('g', o_orderkey) as gap, case when o_orderkey % 3 = 0 then 'sqs-queue' else 'kafka-topic' end as kind, concat('src/', o_custkey, '.ts') as path from orders union all select 'gap:sns', 'sns-topic', 'x.ts'),
 sp as (select 'sqs-queue' as kind, concat('src/', c_custkey, '.ts') as path, concat('q', c_nationkey) as identity from customer where c_custkey % 3 > 0 union all select 'sqs-queue', concat('src/', c_custkey, '.ts'), 'other' from customer where c_custkey % 5 = 0),
 hit as (select gap, count(distinct identity) as n, min(identity) as i from g join sp on sp.kind = g.kind and sp.path = g.path group by gap)
 select g.gap, case when g.kind = 'sns-topic' then 1 else coalesce(n, 0) end as identities, case when g.kind = 'sns-topic' then 'only' when n = 1 then i end as identity,
 case when g.kind = 'sns-topic' then null when n is null then 'no trace observation uniquely matched this source gap' when n > 1 then 'multiple observed channel identities matched this source gap' end as reason from g left join hit on hit.gap = g.gap"""


def _traced(s):
    o, c = s.table("orders"), s.table("customer")
    gaps = o.select(text("g", F.col("o_orderkey")).alias("gap"), F.when(F.col("o_orderkey") % 3 == 0, "sqs-queue").otherwise("kafka-topic").alias("kind"), text("src/", F.col("o_custkey"), ".ts").alias("path"))
    gaps = gaps.unionAll(s.spark.createDataFrame([("gap:sns", "sns-topic", "x.ts")], gaps.schema))
    at = text("src/", F.col("c_custkey"), ".ts")
    spans = c.where("c_custkey % 3 > 0").select(F.lit("sqs-queue").alias("kind"), text("/app/", at).alias("path"), text("q", F.col("c_nationkey")).alias("identity"))
    spans = spans.unionAll(c.where("c_custkey % 5 = 0").select(F.lit("sqs-queue"), text("./", at), F.lit("other")))
    # spans of kafka have no place, and many gaps; the only gap of sns is resolved by its kind
    spans = spans.unionAll(s.spark.createDataFrame([("kafka-topic", None, "t"), ("sns-topic", None, "only"), ("sns-topic", None, "only")], "kind string, path string, identity string"))
    return resolve.traced_gaps(gaps, spans)


@query("op094_traced_gaps", _TRACED)
def _(s):
    return _traced(s).select("gap", "identities", "identity", "reason")


@query("op094_rewritten_edges", f"with t as ({_TRACED}) select concat('sym:', o_orderkey) as src, coalesce('chan:sqs-queue:' || identity, concat('g', o_orderkey)) as dst, identity is not null as traced from orders join t on t.gap = concat('g', o_orderkey)")
def _(s):
    edges = s.table("orders").select(text("sym:", F.col("o_orderkey")).alias("src"), text("g", F.col("o_orderkey")).alias("dst"), F.lit("PUBLISHES").alias("label"))
    return enrich.resolved_by_traces(edges, _traced(s)).select("src", "dst", "traced")


@query("op095_traced_endpoints", "with e as (select min(c_custkey) as c, count(*) as n, c_acctbal from customer group by c_acctbal having count(*) = 1) select concat('ep:', c_custkey) as endpoint, min(o_orderkey) as span from customer join e on e.c_acctbal = customer.c_acctbal join orders on o_custkey = c_custkey where c_custkey % 4 > 0 group by 1")
def _(s):
    c, path = s.table("customer"), text("/c/", F.col("c_acctbal"))
    ends = c.select(text("ep:", F.col("c_custkey")).alias("id"), F.lit("GET").alias("method"), path.alias("path"), (F.col("c_custkey") % 4 == 0).alias("observed"))
    spans = s.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("span"), F.lit("get").alias("method"), text("https://h.example/c/", F.col("c_acctbal"), "?x=1").alias("url"))
    return enrich.traced_endpoints(ends, spans)


@query("op097_capabilities", "select concat('aws_sqs_queue.q', s_suppkey) as src, concat('aws_lambda_function.', f, s_suppkey) as dst, 'TRIGGERS' as label, concat('aws_lambda_event_source_mapping.m', s_suppkey) as via from supplier, (select unnest(['a', 'b']) as f) t union all select concat('aws_cloudfront_distribution.d', s_suppkey), concat('aws_lambda_function.e', s_suppkey), 'TRIGGERS', concat('aws_cloudfront_distribution.d', s_suppkey) from supplier")
def _(s):
    source = text(
        'resource "aws_lambda_event_source_mapping" "m', F.col("s_suppkey"), '" {\n  event_source_arn = aws_sqs_queue.q', F.col("s_suppkey"), ".arn\n  function_name = coalesce(aws_lambda_function.a", F.col("s_suppkey"), ".arn, aws_lambda_function.b", F.col("s_suppkey"), ".arn)\n}\n",
        'resource "aws_cloudfront_distribution" "d', F.col("s_suppkey"), '" {\n  ordered_cache_behavior {\n    lambda_function_association {\n      lambda_arn = aws_lambda_function.e', F.col("s_suppkey"), ".qualified_arn\n    }\n  }\n}\n",
    )
    rows = extractors.extracted(s.table("supplier").select(text("i/", F.col("s_suppkey"), ".tf").alias("path"), source.alias("text"))).where("kind = 'attribute'")
    refs = rows.select(F.col("name").alias("via"), F.substring_index("name", ".", 1).alias("type"), F.substring_index("detail", " ", 1).alias("attribute"), F.substring_index("detail", " ", -1).alias("ref"))
    return enrich.capability_edges(refs)


_LINKS = "select concat('adr:', p_partkey) as adr, concat('chan:p', p_partkey) as target, 0 as field from part where p_size < 20 union all select concat('adr:', p_partkey), concat('sym:s', p_partkey % 90), 1 from part where p_size < 20 and p_partkey % 90 in (select s_suppkey from supplier)"


def _records(s):
    p = s.table("part").where("p_size < 20")
    doc = text("# Decision\n\nStatus: accepted\nGoverns: `chan:p", F.col("p_partkey"), "`, nothing:here\n\nSee `sym:s", F.col("p_partkey") % 90, "` and `chan:p", F.col("p_partkey"), "`.\n")
    found = observations.decision_records(p.select(text("docs/adr/", F.col("p_partkey"), ".md").alias("path"), doc.alias("text")))
    return found.select(text("adr:", F.regexp_extract("path", r"(\d+)\.md$", 1)).alias("adr"), "governs", "mentions")


@query("op098_decision_links", _LINKS)
def _(s):
    return enrich.decision_links(_records(s), s.nodes).select("adr", "target", "field")


def _relinked(s):
    stored = s.spark.createDataFrame([("adr:gone", "here"), ("adr:far", "away")], "id string, repo string")
    edges = s.spark.createDataFrame([("adr:gone", "chan:p1"), ("adr:far", "chan:p1")], "src string, dst string")
    repos = s.spark.createDataFrame([("here",)], "repo string")
    return enrich.relinked(stored, edges, repos, _records(s).withColumn("repo", F.lit("here")), s.nodes)


@query("op099_relinked_records", "select concat('adr:', p_partkey) as id from part where p_size < 20 union all select 'adr:far'")
def _(s):
    return _relinked(s)[0].select("id")


@query("op099_relinked_edges", f"select adr as src, target as dst from ({_LINKS}) l union all select 'adr:far', 'chan:p1'")
def _(s):
    return _relinked(s)[1]


@query("op106_bound_entries", "select concat('ctx', n_nationkey) as context, case n_nationkey % 3 when 0 then concat('file:r@ext', n_nationkey, '/src/bg.js') when 1 then concat('file:r@ext', n_nationkey, '/src/bg.ts') else concat('gap:webext:r@ext', n_nationkey, '/src/bg.js') end as dst, n_nationkey % 3 = 1 as from_build_path from nation")
def _(s):
    n = F.col("n_nationkey")
    entries = s.table("nation").select(text("ctx", n).alias("context"), F.lit("r").alias("repo"), text("ext", n).alias("dir"), F.lit("./src/bg.js").alias("declared"))
    files = s.table("nation").where("n_nationkey % 3 < 2").select(text("ext", n, "/src/bg", F.when(n % 3 == 0, ".js").otherwise(".ts")).alias("path"))
    return enrich.bound_entries(entries, files).select("context", "dst", "from_build_path")


@query("op181_modules", "select concat('module.a.aws_sqs_queue.q', s_suppkey) as address from supplier union all select concat('module.a.module.b.aws_sns_topic.t', s_suppkey) from supplier union all select concat('module.b.aws_sns_topic.t', s_suppkey) from supplier union all select concat('aws_iam_role.r', s_suppkey) from supplier")
def _(s):
    # root calls a and b, a calls b, b calls a again (a cycle through a's own ancestors), and a registry module is no folder
    calls = s.spark.createDataFrame([("root", "a", "./mods/a"), ("root", "b", "./mods/b"), ("root/mods/a", "b", "../b"), ("root/mods/b", "again", "../b"), ("root", "far", "registry/mod")], "dir string, name string, source string")
    n = F.col("s_suppkey")
    part = lambda folder, kind: s.table("supplier").select(F.lit(folder).alias("dir"), text(kind, n).alias("address"))
    resources = part("root", "aws_iam_role.r").unionAll(part("root/mods/a", "aws_sqs_queue.q")).unionAll(part("root/mods/b", "aws_sns_topic.t"))
    return enrich.expanded_modules(calls, resources, "root")[0].select("address")


@query("op181_module_references", "select module, count(*) as n from (select unnest(['module.a', 'module.a.module.b', 'module.b']) as module from supplier) m group by module")
def _(s):
    calls = s.spark.createDataFrame([("root", "a", "./mods/a"), ("root", "b", "./mods/b"), ("root/mods/a", "b", "../b")], "dir string, name string, source string")
    n = F.col("s_suppkey")
    part = lambda folder, kind: s.table("supplier").select(F.lit(folder).alias("dir"), text(kind, n).alias("address"))
    resources = part("root/mods/a", "aws_sqs_queue.q").unionAll(part("root/mods/b", "aws_sns_topic.t"))
    return enrich.expanded_modules(calls, resources, "root")[1].groupBy("module").agg(F.count("*").alias("n"))


# --- semantic chain ---------------------------------------------------------------------------------------
def _typed(s):
    nodes = s.fact_nodes.select("id", "label", "props", F.when(F.col("id").endswith("7"), 0).otherwise(1).alias("evidence"))
    extra = s.nodes.where("label = 'Symbol'").select("id", "label", text('{"name":"', F.col("name"), '"}').alias("props"), F.lit(1).alias("evidence"))
    return nodes.unionAll(extra), s.fact_edges.select("src", "dst", "label")


_SLOTS = "select concat('gap:chan:s', s_suppkey) as gap_id, concat('res:shop@s', s_suppkey) as source_id, 'PUBLISHES' as edge_label, 'Channel' as kind, 'sqs-queue' as subtype, concat('queue ', s_name) as query from supplier where s_suppkey % 3 = 0 and s_suppkey % 10 <> 7"
_CANDIDATES = """select id as node_id, 'Channel' as kind, 'sqs-queue' as subtype, json_extract_string(props, '$.identity') as text, null as staged from facts_n where label = 'Channel' and id not like '%7'
 union all select id, 'Call', null, name, null from nodes where label = 'Symbol'
 union all select concat('chan:sqs-queue:resource:', id), 'Channel', 'sqs-queue', concat(translate(json_extract_string(props, '$.logical_id'), '._-', '   '), ' aws_sqs_queue'), id from facts_n where label = 'Resource' and id not like '%7'"""


@query("op178_slots", _SLOTS)
def _(s):
    return semantic.graph_inputs(*_typed(s))[0]


@query("op178_candidates", _CANDIDATES)
def _(s):
    return semantic.graph_inputs(*_typed(s))[1]


_VECTOR = "[" + ", ".join(f"cast(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')) as double)" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@query(
    "op179_proposals",
    f"""with sl as ({_SLOTS}), ca as ({_CANDIDATES}), q as (select distinct query, {_VECTOR.format('query')} as v from sl), i as (select node_id, staged, {_VECTOR.format('text')} as v from ca where kind = 'Channel'),
 p as (select query, node_id, staged, round(greatest(0, least(1, list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))))), 4) as similarity from q, i),
 b as (select *, row_number() over (partition by query order by similarity desc, node_id) as r from p)
 select gap_id, source_id, node_id as target_id, similarity, staged from sl join b on b.query = sl.query where r <= 3""",
)
def _(s):
    slots, candidates = semantic.graph_inputs(*_typed(s))
    return semantic.proposed(slots, candidates, 3, digits=4).select("gap_id", "source_id", "target_id", "similarity", "staged")


_APPROVED = "select concat('sym:o', cast(l_orderkey as varchar)) as src, concat('gap:o', cast(l_orderkey as varchar), '@', cast(l_linenumber as varchar)) as gap, concat('chan:p', cast(l_partkey as varchar)) as target from lineitem where l_returnflag = 'R' and l_quantity < 3"
_LAID = f"""a_ as ({_APPROVED}), kept_ as (select src, dst, label, conf from edges where dst not in (select gap from a_)),
 e_over as (select src, dst, label, conf from kept_ union all select distinct src, target, 'PUBLISHES', 'InferredStrong' from a_ where not exists (select 1 from kept_ k where k.src = a_.src and k.dst = a_.target and k.label = 'PUBLISHES')),
 n_over as (select * from nodes where id not in (select gap from a_)), """


def _over(text_: str) -> str:
    return text_.replace(" edges", " e_over").replace(" nodes", " n_over")


@query("op180_overlay_retraced", "with recursive " + _LAID + _over(_STEPS) + " " + _over(_SCORE.format(gap="or h.dst in (select id from nodes where label = 'Gap')")))
def _(s):
    line = s.table("lineitem").where("l_returnflag = 'R' and l_quantity < 3")
    approved = line.select(text("sym:o", F.col("l_orderkey")).alias("src"), text("gap:o", F.col("l_orderkey"), "@", F.col("l_linenumber")).alias("gap"), F.lit("PUBLISHES").alias("label"), text("chan:p", F.col("l_partkey")).alias("target"), F.lit("InferredStrong").alias("conf"))
    return semantic.retraced(written(s.nodes, "nodes"), written(s.edges, "edges"), approved).withColumn("score", F.round("score", 9))


_TASKS = """asked as (select id as gap_id from facts_n where label = 'Gap'),
 slot as (select gap_id, src as source_id from asked join facts_e on dst = gap_id),
 ev as (select id, case when id like '%7' then 0 else 1 end as evidence, label, conf from facts_n),
 one as (select gap_id, source_id as id from slot), two as (select gap_id, case when src = one.id then dst else src end as id from one join facts_e on src = one.id or dst = one.id),
 near as (select distinct two.gap_id, two.id from two join ev on ev.id = two.id and label <> 'Gap' and conf <> 'Gap' and evidence > 0 join slot on slot.gap_id = two.gap_id where two.id <> two.gap_id and two.id <> source_id),
 best as (select * from (select *, row_number() over (partition by gap_id order by id) as r from near) x where r <= 8)"""


@query("op177_escalation_tasks", f"with {_TASKS} select asked.gap_id, source_id, case when g.evidence + coalesce(sr.evidence, 0) = 0 then 'no evidence' when asked.gap_id not in (select gap_id from best) then 'no candidates' end as problem from asked join slot on slot.gap_id = asked.gap_id join ev g on g.id = asked.gap_id left join ev sr on sr.id = source_id")
def _(s):
    return semantic.escalation_tasks(*_escalated(s))[0].select("gap_id", "source_id", "problem")


@query("op177_escalation_candidates", f"with {_TASKS} select gap_id, id as node_id from best")
def _(s):
    return semantic.escalation_tasks(*_escalated(s))[1].select("gap_id", "node_id")


def _escalated(s):
    nodes = s.fact_nodes.select("id", "label", "conf", F.when(F.col("id").endswith("7"), 0).otherwise(1).alias("evidence"))
    return nodes, s.fact_edges.select("src", "dst", "label"), nodes.where("label = 'Gap'").select(F.col("id").alias("gap_id"))


# --- evidence ---------------------------------------------------------------------------------------------
@query("op042_evidence_window", "select o_orderkey as path, case when o_orderkey % 2 = 0 then 0 else 95 end as window_start, case when o_orderkey % 2 = 0 then 1 else 10 end as start_line, o_orderkey % 2 = 1 as truncated from orders")
def _(s):
    # ten bytes to a line; a window of 20 bytes around a span of 10 in the middle, or a file that fits
    content = F.when(F.col("o_orderkey") % 2 == 0, "123456789\n").otherwise(F.repeat(F.lit("123456789\n"), 30)).cast("binary")
    at = F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(100)
    rows = s.table("orders").select(F.col("o_orderkey").alias("path"), content.alias("content"), at.cast("bigint").alias("byte_start"), (at + F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(10)).cast("bigint").alias("byte_end"))
    return observations.evidence_window(rows, 20).select("path", "window_start", "start_line", "truncated")


@query("op030_file_walk")
def _(s):
    return observations.listed(s.spark, s.sf_dir, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size")
