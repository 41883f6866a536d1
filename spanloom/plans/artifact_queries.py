"""Queries of the artifacts: the lines that each shows, over the domain facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts
from ..operators.lineage import written
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


def _facts(s):
    return written(s.fact_nodes.select(*artifacts.NODE), "nodes"), written(s.fact_edges.select(*artifacts.EDGE), "edges")


def _body(artifact, *parts: int):
    return artifact[0].where(F.col("part").isin(*parts)).select("line")


_J = "json_extract_string(props, '$.{}')"
_NAME = f"case when label = 'Endpoint' then concat({_J.format('method')}, ' ', {_J.format('path')}) else coalesce({_J.format('title')}, {_J.format('name')}, {_J.format('identity')}, {_J.format('logical_id')}, {_J.format('reason')}, id) end"
_SAFE = "replace({}, '|', '\\|')"
_TABLE = f"concat('| `', {_SAFE.format('src')}, '` | ', label, ' | `', {_SAFE.format('dst')}, '` |')"
_MID = "concat(regexp_replace({0}, '[^A-Za-z0-9]', '_', 'g'), '_', substr(sha({0}), 1, 8))"


@query("op190_user_stories", f"select concat('## ', printf('US-R-%04d', row_number() over (order by id)), ' — ', {_J.format('title')}, chr(10), chr(10), '- Recovered capability assertion: `', id, '`', chr(10)) as line from facts_n where label = 'Capability' and conf <> 'Gap'")
def _(s):
    return _body(artifacts.user_stories(s.fact_nodes), 1)


@query("op191_traceability", f"select {_TABLE} as line from facts_e where label in ('REALIZES', 'STEP_OF', 'GOVERNS', 'MAPS_TO', 'DECIDES', 'TRIGGERED_BY', 'PERFORMED_BY') and conf <> 'Gap'")
def _(s):
    return _body(artifacts.traceability(s.fact_edges), 1)


_DOSSIER = """hops as (select concat('ep:c', cast(o_custkey as varchar)) as t, concat('sym:o', cast(o_orderkey as varchar)) as d, o_orderstatus = 'P' as weak, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k,
  sha(concat('ep:c', cast(o_custkey as varchar), ' HANDLES ', 'sym:o', cast(o_orderkey as varchar))) as h from orders),
 shown as (select t, k, h, case when weak then 'UNRESOLVED' else 'HANDLES' end as label, case when weak then 'Gap' else 'Confirmed' end as conf, case when weak then concat('gap:projection:', substr(sha(concat(t, ' HANDLES ', d, ' ', h, ' weak inference excluded by verified-only export')), 1, 16)) else d end as d, case when weak then 'Deterministic' else 'Deterministic' end as tier, case when weak then 'spec.projection-gap' else 'go' end as x from hops),
 n as (select concat('sym:o', cast(o_orderkey as varchar)) as id, o_orderpriority as name from orders),
 sc as (select t, count(*) as n, avg(case when conf = 'Confirmed' then 1.0 else 0.0 end) as score, bool_or(conf = 'Gap') as g from shown group by t)"""


@query(
    "op192_flow_dossiers",
    f"""with {_DOSSIER}
 select concat(chr(10), '## ', c_name, ' — ', case when n is null or g then 'Partial' else 'Verified' end, ' (score ', printf('%.2f', coalesce(score, 0)), ')', chr(10), chr(10), 'Trigger: Endpoint `ep:c', cast(c_custkey as varchar), '`', case when n is null then concat(chr(10), chr(10), 'No hops resolved from this trigger.') else concat(chr(10), chr(10), '```mermaid', chr(10), 'sequenceDiagram') end) as line from customer left join sc on t = concat('ep:c', cast(c_custkey as varchar))
 union all select concat('    participant p0 as ', c_name) from customer join sc on t = concat('ep:c', cast(c_custkey as varchar))
 union all select concat('    participant p', cast(k + 1 as varchar), ' as ', coalesce(name, d)) from shown left join n on n.id = d
 union all select concat('    p0', case when conf = 'Gap' then '--x' else '->>' end, 'p', cast(k + 1 as varchar), ': ', label, ' [', conf, ']') from shown
 union all select concat('| ', cast(k + 1 as varchar), ' | ', label, ' `', t, '` → `', d, '` | ', tier, ' | ', conf, ' | — | `', x, '` | `', h, '` |') from shown""",
)
def _(s):
    src, dst = F.concat(F.lit("ep:c"), F.col("o_custkey").cast("string")), F.concat(F.lit("sym:o"), F.col("o_orderkey").cast("string"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    hops = s.table("orders").select(
        src.alias("trigger_id"), place.alias("ord"), src.alias("src"), F.lit("HANDLES").alias("label"), dst.alias("dst"), F.when(F.col("o_orderstatus") == "P", "InferredWeak").otherwise("Confirmed").alias("conf"),
        F.lit("Deterministic").alias("tier"), F.lit("go").alias("extractor"), F.sha2(F.concat_ws(" ", src, F.lit("HANDLES"), dst), 256).alias("hash"), F.lit("").alias("evidence"),
    )
    c = s.table("customer").select(F.concat(F.lit("ep:c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    names = c.unionAll(s.table("orders").select(dst, "o_orderpriority"))
    triggers = c.select(F.col("id").alias("trigger_id"), F.lit("Endpoint").alias("kind"), F.lit(False).alias("depth_limited"))
    lines, _ = artifacts.flow_dossiers(artifacts.projected(hops, hops.select("hash").limit(0)), triggers, names)
    return lines.where("part = 1 and not line like '```%'").select("line")


_SHOWN = "rs as (select * from facts_n where label = 'Resource' and conf <> 'Gap'), backed as (select distinct dst as id from facts_e where label = 'BACKS' and conf <> 'Gap'), ch as (select * from facts_n where label = 'Channel' and conf <> 'Gap' and id in (select id from backed)), ar as (select * from facts_e where label in ('SUBSCRIBES', 'GRANTS', 'BACKS', 'DEPENDS_ON') and conf <> 'Gap' and src in (select id from rs) and (dst in (select id from rs) or label = 'BACKS' and dst in (select id from ch)))"


@query(
    "op193_topology_lines",
    f"""with {_SHOWN} select concat('    ', {_MID.format('id')}, case when json_extract_string(props, '$.placeholder') is not null then '(["' else '["' end, {_J.format('logical_id')}, case when json_extract_string(props, '$.placeholder') is not null then ' ?"])' else '"]' end) as line from rs
 union all select concat('    ', {_MID.format('id')}, '[("', substr(id, 6), '")]') from ch
 union all select distinct concat('    ', {_MID.format('src')}, ' ', case when label = 'DEPENDS_ON' then '-.->' else '-->' end, '|', label, '| ', {_MID.format('dst')}) from ar""",
)
def _(s):
    return _body(artifacts.topology(*_facts(s)), 1, 2, 3)


_MAPS = "en as (select id from facts_n where label = 'DataEntity' and conf <> 'Gap'), ma as (select * from facts_e where label in ('READS', 'WRITES', 'MAPS_TO') and conf <> 'Gap' and (src in (select id from en) or dst in (select id from en)) and src in (select id from facts_n) and dst in (select id from facts_n)), mo as (select *, row_number() over (order by id) - 1 as k from facts_n where id in (select id from en union select src from ma union select dst from ma))"


@query(
    "op194_data_model",
    f"""with {_MAPS} select concat('    d', cast(k as varchar), '["', case when label = 'DataEntity' then '' else concat(label, ': ') end, {_NAME}, '"]') as line from mo
 union all select concat('    d', cast(a.k as varchar), ' -->|', ma.label, '| d', cast(b.k as varchar)) from ma join mo a on a.id = ma.src join mo b on b.id = ma.dst
 union all select {_TABLE} from ma""",
)
def _(s):
    return _body(artifacts.data_model(*_facts(s)), 1, 2, 6)


@query("op105_data_edges", "with en as (select id from nodes where label = 'Channel') select src, dst, label from edges where (src in (select id from en) or dst in (select id from en)) and src in (select id from nodes) and dst in (select id from nodes)")
def _(s):
    return artifacts.data_edges(s.nodes.where("label = 'Channel'"), s.nodes, s.edges.select("src", "dst", "label"))


_ADRS = "ad as (select * from facts_n where label = 'ADR' and conf <> 'Gap'), li as (select * from facts_e where label = 'DECIDES' and conf <> 'Gap' and src in (select id from ad))"


@query("op195_decisions", f"with {_ADRS} select concat('## ', {_J.format('title')}, chr(10), chr(10), '**Origin:** found', chr(10), chr(10), '**Status:** accepted', chr(10)) as line from ad union all select {_TABLE} from li")
def _(s):
    return _body(artifacts.decision_set(*_facts(s)), 1, 3)


_GAPS = f"""(select id, id as subject, concat(label, ': ', {_NAME}) as summary from facts_n where label = 'Gap' or conf = 'Gap' union all select concat(src, ' ', label, ' ', dst), concat(src, ' ', label, ' ', dst), case when {_J.format('reason')} is null then concat(src, ' ', label, ' ', dst) else concat(label, ': ', {_J.format('reason')}) end from facts_e where conf = 'Gap')"""


@query("op196_gap_register", f"select concat('| `', {_SAFE.format('subject')}, '` | ', {_SAFE.format('summary')}, ' |') as line from {_GAPS} g")
def _(s):
    return _body(artifacts.gap_register(*_facts(s)), 1)


@query("op197_drift_register", f"select concat('| ', {_J.format('title')}, ' | `', {_J.format('adr_id')}, '` | `', {_J.format('offending_edge')}, '` | ', case when props like '%flow_triggers%' then 'x, y' else '—' end, ' | ', conf, ' |') as line from facts_n where label = 'Drift'")
def _(s):
    return _body(artifacts.drift_register(*_facts(s)), 1)


@query("op055_drift_facts", "select concat('node:', id) as id from facts_n where label = 'Drift' union all select concat('edge:', src, ' ', label, ' ', dst) from facts_e where label in ('CONFLICTS', 'DRIFTS_FROM')")
def _(s):
    return artifacts.drift_register(*_facts(s))[1].select("id")


@query("op198_security_view", f"select concat('| ', {_J.format('title')}, ' | `iam` | `s \\| t` | * | s3:*, sqs:Get | US-0015 / — | ', conf, ' |') as line from facts_n where label = 'Finding'")
def _(s):
    return _body(artifacts.security_view(s.fact_nodes), 1)


@query(
    "op199_toolchain",
    f"""with d as (select src, string_agg(substr(dst, 11), ', ' order by substr(dst, 11)) as files from facts_e where label = 'DEFINED_IN' group by src)
 select concat('| ', {_J.format('display')}, ' | build | ', files, ' | ', case when {_J.format('settings_behind_code')} = 'true' then 'settings live in code — detected by presence only' else concat('a=', {_J.format('settings.a')}, '; b=x\\|y') end, ' | ', conf, ' |') as line from facts_n join d on d.src = id where label = 'Tool'""",
)
def _(s):
    return _body(artifacts.toolchain_view(*_facts(s)), 1)


@query("op202_projection_gaps", "select src, case when conf = 'InferredWeak' then 'UNRESOLVED' else label end as label, case when conf = 'InferredWeak' then concat('gap:projection:', substr(sha(concat(src, ' ', label, ' ', dst, ' ', hash, ' weak inference excluded by verified-only export')), 1, 16)) else dst end as dst, case when conf = 'InferredWeak' then 'Gap' else conf end as conf from edges where label = 'HANDLES'")
def _(s):
    hops = s.edges.where("label = 'HANDLES'").select("src", "label", "dst", "conf", "hash")
    return artifacts.projected(hops, hops.select("hash").limit(0)).select("src", "label", "dst", "conf")


@query("op202_rejected_hops", "select src, case when conf = 'InferredWeak' and ascii(hash) % 2 = 0 then 'UNRESOLVED' else label end as label, case when conf = 'InferredWeak' and ascii(hash) % 2 = 0 then 'inference rejected by Workbench curation' end as reason from edges where label = 'HANDLES'")
def _(s):
    hops = s.edges.where("label = 'HANDLES'").select("src", "label", "dst", "conf", "hash")
    return artifacts.projected(hops, hops.where("ascii(hash) % 2 = 0").select("hash"), best_effort=True).select("src", "label", "reason")


_COMPILED = f"""fn as (select * from facts_n where conf <> 'InferredWeak'), fe as (select * from facts_e where conf <> 'InferredWeak'),
 open as (select n.id, case when bool_or(e.conf = 'InferredStrong') then 'InferredStrong' else 'InferredStrong' end as conf from fn n join fe e on e.dst = n.id and e.label in ('PUBLISHES', 'SUBSCRIBES', 'BACKS') and e.conf <> 'Gap' where n.label = 'Channel' and n.id not in (select dst from fe where label = 'DECIDES') group by n.id),
 broken as (select distinct d.src as adr, e.src, e.label, e.dst from fe d join fe e on e.label = 'SUBSCRIBES' and e.conf <> 'Gap' and (e.src = d.dst or e.dst = d.dst) where d.label = 'DECIDES'),
 risks as (select id from fn where label = 'Endpoint' and conf <> 'Gap' and {_J.format('authenticated')} = 'false' union all select concat(src, dst) from fe where label = 'GRANTS' and props like '%s3:*%'),
 rs as (select id from fn where label = 'Resource' and conf <> 'Gap'), ch as (select id from fn where label = 'Channel' and id in (select dst from fe where label = 'BACKS')),
 ar as (select * from fe where label in ('SUBSCRIBES', 'GRANTS', 'BACKS', 'DEPENDS_ON') and conf <> 'Gap' and src in (select id from rs union select id from ch) and dst in (select id from rs union select id from ch)),
 en as (select id from fn where label = 'DataEntity'), ma as (select * from fe where label in ('READS', 'WRITES') and conf <> 'Gap' and dst in (select id from en) and src in (select id from fn))"""


@query(
    "op200_compile_spec",
    f"""with {_COMPILED} select 'user-stories' as artifact, count(*) as assertions from fn where label = 'Capability' and conf <> 'Gap'
 union all select 'us-tm', (select count(*) from fe where label in ('REALIZES', 'DECIDES') and conf <> 'Gap') + (select count(*) from open)
 union all select 'flow-dossiers', count(*) from facts_e where label in ('READS', 'WRITES')
 union all select 'topology', (select count(*) from rs) + (select count(*) from ch) + (select count(*) from ar)
 union all select 'data-model', (select count(distinct id) from (select id from en union select src from ma)) + (select count(*) from ma)
 union all select 'adrs', (select count(*) from fn where label = 'ADR') + (select count(*) from fe where label = 'DECIDES') + 2 * (select count(*) from open)
 union all select 'gap-register', (select count(*) from fn where label = 'Gap' or conf = 'Gap') + (select count(*) from fe where conf = 'Gap') + (select count(*) from facts_e where label in ('READS', 'WRITES') and conf in ('Gap', 'InferredWeak'))
 union all select 'drift-register', (select count(*) from fn where label = 'Drift') + (select count(*) from fe where label = 'CONFLICTS') + 2 * (select count(*) from broken) + (select count(distinct (adr, src, label, dst)) from broken)
 union all select 'security-view', (select count(*) from fn where label = 'Finding') + (select count(*) from risks)
 union all select 'toolchain', count(*) from fn where label = 'Tool'""",
)
def _(s):
    nodes, edges = _facts(s)
    hops = edges.where("label in ('READS', 'WRITES')").withColumn("trigger_id", F.col("src")).withColumn("ord", F.lit(0))
    triggers = nodes.where("label = 'Endpoint'").select(F.col("id").alias("trigger_id"), F.col("label").alias("kind"), F.lit(False).alias("depth_limited"))
    return artifacts.bundle_counts(artifacts.compile_spec(nodes, edges, hops, triggers))


@query("op044_artifact_text", f"with t as (select 1 as part, concat(src, ' ', label, ' ', dst) as key, {_TABLE} as line from facts_e where label in ('REALIZES', 'DECIDES') and conf <> 'Gap') select sha(string_agg(line, chr(10) order by part, key)) as text_sha256, count(*) as lines from t")
def _(s):
    lines = artifacts.traceability(s.fact_edges)[0].where("part = 1")
    # one small artifact, as text: its lines sorted and joined
    return lines.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "line"))), lambda x: x["line"]), "\n"), 256).alias("text_sha256"), F.count("*").alias("lines"))
