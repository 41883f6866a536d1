"""Queries over the derived graph: store, traversal, registers, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import graph, registers, resolve, semantic, store, vectors
from ..operators.lineage import temporary, written
from .derived import Source, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query of one Source under a name, with its SQL."""

    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run

    return register


N = ["id", "label", "name", "conf"]
E = ["src", "dst", "label", "conf"]


# --- store ------------------------------------------------------------------------------------------------
@query("op001_upsert_nodes", "select id, label, case when k % 3 = 0 then concat(name, '!') else name end as name from nodes where label <> 'Gap' union all select 'sym:new', 'Symbol', 'new'")
def _(s):
    n = s.nodes.select("id", "label", "name", "k").where("label <> 'Gap'")
    new = n.where("k % 3 = 0").withColumn("seq", F.lit(1)).withColumn("name", F.concat("name", F.lit("!")))
    stale = new.withColumn("seq", F.lit(0)).withColumn("name", F.lit("stale"))
    extra = s.spark.createDataFrame([("sym:new", "Symbol", "new", 0, 1)], "id string, label string, name string, k long, seq int")
    return store.upsert(n, new.unionByName(stale).unionByName(extra), store.NODE_KEY).select("id", "label", "name")


@query("op002_upsert_edges", "select src, dst, label, case when label = 'HANDLES' then 'InferredStrong' else conf end as conf from edges")
def _(s):
    e = s.edges.select(*E)
    new = e.where("label = 'HANDLES'").withColumn("conf", F.lit("InferredStrong")).withColumn("seq", F.lit(1))
    return store.upsert(e, new, store.EDGE_KEY)


@query("op003_delete_out_edges", "select src, dst, label from edges where not (label = 'FETCHES' and src in ('sym:n1', 'sym:n2', 'sym:n3'))")
def _(s):
    gone = s.spark.createDataFrame([(f"sym:n{k}", "FETCHES") for k in (1, 2, 3)], "src string, label string")
    return store.without(s.edges, gone, ["src", "label"]).select("src", "dst", "label")


@query("op004_delete_edges", "select src, dst, label from edges where not (label = 'RENDERS' and src = 'screen:r1')")
def _(s):
    return store.without(s.edges, s.edges.where("label = 'RENDERS' and src = 'screen:r1'"), store.EDGE_KEY).select("src", "dst", "label")


@query("op005_delete_nodes", "select src, dst, label from edges where src not in (select id from nodes where label = 'Gap' or (label = 'Channel' and k % 5 = 0)) and dst not in (select id from nodes where label = 'Gap' or (label = 'Channel' and k % 5 = 0))")
def _(s):
    return store.delete_nodes(s.nodes, s.edges, s.nodes.where("label = 'Gap' or (label = 'Channel' and k % 5 = 0)"))[1].select("src", "dst", "label")


@query("op006_get_node", "select id, label, name from nodes where id = 'chan:p17'")
def _(s):
    return s.nodes.where("id = 'chan:p17'").select("id", "label", "name").limit(1)


@query("op007_counts", "select (select count(*) from nodes) as n_nodes, (select count(*) from edges) as n_edges")
def _(s):
    return s.nodes.agg(F.count("*").alias("n_nodes")).join(s.edges.agg(F.count("*").alias("n_edges")), F.lit(True))


_REACH = "with recursive r as (select src as start, dst as node from cycles where src in ('u1', 'u2', 'u5') union select r.start, c.dst from r join cycles c on c.src = r.node) select start, node from r"


@query("op008_reachable_from", _REACH)
def _(s):
    starts = s.spark.createDataFrame([("u1",), ("u2",), ("u5",)], "start string")
    return graph.reachable(s.cycles, starts)


@query("op015_reachable_by_label", "with recursive c1 as (select src, dst from cycles where label = 'click'), r as (select src as start, dst as node from c1 union select r.start, c.dst from r join c1 c on c.src = r.node) select start, node from r")
def _(s):
    return graph.reachable_doubling(s.cycles.where("label = 'click'"))


@query("op009_all_nodes", "select id, label, name, conf from nodes")
def _(s):
    return s.nodes.select(*N).orderBy("id")


@query("op010_all_edges", "select src, dst, label, conf from edges")
def _(s):
    return s.edges.select(*E).orderBy("src", "dst", "label")


@query("op011_nodes_with_label", "select id, label, name, conf from nodes where label = 'Endpoint'")
def _(s):
    return s.nodes.where("label = 'Endpoint'").select(*N).orderBy("id")


@query("op012_edges_with_labels", "select src, dst, label, conf from edges where label in ('RENDERS', 'SUBSCRIBES')")
def _(s):
    return store.with_labels(s.edges, ["RENDERS", "SUBSCRIBES"]).select(*E)


@query("op012_no_labels", "select 'none' as labels, 0 as n union all select 'FETCHES', count(*) from edges where label = 'FETCHES'")
def _(s):
    asked = {"none": [], "FETCHES": ["FETCHES"]}
    none, some = (store.with_labels(s.edges, v).agg(F.lit(k).alias("labels"), F.count("*").alias("n")) for k, v in asked.items())
    return none.unionAll(some)


@query("op013_clear", "select 'before' as state, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges union all select 'after', 0, 0")
def _(s):
    size = lambda n, e, k: n.agg(F.lit(k).alias("state"), F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges")), F.lit(True))
    return size(s.nodes, s.edges, "before").unionAll(size(*store.cleared(s.nodes, s.edges), "after"))


_STORED = "id string, label string, name string", "src string, dst string, label string"


@query("op014_schema_gate", "select 'same' as version, (select count(*) from nodes) as n union all select 'other', 0")
def _(s):
    folder, out = temporary(s.spark, "graph"), []
    for state in ("same", "other"):
        store.write_graph(s.nodes.select("id", "label", "name"), s.edges.select("src", "dst", "label"), f"{folder}/{state}")
    s.spark.createDataFrame([(store.SCHEMA_VERSION - 1,)], "version int").write.mode("overwrite").parquet(f"{folder}/other/{store.VERSION_FILE}")
    for state in ("same", "other"):
        out.append(store.read_graph(s.spark, f"{folder}/{state}", *_STORED)[0].agg(F.lit(state).alias("version"), F.count("*").alias("n")))
    return out[0].unionAll(out[1])


@query("op043_stored_graph", "select src, dst, label from edges where label in ('RENDERS', 'FETCHES')")
def _(s):
    folder = temporary(s.spark, "graph")
    store.write_graph(s.nodes.select("id", "label", "name"), s.edges.select("src", "dst", "label"), folder)
    return store.read_graph(s.spark, folder, *_STORED)[1].where("label in ('RENDERS', 'FETCHES')").select("src", "dst", "label")


# --- provenance and projections -------------------------------------------------------------------------
_TIERS = "select id, case cast(k % 4 as int) when 0 then 'Deterministic' when 1 then 'Dynamic' when 2 then 'Semantic' else 'Agentic' end as t, case cast(k % 5 as int) when 0 then 'Confirmed' when 1 then 'InferredStrong' when 2 then 'InferredWeak' when 3 then 'Gap' else 'Bogus' end as c, extractor as x from nodes"
_RANK = "case {} when 'Gap' then 0 when 'InferredWeak' then 1 when 'InferredStrong' then 2 when 'Confirmed' then 3 end"
_VALID = "coalesce(" + _RANK.format("c") + " <= case t when 'Semantic' then 2 when 'Agentic' then 1 else 3 end, false)"


def _claims(s):
    t = F.element_at(F.array(*[F.lit(x) for x in X.TIERS]), (F.col("k") % 4 + 1).cast("int"))
    c = F.element_at(F.array(*[F.lit(x) for x in ("Confirmed", "InferredStrong", "InferredWeak", "Gap", "Bogus")]), (F.col("k") % 5 + 1).cast("int"))
    return s.nodes.select("id", t.alias("t"), c.alias("c"), F.col("extractor").alias("x"))


@query("op050_shown_provenance", f"with p as ({_TIERS}) select id, case when {_VALID} then t else 'Deterministic' end as tier, case when {_VALID} then c else 'Gap' end as conf, case when {_VALID} then x else 'spec.invalid-provenance' end as extractor from p")
def _(s):
    tier, conf, extractor = X.shown(F.col("t"), F.col("c"), F.col("x"))
    return _claims(s).select("id", tier.alias("tier"), conf.alias("conf"), extractor.alias("extractor"))


@query("op051_confidence_ceiling", f"with p as ({_TIERS}) select t, c, {_VALID} as ok, count(*) as n from p group by t, c, {_VALID}")
def _(s):
    return _claims(s).withColumn("ok", X.valid_provenance(F.col("t"), F.col("c"))).groupBy("t", "c", "ok").agg(F.count("*").alias("n"))


@query("op052_may_overwrite", f"with p as ({_TIERS}) select t, c, case when t in ('Deterministic', 'Dynamic') then true when t = 'Semantic' then c in ('InferredStrong', 'InferredWeak', 'Gap') else c in ('InferredWeak', 'Gap') end as ok, count(*) as n from p where c <> 'Bogus' group by all")
def _(s):
    return _claims(s).where("c <> 'Bogus'").withColumn("ok", X.may_overwrite(F.col("t"), F.col("c"))).groupBy("t", "c", "ok").agg(F.count("*").alias("n"))


@query("op053_gap_nodes", "select id from nodes where label = 'Gap' or conf = 'Gap'")
def _(s):
    return s.nodes.where(registers.GAP_NODE).select("id")


@query("op054_gap_edges", "select src, dst, label from edges where conf = 'Gap'")
def _(s):
    return s.edges.where(registers.GAP_EDGE).select("src", "dst", "label")


_REJECTED = "select hash from {} where k % 7 = 0"


@query("op056_export_verified", "select id, conf from nodes where conf <> 'InferredWeak' and not (conf = 'InferredStrong' and k % 7 = 0)")
def _(s):
    return registers.exported(s.nodes, s.nodes.where("k % 7 = 0"), False).select("id", "conf")


@query("op056_export_best_effort", "select id, conf from nodes where not (conf in ('InferredStrong', 'InferredWeak') and k % 7 = 0)")
def _(s):
    return registers.exported(s.nodes, s.nodes.where("k % 7 = 0"), True).select("id", "conf")


@query("op057_ordered_export", "select src, dst, label from edges where conf <> 'InferredWeak'")
def _(s):
    return s.edges.where("conf <> 'InferredWeak'").select("src", "dst", "label").orderBy("src", "dst", "label")


@query("op058_display_names", "select id, case when label = 'Endpoint' then concat('GET /customers/', cast(k as varchar)) when label = 'Gap' then id else name end as shown from nodes")
def _(s):
    name = F.when(F.col("label") != "Gap", F.col("name"))
    method, path = F.when(F.col("label") == "Endpoint", "GET"), F.when(F.col("label") == "Endpoint", F.concat(F.lit("/customers/"), F.col("k").cast("string")))
    return s.nodes.select("id", X.display_name(label=F.col("label"), name=name, method=method, path=path, id=F.col("id")).alias("shown"))


_FLOWN = """case label when 'Screen' then concat('Screen ', name) when 'Endpoint' then concat('GET /', name) when 'Component' then name when 'Symbol' then case when k % 2 = 0 then name else concat('f', k) end
 when 'Channel' then concat('kafka-topic:', name) when 'Gap' then 'GAP: unresolved' end"""


@query("op059_flow_names", f"select id, {_FLOWN} as shown from nodes union all select concat('extctx:', n_nationkey), case when n_nationkey % 2 = 0 then concat('popup · ', n_name) else 'context' end from nation union all select concat('extcmd:', n_nationkey), concat('Command ', n_name) from nation union all select concat('file:', n_nationkey), n_name from nation")
def _(s):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    one = lambda key, c: F.concat(F.lit('{"' + key + '":'), q(c), F.lit("}"))
    label, name = F.col("label"), F.col("name")
    props = F.when(label == "Screen", one("route", name)).when(label == "Endpoint", F.concat(F.lit('{"method":"GET","path":'), q(F.concat(F.lit("/"), name)), F.lit("}"))).when((label == "Component") | ((label == "Symbol") & (F.col("k") % 2 == 0)), one("name", name)).when(label == "Channel", F.concat(F.lit('{"kind":"kafka-topic","identity":'), q(name), F.lit("}"))).otherwise("{}")
    key = F.when((label == "Symbol") & (F.col("k") % 2 == 1), F.concat("id", F.lit("#f"), F.col("k").cast("string"))).otherwise(F.col("id"))
    main = s.nodes.select("id", X.flow_name(label, key, props).alias("shown"))
    n = s.table("nation")
    extra = None
    for kind, at, text in (("ExtensionContext", "extctx:", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"kind":"popup","entries":["'), "n_name", F.lit('"]}'))).otherwise('{"title":""}')), ("Command", "extcmd:", one("name", F.col("n_name"))), ("File", "file:", one("path", F.col("n_name")))):
        key = F.concat(F.lit(at), F.col("n_nationkey").cast("string"))
        rows = n.select(key.alias("id"), X.flow_name(F.lit(kind), key, text).alias("shown"))
        extra = rows if extra is None else extra.unionAll(rows)
    return main.unionAll(extra)


@query("op060_context_names", "select id, case when label = 'Gap' then id when label = 'Channel' then concat('i:', name) else name end as shown from nodes")
def _(s):
    channel = F.col("label") == "Channel"
    columns = {"name": F.when(~channel & (F.col("label") != "Gap"), F.col("name")), "identity": F.when(channel, F.concat(F.lit("i:"), "name")), "path": F.when(channel, "later"), "id": F.col("id")}
    return s.nodes.select("id", X.context_name(**columns).alias("shown"))


@query("op061_owned_by_evidence", "select o_custkey as owner, count(*) as n from (select o_custkey, list_distinct(list(o_orderstatus)) as ev from orders group by o_custkey) where ev = ['O'] group by o_custkey")
def _(s):
    ev = s.table("orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.collect_set("o_orderstatus").alias("ev"))
    return ev.where((F.size("ev") > 0) & F.forall("ev", lambda x: x == "O")).groupBy("owner").agg(F.count("*").alias("n"))


@query("op062_owned_by_id", "select split_part(id, ':', 1) as prefix, (id like 'sym:%' or id like 'ep:%' or id like 'screen:%') as owned, count(*) as n from nodes group by all")
def _(s):
    owned = X.id_owned(F.regexp_replace("id", "^([a-z]+):", "$1:repo@"), "repo")
    return s.nodes.select(F.substring_index("id", ":", 1).alias("prefix"), owned.alias("owned")).groupBy("prefix", "owned").agg(F.count("*").alias("n"))


@query("op069_layer_gate", "select id from nodes where extractor in ('ts', 'go')")
def _(s):
    hints = F.array(F.lit("ts"), F.lit("go"))
    return s.nodes.where((F.size(hints) == 0) | F.arrays_overlap(hints, F.array("extractor"))).select("id")


@query("op071_retain_side", "select src, dst, label from edges where src in (select id from nodes where extractor = 'go') and dst in (select id from nodes where extractor = 'events')")
def _(s):
    go, ev = (s.nodes.where(F.col("extractor") == x).select("id") for x in ("go", "events"))
    return s.edges.join(go.withColumnRenamed("id", "src"), "src", "left_semi").join(ev.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "label")


# --- traversal ------------------------------------------------------------------------------------------
_STEPS = """steps as (select src, dst, label, conf, false as reversed from edges where label in ('RENDERS', 'FETCHES', 'HANDLES', 'PUBLISHES')
 union all select dst, src, label, conf, true from edges where label = 'SUBSCRIBES'),
 links as (select distinct src, dst from steps where dst not in (select id from nodes where label = 'Gap')),
 a as (select id as t, id as node from nodes where label = 'Screen' union select a.t, l.dst from a join links l on l.src = a.node),
 fetched as (select distinct s.dst as id from a join steps s on s.src = a.node and s.label = 'FETCHES'),
 rest as (select id as t from nodes where label = 'Endpoint' and id not in (select id from fetched)
  union all select id from nodes where label = 'Channel' and id in (select dst from edges where label = 'SUBSCRIBES') and id not in (select dst from edges where label = 'PUBLISHES')),
 b as (select t, t as node from rest union select b.t, l.dst from b join links l on l.src = b.node),
 hops as (select r.t as trigger_id, s.* from (select * from a union all select * from b) r join steps s on s.src = r.node),
 triggers as (select id as t from nodes where label = 'Screen' union all select t from rest)"""
_SCORE = """select t as trigger_id, count(h.src) as hops, round(coalesce(avg(case h.conf when 'Confirmed' then 1.0 when 'InferredStrong' then 0.6 when 'InferredWeak' then 0.3 when 'Gap' then 0.0 end), 0), 9) as score,
 case when count(h.src) = 0 or bool_or(h.conf = 'Gap' {gap}) then 'Partial' when bool_and(h.conf = 'Confirmed') then 'Verified' else 'Inferred' end as status
 from triggers left join hops h on h.trigger_id = t group by t"""
_TRACE = f"with recursive {_STEPS} " + _SCORE.format(gap="or h.dst in (select id from nodes where label = 'Gap')")


def _graph(s):
    """Nodes and edges written, by the columns that traversals use: digests alone would take more disk than all others."""
    return _nodes(s), written(s.edges.select(*E), "edges")


def _nodes(s):
    return written(s.nodes.select("id", "label"), "nodes")


@query("flow_trace_set", _TRACE)
def flow_trace_set(s):
    nodes = _nodes(s)
    return graph.Flows(nodes, s.edges).scores(nodes.where("label = 'Gap'").select("id")).withColumn("score", F.round("score", 9))


@query("op127_projected_scores", f"with recursive {_STEPS} " + _SCORE.format(gap=""))
def _(s):
    return graph.Flows(_nodes(s), s.edges).scores(None).withColumn("score", F.round("score", 9))


_NEW_EDGES = """select src, dst, label, case when conf = 'InferredWeak' and dst like '%9' then 'Confirmed' else conf end as conf from edges
 where not (label = 'FETCHES' and src = 'sym:n3') and not (label = 'SUBSCRIBES' and src like '%7')"""
_NEW_NODES = "select id, case when label = 'Gap' and id like '%@2' then 'Symbol' else label end as label from nodes"
_RETRACE = _TRACE[len("with recursive ") :].replace("from edges", "from new_edges").replace("from nodes", "from new_nodes")


@query("op170_retraced_flows", f"with recursive new_edges as ({_NEW_EDGES}), new_nodes as ({_NEW_NODES}), {_RETRACE}")
def _(s):
    nodes, edges = _graph(s)
    new_edges = written(s.spark.sql(_NEW_EDGES.replace("from edges", "from {edges}"), edges=edges), "edges")
    new_nodes = written(s.spark.sql(_NEW_NODES.replace("from nodes", "from {nodes}"), nodes=nodes), "nodes")
    changed = lambda old, new, key, by: store.reconcile(old, new, key, by, F.lit(True)).where("action <> 'unchanged'").drop("action")
    gaps = lambda n: n.where("label = 'Gap'").select("id")
    before = graph.Flows(nodes, edges)
    after = graph.Retraced(before, new_nodes, new_edges, changed(nodes, new_nodes, ["id"], "label"), changed(edges, new_edges, ["src", "dst", "label"], "conf"))
    return after.scores(before.scores(gaps(nodes)), gaps(new_nodes)).withColumn("score", F.round("score", 9))


@query("op126_scores_from_hops", _TRACE)
def _(s):
    nodes, edges = _graph(s)
    hops, triggers = graph.trace_set(nodes, edges)
    return graph.flow_scores(hops, triggers, nodes.where("label = 'Gap'").select("id")).withColumn("score", F.round("score", 9))


_CHAIN = "select concat('s', k // 100, '.', k % 100) as src, concat('s', k // 100, '.', k % 100 + 1) as dst, k // 100 as c, k % 100 as i from (select c_custkey as k from customer) where k % 100 < 7 * (k // 100 + 1) + 17"


@query("op174_depth_bound", f"with ch as ({_CHAIN}) select concat('s', c, '.0') as trigger_id, least(count(*), 64) as hops, case when count(*) > 64 then 'Partial' else 'Verified' end as status from ch group by c")
def _(s):
    k = F.col("id")
    c, i = F.floor(k / 100), k % 100
    ids = lambda x: F.concat(F.lit("s"), c.cast("string"), F.lit("."), x.cast("string"))
    chain = s.table("customer").select(F.col("c_custkey").alias("id")).where(i < 7 * (c + 1) + 17)
    edges = chain.select(ids(i).alias("src"), ids(i + 1).alias("dst"), F.lit("CALLS").alias("label"), F.lit("Confirmed").alias("conf"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ends.select("id", F.when(F.col("id").endswith(".0"), "Screen").otherwise("Symbol").alias("label"))
    return graph.Flows(nodes, edges).scores(None).select("trigger_id", "hops", "status")


@query("op170_flow_trace_exact", _TRACE)
def _(s):
    nodes, edges = _graph(s)
    fetched = graph.reachable(edges.where("label in ('RENDERS', 'FETCHES')"), nodes.where("label = 'Screen'").select(F.col("id").alias("start"))).select(F.col("node").alias("id")).distinct()
    published = edges.where("label = 'PUBLISHES'").select(F.col("dst").alias("id")).distinct()
    consumed = edges.where("label = 'SUBSCRIBES'").select(F.col("dst").alias("id")).distinct()
    rest = nodes.where("label = 'Endpoint'").select("id").join(fetched, "id", "left_anti").unionAll(nodes.where("label = 'Channel'").select("id").join(consumed, "id", "left_semi").join(published, "id", "left_anti"))
    triggers = written(nodes.where("label = 'Screen'").select("id").unionAll(rest).withColumnRenamed("id", "trigger_id"), "triggers")
    hops = graph.trace_exact(nodes, edges, triggers)
    return graph.flow_scores(hops, triggers, nodes.where("label = 'Gap'").select("id")).withColumn("score", F.round("score", 9))


@query("op171_triggers", f"with recursive {_STEPS} select t as trigger_id from triggers")
def _(s):
    return graph.Flows(_nodes(s), s.edges).triggers.select("trigger_id")


@query("op172_steps", "select src, dst, label, false as reversed from edges where label in ('RENDERS', 'FETCHES', 'HANDLES', 'PUBLISHES') union all select dst, src, label, true from edges where label = 'SUBSCRIBES'")
def _(s):
    return graph.steps_of(s.edges).select("src", "dst", "label", "reversed")


@query("op173_hops_into_gaps", f"with recursive {_STEPS} select trigger_id, count(*) as n from hops where dst in (select id from nodes where label = 'Gap') group by trigger_id")
def _(s):
    nodes, edges = _graph(s)
    return graph.trace_set(nodes, edges)[0].join(nodes.where("label = 'Gap'").select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("trigger_id").agg(F.count("*").alias("n"))


@query("op128_anchor_probes", "select 'Screen' as anchor, count(*) as n from nodes where label = 'Screen' union all select 'ExtensionContext', 0 union all select 'Command', 0 union all select 'Endpoint', count(*) from nodes where label = 'Endpoint' union all select 'Channel', count(*) from nodes where label = 'Channel' and id in (select dst from edges where label = 'SUBSCRIBES') and id not in (select dst from edges where label = 'PUBLISHES')")
def _(s):
    consumed = s.edges.where("label = 'SUBSCRIBES'").select(F.col("dst").alias("id")).distinct()
    published = s.edges.where("label = 'PUBLISHES'").select(F.col("dst").alias("id")).distinct()
    channels = s.nodes.where("label = 'Channel'").select("id", "label").join(consumed, "id", "left_semi").join(published, "id", "left_anti")
    counted = s.nodes.where("label in ('Screen', 'ExtensionContext', 'Command', 'Endpoint')").select("id", "label").unionAll(channels).groupBy(F.col("label").alias("anchor")).agg(F.count("*").alias("n"))
    kinds = s.spark.createDataFrame([(k,) for k in ("Screen", "ExtensionContext", "Command", "Endpoint", "Channel")], "anchor string")
    return kinds.join(counted, "anchor", "left").select("anchor", F.coalesce("n", F.lit(0)).alias("n"))


_HOPS = """with recursive nb as (select src, dst from edges union select dst, src from edges),
 d as (select 'chan:p7' as id, 0 as hop union select b.dst, d.hop + 1 from d join nb b on b.src = d.id where d.hop < 2),
 dist as (select id, min(hop) as hop from d group by id)"""


@query("op175_k_hop", f"{_HOPS} select id, hop from dist")
def _(s):
    nodes, edges = _graph(s)
    return graph.k_hop(nodes, edges, s.spark.createDataFrame([("chan:p7",)], "id string"), 2)[0]


@query("op175_induced_edges", f"{_HOPS} select src, dst, label from edges where src in (select id from dist) and dst in (select id from dist)")
def _(s):
    nodes, edges = _graph(s)
    return graph.k_hop(nodes, edges, s.spark.createDataFrame([("chan:p7",)], "id string"), 2)[2].select("src", "dst", "label")


@query("op176_packed_context", f"{_HOPS}, lines as (select d.hop, 0 as kind, n.id, concat(n.label, ' ', n.id) as line from nodes n join dist d on d.id = n.id), c as (select *, sum(strlen(line) + 1) over (order by hop, kind, id) as used from lines) select id, used from c where used <= 4000")
def _(s):
    nodes, edges = _graph(s)
    inside = graph.k_hop(nodes, edges, s.spark.createDataFrame([("chan:p7",)], "id string"), 2)[1]
    lines = inside.select("hop", F.lit(0).alias("kind"), "id", F.concat_ws(" ", "label", "id").alias("line"))
    return graph.packed(lines, 4000).select("id", "used")


@query("op182_cluster_rollup", "select a.label as src_label, b.label as dst_label, e.label, count(*) as n from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst group by all")
def _(s):
    return graph.hop_counts_by_cluster(s.nodes, s.edges)


# --- aggregations and registers -------------------------------------------------------------------------
@query("op120_tier_tallies", "select conf, count(*) as n from (select conf from nodes union all select conf from edges) group by conf")
def _(s):
    return registers.tier_tallies(s.nodes, s.edges)


@query("op121_coverage", "with f as (select source as extractor, count(*) as facts, count(distinct concat(source, ':', lang)) as files from documents where source is not null group by source), sc as (select distinct concat('src', cast(p_size % 25 as varchar)) as extractor, p_size % 25 % 6 as scope_files from part) select coalesce(f.extractor, sc.extractor) as extractor, coalesce(facts, 0) as facts, coalesce(files, 0) as files, case when sc.extractor is null then null when scope_files = 0 then 0.0 else round(100.0 * coalesce(files, 0) / scope_files, 6) end as percent from f full outer join sc on f.extractor = sc.extractor")
def _(s):
    docs = s.table("documents").where("source is not null").select(F.col("source").alias("extractor"), F.concat_ws("", "source", F.lit(":"), "lang").alias("file"))
    scope = s.table("part").select(F.concat(F.lit("src"), (F.col("p_size") % 25).cast("string")).alias("extractor"), (F.col("p_size") % 25 % 6).alias("scope_files")).distinct()
    return registers.coverage(docs, scope)


_WORDS = ", ".join(f"cast(coalesce(sum(cast(('0x' || substr(h, {8 * k + 1}, 8)) as bigint)), 0) as varchar)" for k in range(8))
_LINES = "lines as (select concat_ws(' ', 'n', id, label, hash) as l from nodes union all select concat_ws(' ', 'e', src, label, dst, hash) from edges), d as (select sha(l) as h from lines)"


@query("op122_graph_hash", f"with {_LINES} select sha(concat_ws(' ', cast(count(*) as varchar), {_WORDS})) as graph_hash from d")
def _(s):
    return store.graph_hash(s.nodes, s.edges)


@query("op123_deterministic_lines", "select concat_ws(' ', 'n', id, label, hash) as line from nodes where tier = 'Deterministic' union all select concat_ws(' ', 'e', src, label, dst, hash) from edges where tier = 'Deterministic'")
def _(s):
    return registers.deterministic_lines(s.nodes, s.edges)


_FINDINGS = "(select count(*) from nodes where label = 'Gap' or conf = 'Gap') + (select count(*) from edges where conf = 'Gap' and src not in (select id from nodes where label = 'Gap') and dst not in (select id from nodes where label = 'Gap'))"


@query("op124_register_summary", f"select {_FINDINGS} as gaps, (select count(*) from nodes where conf = 'InferredWeak') as unsupported, {_FINDINGS} + (select count(*) from nodes where conf = 'InferredWeak') as open, (select count(*) from nodes) + (select count(*) from edges) as graph_facts")
def _(s):
    return registers.summary(s.nodes, s.edges)


@query("op125_gap_findings", f"select {_FINDINGS} as findings")
def _(s):
    return registers.gap_findings(s.nodes, s.edges)


@query("op130_gap_classes", "select o.o_orderpriority as reason, l_shipmode_ as extractor, count(*) as n, count(*) filter (o_orderstatus = 'P') as blocking from (select l_orderkey, l_linestatus as l_shipmode_ from lineitem where l_returnflag = 'R' and l_quantity < 5) l join orders o on o.o_orderkey = l.l_orderkey group by all")
def _(s):
    gaps = s.table("lineitem").where("l_returnflag = 'R' and l_quantity < 5").join(s.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return registers.gap_classes(gaps.select(F.col("o_orderpriority").alias("reason"), F.col("l_linestatus").alias("extractor"), (F.col("o_orderstatus") == "P").alias("in_flow")))


@query("op131_determinism", "with h as (select cast(o_custkey % 50 as varchar) as repo, o_orderpriority as sha, case when o_custkey % 50 = 3 then o_orderstatus else 'x' end as graph_hash from orders), g as (select repo, sha, count(*) as n, count(distinct graph_hash) as d from h group by all) select case when bool_or(n >= 2 and d > 1) then 'violated' when bool_or(n >= 2) then 'verified' else 'unproven' end as verdict from g")
def _(s):
    h = s.table("orders").select((F.col("o_custkey") % 50).cast("string").alias("repo"), F.col("o_orderpriority").alias("sha"), F.when(F.col("o_custkey") % 50 == 3, F.col("o_orderstatus")).otherwise("x").alias("graph_hash"))
    return registers.determinism(h)


@query("op132_recovery_authority", "select conf, case conf when 'Confirmed' then 'authoritative' when 'Gap' then 'partial' else 'inferred' end as authority, count(*) as n from edges group by all")
def _(s):
    return s.edges.select("conf", registers.authority(F.col("conf")).alias("authority")).groupBy("conf", "authority").agg(F.count("*").alias("n"))


@query("op133_first_commit", 'select o_custkey as repo, min_by(o_orderpriority, o_orderkey) as "first" from orders group by o_custkey')
def _(s):
    return registers.first_per(s.table("orders").withColumnRenamed("o_custkey", "repo"), "repo", F.col("o_orderpriority"), F.col("o_orderkey"))


@query("op134_extractor_counters", "select extractor, count(*) as nodes, count(distinct k) as files from nodes group by extractor")
def _(s):
    return registers.counters(s.nodes, "extractor", "k")


@query("op135_languages", "select lang, count(*) as n, min_by(source, doc_id) as first_source from documents where lang is not null group by lang")
def _(s):
    return s.table("documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.min_by("source", "doc_id").alias("first_source"))


@query("op136_tool_merge", "select p_brand as tool, min_by(p_type, p_partkey) as setting, bool_or(p_size > 45) as behind_code, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as proofs from part group by p_brand")
def _(s):
    return registers.merged_tools(s.table("part").select(F.col("p_brand").alias("tool"), F.col("p_type").alias("setting"), (F.col("p_size") > 45).alias("behind_code"), F.col("p_partkey").alias("proof")))


@query("op137_evidence_union", "select l_orderkey as k, string_agg(concat_ws(':', f, cast(a as varchar), cast(b as varchar)), ',' order by f, a, b) as evidence from (select distinct l_orderkey, l_returnflag as f, l_partkey % 5 as a, l_suppkey % 3 as b from lineitem) group by l_orderkey")
def _(s):
    ev = F.array(F.struct(F.col("l_returnflag").alias("f"), (F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 3).alias("b")))
    out = registers.union_of_evidence(s.table("lineitem").select(F.col("l_orderkey").alias("k"), ev.alias("evidence")), "k")
    return out.select("k", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["f"], e["a"].cast("string"), e["b"].cast("string"))), ",").alias("evidence"))


@query("op138_action_sets", "select o_custkey as target, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as actions from orders group by o_custkey")
def _(s):
    return registers.action_sets(s.table("orders").select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("action")))


@query("op146_hop_order", "select src, dst, label, row_number() over (partition by src order by label, dst) as place from edges where label in ('HANDLES', 'PUBLISHES')")
def _(s):
    from pyspark.sql import Window

    return s.edges.where("label in ('HANDLES', 'PUBLISHES')").select("src", "dst", "label", F.row_number().over(Window.partitionBy("src").orderBy("label", "dst")).alias("place"))


# --- resolution joins -----------------------------------------------------------------------------------
@query("op080_calls", "select concat('call', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as call_id, case when p.p_partkey is null then concat('gap:call:call', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) else concat('chan:p', cast(l_partkey as varchar)) end as dst, case when p.p_partkey is null then 'Gap' else 'Confirmed' end as conf from lineitem left join part p on p.p_partkey = l_partkey and p.p_size % 4 > 0")
def _(s):
    line = s.table("lineitem")
    calls = line.select(F.concat(F.lit("call"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("call_id"), F.concat(F.lit("sym:o"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("chan:p"), F.col("l_partkey").cast("string")).alias("candidate"))
    known = s.table("part").where("p_size % 4 > 0").select(F.concat(F.lit("chan:p"), F.col("p_partkey").cast("string")).alias("id"))
    return resolve.calls_or_gaps(calls, known).select("call_id", "dst", "conf")


@query("op081_calls_relative_only", "select concat('c', cast(o_orderkey as varchar)) as call_id, case when c.c_custkey is null then concat('gap:call:c', cast(o_orderkey as varchar)) else concat('ep:c', cast(o_custkey as varchar)) end as dst from orders left join customer c on c.c_custkey = o_custkey and c.c_acctbal > 0 where c.c_custkey is not null or o_orderstatus = 'F'")
def _(s):
    calls = s.table("orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("call_id"), F.lit("x").alias("caller"), F.concat(F.lit("ep:c"), F.col("o_custkey").cast("string")).alias("candidate"), (F.col("o_orderstatus") == "F").alias("relative"))
    known = s.table("customer").where("c_acctbal > 0").select(F.concat(F.lit("ep:c"), F.col("c_custkey").cast("string")).alias("id"))
    return resolve.calls_or_gaps(calls, known, F.col("relative")).select("call_id", "dst")


@query("op082_calls_last_wins", "with d as (select p_brand, p_size, max_by(p_partkey, p_partkey) as target from part group by p_brand, p_size) select q.p_partkey as call, d.target from part q join d on d.p_brand = q.p_brand and d.p_size = q.p_size where q.p_partkey % 2 = 0")
def _(s):
    defs = s.table("part").select("p_brand", "p_size", F.col("p_partkey").alias("target"))
    calls = s.table("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("call"), "p_brand", "p_size")
    return resolve.last_wins_join(calls, defs.withColumn("seq", F.col("target")), ["p_brand", "p_size"], "seq").select("call", "target")


_UNIQUE = "with r as (select l_partkey, count(*) as candidates, min(l_suppkey) as target from (select distinct l_partkey, l_suppkey from lineitem where l_linenumber = 1) group by 1) select p_partkey as part, coalesce(candidates, 0) as candidates, case when candidates = 1 then target end as target from part left join r on l_partkey = p_partkey"


_TYPED = """with q as (select p_partkey as call, case when p_size % 5 = 0 then 'ext' else p_brand end as package, concat(case when p_size % 5 = 0 then 'ext' else p_brand end, '.', case when p_size % 4 = 0 then 'Missing' else concat(p_type, cast(p_size as varchar)) end) as fqn from part),
 t as (select concat(p_brand, '.', p_type, cast(p_size as varchar)) as fqn, count(*) as n, min(p_partkey) as id from part group by 1)
 select call, case when n = 1 then concat('type:', cast(id as varchar)) else concat('gap:call:', cast(call as varchar)) end as dst, case when n = 1 then 'Confirmed' else 'Gap' end as conf from q left join t on t.fqn = q.fqn where n is not null or package in (select p_brand from part)"""


@query("op083_typed_calls", _TYPED)
def _(s):
    p = s.table("part")
    package = F.when(F.col("p_size") % 5 == 0, "ext").otherwise(F.col("p_brand"))
    calls = p.select(F.col("p_partkey").alias("call"), package.alias("package"), F.concat(package, F.lit("."), F.when(F.col("p_size") % 4 == 0, "Missing").otherwise(F.concat("p_type", F.col("p_size").cast("string")))).alias("fqn"))
    types = p.select(F.concat("p_brand", F.lit("."), "p_type", F.col("p_size").cast("string")).alias("fqn"), F.col("p_brand").alias("package"), F.concat(F.lit("type:"), F.col("p_partkey").cast("string")).alias("id"))
    return resolve.typed_calls(calls, types)


@query("op092_unique_resources", _UNIQUE)
def _(s):
    right = s.table("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("target")).distinct()
    return resolve.unique_match(s.table("part").select(F.col("p_partkey").alias("part")), right, ["part"])


@query("op085_first_candidate", "with c as (select p_partkey as ask, unnest([concat(p_type, '.ts'), concat(p_type, '.tsx'), concat(p_type, '/index.ts')]) as path, unnest([0, 1, 2]) as ord from part), e as (select distinct concat(p_type, case when p_size % 3 = 0 then '.tsx' when p_size % 3 = 1 then '/index.ts' else '.js' end) as path from part where p_size > 40) select ask, min_by(c.path, ord) as path from c join e on e.path = c.path group by ask")
def _(s):
    p = s.table("part")
    asks = p.select(F.col("p_partkey").alias("ask"), F.array(*[F.concat("p_type", F.lit(x)) for x in (".ts", ".tsx", "/index.ts")]).alias("candidates"))
    files = p.where("p_size > 40").select(F.concat("p_type", F.when(F.col("p_size") % 3 == 0, ".tsx").when(F.col("p_size") % 3 == 1, "/index.ts").otherwise(".js")).alias("path"))
    return resolve.first_candidate(asks, files)


@query("op086_nearest_scope", "with f as (select concat(cast(o_custkey % 7 as varchar), '/', cast(o_custkey % 5 as varchar), '/', cast(o_orderkey as varchar), '.ts') as path from orders), d as (select '' as dir union all select distinct cast(c_custkey % 4 as varchar) from customer union all select distinct concat(cast(c_custkey % 4 as varchar), '/', cast(c_custkey % 3 as varchar)) from customer) select path, max_by(dir, length(dir)) as dir from f join d on dir = '' or starts_with(path, concat(dir, '/')) group by path")
def _(s):
    k = lambda c, n: (F.col(c) % n).cast("string")
    files = s.table("orders").select(F.concat_ws("/", k("o_custkey", 7), k("o_custkey", 5), F.concat(F.col("o_orderkey").cast("string"), F.lit(".ts"))).alias("path"))
    c = s.table("customer")
    scopes = s.spark.createDataFrame([("",)], "dir string").unionAll(c.select(k("c_custkey", 4))).unionAll(c.select(F.concat_ws("/", k("c_custkey", 4), k("c_custkey", 3))))
    return resolve.nearest_scope(files, scopes)


@query("op088_first_definition", "with c as (select concat('K', cast(user_id as varchar)) as key, event_type as value, ts, event_id from events), f as (select key, arg_min(value, row(ts, event_id)) as value from c group by key) select key, case when key = 'K3' then 'manifest' else value end as value from f")
def _(s):
    config = s.table("events").select(F.concat(F.lit("K"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("file"), F.col("event_id").alias("line"))
    manifest = s.spark.createDataFrame([("K3", "manifest")], "key string, value string")
    first = resolve.first_definition(config)
    return resolve.first_definition(config, manifest.join(first.select("key"), "key", "left_semi"))


_SITES = "select concat('s', cast(event_id as varchar)) as site, event_type as kind, case when event_id % 2 = 0 then 'Produces' else 'Consumes' end as role, case event_id % 3 when 0 then 'Literal' when 1 then 'EnvRef' else 'Computed' end as id_kind, concat('E', cast(user_id % 40 as varchar)) as id_value from events"


def _sites(s):
    e = s.table("events")
    kind = F.when(F.col("event_id") % 3 == 0, "Literal").when(F.col("event_id") % 3 == 1, "EnvRef").otherwise("Computed")
    sites = e.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("site"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "Produces").otherwise("Consumes").alias("role"), kind.alias("id_kind"), F.concat(F.lit("E"), (F.col("user_id") % 40).cast("string")).alias("id_value"), F.lit("sym:x").alias("symbol"))
    env = s.table("nation").select(F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return sites, env


@query("op089_stitched_channels", f"with si as ({_SITES}) select site, concat('chan:', kind, ':', case when id_kind = 'Literal' then id_value else n_name end) as dst, case when role = 'Produces' then 'PUBLISHES' else 'SUBSCRIBES' end as label from si left join nation on concat('E', cast(n_nationkey as varchar)) = id_value where id_kind = 'Literal' or (id_kind = 'EnvRef' and n_name is not null)")
def _(s):
    return resolve.stitched_channels(*_sites(s))[0].select("site", "dst", "label")


@query("op089_channel_gaps", f"with si as ({_SITES}) select site, concat('gap:chan:', site) as gap, case when id_kind = 'EnvRef' then concat('environment key not defined: ', id_value) else 'computed identity' end as reason from si left join nation on concat('E', cast(n_nationkey as varchar)) = id_value where not (id_kind = 'Literal' or (id_kind = 'EnvRef' and n_name is not null))")
def _(s):
    return resolve.stitched_channels(*_sites(s))[1]


@query("op090_fetches", """with si as (select page_id as site, case when page_id % 11 = 0 then null else regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') end as u, case when page_id % 13 = 0 then '?' else 'GET' end as method from pages),
 en as (select 'a' as id, '/en/:id' as route union all select 'b', '/fr/:id' union all select 'c', '/:lang/7' union all select 'd', '/de/:id'),
 h as (select site, count(distinct id) as n, min(id) as t from si join en on len(string_split(u, '/')) = 3 and (route in ('/en/:id', '/fr/:id', '/de/:id') and split_part(route, '/', 2) = split_part(u, '/', 2) and split_part(u, '/', 3) <> '' or route = '/:lang/7' and split_part(u, '/', 3) = '7' and split_part(u, '/', 2) <> '') where u is not null and method <> '?' group by site)
 select si.site, case when u is null then 'url not resolved' when method = '?' then 'method not resolved' when n = 1 then 'matched' when n is null then 'no recovered endpoint' else concat('ambiguous (', cast(n as varchar), ' candidates)') end as status, case when n = 1 then t end as target, coalesce(n, 0) as candidates from si left join h on h.site = si.site""")
def _(s):
    url = F.when(F.col("page_id") % 11 != 0, X.url_path(F.col("url")))
    sites = s.table("pages").select(F.col("page_id").alias("site"), F.lit("r").alias("repo"), F.when(F.col("page_id") % 13 == 0, "?").otherwise("GET").alias("method"), url.alias("url"))
    ends = s.spark.createDataFrame([("a", "/en/:id"), ("b", "/fr/:id"), ("c", "/:lang/7"), ("d", "/de/:id")], "id string, route string").withColumns({"repo": F.lit("r"), "method": F.lit("GET")})
    return resolve.fetches(sites, ends)


@query("op096_policy_expansion", "with g as (select o_custkey as principal, cast(o_orderkey as varchar) as document from orders where o_orderstatus = 'F'), st as (select cast(l_orderkey as varchar) as document, concat('p', cast(l_partkey % 50 as varchar)) as target, l_returnflag as action from lineitem where l_quantity < 20) select principal, coalesce(target, g.document) as target, coalesce(string_agg(distinct action, ',' order by action), '') as actions from g left join st on st.document = g.document group by 1, 2")
def _(s):
    grants = s.table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("principal"), F.col("o_orderkey").cast("string").alias("document"))
    st = s.table("lineitem").where("l_quantity < 20").select(F.col("l_orderkey").cast("string").alias("document"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("target"), F.array("l_returnflag").alias("actions"))
    return resolve.expanded_policies(grants, st).withColumn("actions", F.array_join("actions", ","))


@query("op100_recovered_decisions", "select n.id, case when bool_or(e.conf = 'InferredWeak') then 'InferredWeak' else 'InferredStrong' end as conf from nodes n join edges e on e.dst = n.id and e.label in ('PUBLISHES', 'SUBSCRIBES') and e.conf <> 'Gap' where n.label = 'Channel' and n.k % 10 > 0 group by n.id")
def _(s):
    channels = s.nodes.where("label = 'Channel'")
    return registers.ungoverned_channels(channels, channels.where("k % 10 = 0"), s.edges)


@query("op101_drift", "with d as (select concat('adr', cast(p_partkey as varchar)) as adr, concat('chan:p', cast(p_partkey as varchar)) as governs, 'SUBSCRIBES' as forbids from part where p_size = 7 union all select 'adr:s', concat('sym:s', cast(s_suppkey as varchar)), 'SUBSCRIBES' from supplier) select distinct adr, src, dst, label from d join edges on label = forbids and (src = governs or dst = governs) and conf <> 'Gap'")
def _(s):
    d = s.table("part").where("p_size = 7").select(F.concat(F.lit("adr"), F.col("p_partkey").cast("string")).alias("adr"), F.concat(F.lit("chan:p"), F.col("p_partkey").cast("string")).alias("governs"), F.lit("SUBSCRIBES").alias("forbids"))
    d = d.unionAll(s.table("supplier").select(F.lit("adr:s"), F.concat(F.lit("sym:s"), F.col("s_suppkey").cast("string")), F.lit("SUBSCRIBES")))
    return registers.drift(d, s.edges)


@query("op101_drift_triggers", "with d as (select concat('adr', cast(p_partkey as varchar)) as adr, concat('chan:p', cast(p_partkey as varchar)) as governs from part where p_size = 7), h as (select concat('t', l_linenumber) as t, concat('sym:s', l_suppkey) as src, concat('chan:p', l_partkey) as dst from lineitem) select adr, e.src, e.dst, coalesce(string_agg(distinct t, ',' order by t), '') as triggers from d join edges e on e.label = 'SUBSCRIBES' and e.dst = governs and conf <> 'Gap' left join h on h.src = e.src and h.dst = e.dst group by all")
def _(s):
    k = F.col("p_partkey").cast("string")
    rules = s.table("part").where("p_size = 7").select(F.concat(F.lit("adr"), k).alias("adr"), F.concat(F.lit("chan:p"), k).alias("governs"), F.lit("SUBSCRIBES").alias("forbids"))
    hops = s.table("lineitem").select(F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("trigger_id"), F.concat(F.lit("sym:s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("chan:p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("SUBSCRIBES").alias("label"))
    return registers.with_triggers(registers.drift(rules, s.edges), hops).select("adr", "src", "dst", F.array_join("flow_triggers", ",").alias("triggers"))


_APPROVED = "select concat('sym:o', cast(l_orderkey as varchar)) as src, concat('gap:o', cast(l_orderkey as varchar), '@', cast(l_linenumber as varchar)) as gap, concat('chan:p', cast(l_partkey as varchar)) as target from lineitem where l_returnflag = 'R' and l_quantity < 3"


@query("op102_overlay", f"with a as ({_APPROVED}), kept as (select src, dst, label, conf from edges where dst not in (select gap from a)), new as (select a.src, target as dst, 'PUBLISHES' as label, 'InferredStrong' as conf from a) select src, dst, label, conf from kept union all select distinct src, dst, label, conf from new where not exists (select 1 from kept k where k.src = new.src and k.dst = new.dst and k.label = new.label)")
def _(s):
    line = s.table("lineitem").where("l_returnflag = 'R' and l_quantity < 3")
    key, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    approved = line.select(F.concat(F.lit("sym:o"), key).alias("src"), F.concat(F.lit("gap:o"), key, F.lit("@"), F.col("l_linenumber").cast("string")).alias("gap"), F.lit("PUBLISHES").alias("label"), F.concat(F.lit("chan:p"), part).alias("target"), F.lit("InferredStrong").alias("conf"))
    return resolve.replaced_gaps(s.nodes, s.edges, approved)[1]


@query("op103_topology", "select e.src, e.dst, e.label from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst where e.label in ('PUBLISHES', 'SUBSCRIBES') and b.label = 'Channel'")
def _(s):
    ids = s.nodes.select("id", "label")
    return s.edges.where("label in ('PUBLISHES', 'SUBSCRIBES')").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.where("label = 'Channel'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "label")


@query("op104_closure", "select distinct id, case split_part(id, ':', 1) when 'sym' then 'Symbol' when 'ep' then 'Endpoint' when 'chan' then 'Channel' when 'gap' then 'Gap' end as label from (select src as id from edges union select dst from edges) where id not in (select id from nodes where k % 9 > 0 or label in ('Screen', 'Component')) and id not like 'screen:%' and id not like 'sym:n%'")
def _(s):
    return store.closure(s.nodes.where("k % 9 > 0 or label in ('Screen', 'Component')"), s.edges)


@query("op107_config_dedup", "select o_orderkey as file from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def _(s):
    return s.table("orders").select(F.col("o_orderkey").alias("file")).join(s.table("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("file")).distinct(), "file", "left_anti")


@query("op108_worst_claims", "with c as (select cast(l_orderkey as varchar) as path, l_linenumber as line, case when l_returnflag = 'R' then 'Dynamic' when l_returnflag = 'A' then 'ConstUnproven' else 'Const' end as outcome from lineitem where l_quantity > 10) select path, line, case when count(outcome) = 0 or bool_or(outcome = 'Dynamic') then 'unsupported' when bool_or(outcome = 'ConstUnproven') then 'potential gap' else 'closed' end as verdict from (select distinct cast(l_orderkey as varchar) as path, l_linenumber as line from lineitem) f left join c using (path, line) group by path, line")
def _(s):
    line = s.table("lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "Dynamic").when(F.col("l_returnflag") == "A", "ConstUnproven").otherwise("Const").alias("outcome"), "l_quantity")
    return resolve.worst_claims(line.where("l_quantity > 10"), line.select("path", "line").distinct())


@query("op109_proven_constants", "with k as (select p_brand, p_type, case when count(distinct p_size) = 1 then cast(min(p_size) as varchar) end as value from part group by 1, 2) select l_orderkey * 100000 + l_partkey as use, k.value from lineitem l left join (select p_partkey, p_brand, p_type from part) i on i.p_partkey = l_partkey left join k on k.p_brand = i.p_brand and k.p_type = i.p_type where l_linenumber = 2")
def _(s):
    uses = s.table("lineitem").where("l_linenumber = 2").select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("use"), F.lit("f").alias("file"), F.col("l_partkey").cast("string").alias("name"), F.lit("m").alias("member"))
    part = s.table("part")
    imports = part.select(F.lit("f").alias("file"), F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("object"))
    constants = part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("object"), F.lit("m").alias("member"), F.col("p_size").cast("string").alias("value"))
    return resolve.proven_constants(uses, imports, constants)


# --- set operations -------------------------------------------------------------------------------------
@query("op160_reconcile", "with o as (select o_orderkey as id, o_totalprice as h, o_orderstatus as st from orders where o_orderkey % 5 > 0), n as (select o_orderkey as id, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as h from orders where o_orderkey % 4 > 0) select coalesce(o.id, n.id) as id, case when o.id is null then 'inserted' when n.id is null then (case when st = 'F' then 'deleted' else 'kept' end) when o.h = n.h then 'unchanged' else 'updated' end as action from o full outer join n on n.id = o.id")
def _(s):
    o = s.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("h"), F.col("o_orderstatus").alias("st"))
    new = o.where("id % 4 > 0").withColumn("h", F.when(F.col("id") % 7 == 0, F.col("h") + 1).otherwise(F.col("h")))
    return store.reconcile(o.where("id % 5 > 0"), new, ["id"], "h", F.col("st") == "F")


@query("op139_reconcile_stats", "with o as (select o_orderkey as id from orders where o_orderkey % 5 > 0), n as (select o_orderkey as id from orders where o_orderkey % 4 > 0) select case when o.id is null then 'inserted' when n.id is null then 'deleted' else 'unchanged' end as action, count(*) as n from o full outer join n on n.id = o.id group by 1")
def _(s):
    o = s.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("h"))
    return store.reconcile(o.where("id % 5 > 0"), o.where("id % 4 > 0"), ["id"], "h", F.lit(True)).groupBy("action").agg(F.count("*").alias("n"))


@query("op161_fragment_union", "select id, label from nodes where extractor = 'go' union all select id, label from nodes where extractor = 'ts'")
def _(s):
    n = s.nodes.select("label", "id", "extractor")
    return n.where("extractor = 'go'").unionByName(n.where("extractor = 'ts'").select("id", "extractor", "label")).select("id", "label")


@query("op162_id_difference", "select o_custkey as id from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P'")
def _(s):
    o = s.table("orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("op164_ordered_merge", "with a as (select conv_id as id, min(turn) as ord from conversations where role = 'user' group by 1), b as (select conv_id as id, min(turn) as ord from conversations group by 1) select coalesce(a.id, b.id) as id, case when a.id is null then 1 else 0 end as source, coalesce(a.ord, b.ord) as ord from b full outer join a on a.id = b.id")
def _(s):
    c = s.table("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), "role")
    return store.ordered_merge(c.where("role = 'user'"), c)


@query("op165_citations", "select o_custkey as task, bool_and(o_orderstatus in ('F', 'O')) as cited, count(distinct o_orderpriority) = count(*) as unique_ids from orders group by o_custkey")
def _(s):
    t = s.table("orders").groupBy(F.col("o_custkey").alias("task")).agg(F.collect_list("o_orderstatus").alias("c"), F.collect_list("o_orderpriority").alias("p"))
    return t.select("task", (F.size(F.array_except("c", F.array(F.lit("F"), F.lit("O")))) == 0).alias("cited"), (F.size(F.array_distinct("p")) == F.size("p")).alias("unique_ids"))


# --- semantic -------------------------------------------------------------------------------------------
_COS = "greatest(0, least(1, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))))))"


ORACLES_TOP_K = f"with p as (select a.vec_id as query_id, b.vec_id as target_id, round({_COS}, 4) as similarity from embeddings a join embeddings b on a.label is not distinct from b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0) select query_id, target_id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, target_id) as r from p) where r <= 3"


@query("op141_top_k", ORACLES_TOP_K)
def _(s):
    e = s.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return semantic.top_k(e.where("id % 50 = 0"), e, 3, ["label"], digits=4)


@query("op141_top_k_index", ORACLES_TOP_K)
def _(s):
    e = s.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors.VectorIndex(e, ["label"]).search(e.where("id % 50 = 0"), 3, digits=4)


@query("op249_cosine", f"select a.vec_id, round({_COS}, 4) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(s):
    e = s.table("embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 4).alias("similarity"))


_PAIRS = f"select round({_COS}, 3) as score, a.label = b.label as is_match from embeddings a join embeddings b on b.vec_id = a.vec_id + 7"


@query("op129_calibration", f"with p as ({_PAIRS}), t as (select score, sum(case when is_match then 1 else 0 end) as p, sum(case when is_match then 0 else 1 end) as n from p group by score), c as (select score, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp from t), ok as (select *, tp / (tp + fp) as pr from c where tp > 0 and tp / (tp + fp) >= 0.2), b as (select * from ok order by tp desc, pr desc, score desc limit 1), s as (select sum(p) as pos from t) select coalesce((select score from b), 1.0) as threshold, round(coalesce((select pr from b), 0.0), 9) as precision, round(coalesce((select tp from b) / pos, 0.0), 9) as recall, cast(coalesce((select tp from b), 0) as bigint) as tp, cast(coalesce((select fp from b), 0) as bigint) as fp, cast(pos - coalesce((select tp from b), 0) as bigint) as fn from s")
def _(s):
    e = s.table("embeddings")
    other = e.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("o"), F.col("label").alias("ol"))
    pairs = e.join(other, "vec_id").select(F.round(X.cosine(F.col("embedding"), F.col("o")), 3).alias("score"), (F.col("label") == F.col("ol")).alias("is_match"))
    out = semantic.calibrated(pairs, 0.2)
    return out.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9), "tp": F.col("tp").cast("bigint"), "fp": F.col("fp").cast("bigint"), "fn": F.col("fn").cast("bigint")})


@query("op140_gated", "select gap_id, target_id, similarity from (select l_orderkey as gap_id, l_partkey as target_id, l_discount as similarity, row_number() over (partition by l_orderkey order by l_discount desc, l_partkey) as r from lineitem where l_discount + 1e-6 >= 0.05) where r = 1")
def _(s):
    return semantic.gated(s.table("lineitem").select(F.col("l_orderkey").alias("gap_id"), F.col("l_partkey").alias("target_id"), F.col("l_discount").alias("similarity")), 0.05)


@query("op201_security", "select 'unauthenticated' as finding, concat('ep:c', cast(c_custkey as varchar)) as subject from customer where c_mktsegment = 'BUILDING' and c_custkey % 6 > 0 union all select distinct 'wildcard grant', concat('s', cast(l_suppkey as varchar), ' GRANTS p', cast(l_partkey as varchar)) from lineitem where l_tax = 0.08")
def _(s):
    ends = s.table("customer").select(F.concat(F.lit("ep:c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", False).when(F.col("c_mktsegment") == "MACHINERY", True).alias("auth"), F.when(F.col("c_custkey") % 6 == 0, "Gap").otherwise("Confirmed").alias("conf"))
    grants = s.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.array(F.when(F.col("l_tax") == 0.08, "s3:*").otherwise("s3:Get")).alias("actions"), F.array().cast("array<string>").alias("scopes"), F.lit("Confirmed").alias("conf"))
    return registers.security_findings(ends, grants)
