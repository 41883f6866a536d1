"""Projections of a graph into artifacts: their lines in order, and an assertion for every fact that they show.

Nodes are ``id, label, props`` (JSON text) and edges ``src, dst, label, props``; both have ``tier, conf, extractor, hash,
evidence`` (text).  An artifact is a frame of lines ``part, key, line``, ordered by part and key, and a frame of assertions; a
large one is written in key ranges by :func:`write_artifacts` and never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import auth_state, content_hash, display_name, edge_identity, markdown_safe, mermaid_id
from . import registers
from .graph import flow_scores
from .lineage import running, written
from .store import numbered

PROV = ("tier", "conf", "extractor", "hash", "evidence")
#: Edge labels of the traceability matrix, the topology (with their arrows) and the data model.
TRACE_LABELS = ("REALIZES", "STEP_OF", "GOVERNS", "MAPS_TO", "DECIDES", "TRIGGERED_BY", "PERFORMED_BY")
TOPOLOGY = {"TRIGGERS": "-->", "ROUTES": "-->", "SUBSCRIBES": "-->", "GRANTS": "-->", "BACKS": "-->", "DEPENDS_ON": "-.->", "REFERENCES": "-.->"}
DATA_LABELS = ("READS", "WRITES", "MAPS_TO")
NAME_KEYS = ("title", "name", "identity", "logical_id", "route", "path", "reason")
NONE = "—"

Artifact = tuple[DataFrame, DataFrame]


def prop(key: str) -> Column:
    return F.get_json_object("props", f"$.{key}")


def name_of() -> Column:
    return display_name(label=F.col("label"), id=F.col("id"), method=prop("method"), **{k: prop(k) for k in NAME_KEYS})


def node_assertions(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat(F.lit("node:"), "id").alias("id"), F.col("id").alias("subject_id"), F.col("label").alias("subject_kind"), F.concat("label", F.lit(": "), name_of()).alias("summary"), *PROV)


def edge_assertions(edges: DataFrame) -> DataFrame:
    """A gap edge with a reason is summed up by it, others by their identity."""
    identity = edge_identity(F.col("src"), F.col("label"), F.col("dst"))
    summary = F.when((F.col("conf") == "Gap") & prop("reason").isNotNull(), F.concat("label", F.lit(": "), prop("reason"))).otherwise(identity)
    return edges.select(F.concat(F.lit("edge:"), identity).alias("id"), identity.alias("subject_id"), F.col("label").alias("subject_kind"), summary.alias("summary"), *PROV)


def _lines(df: DataFrame, part: int, key: Column | str, *line: Column | str) -> DataFrame:
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in line])
    return df.select(F.lit(part).alias("part"), (F.col(key) if isinstance(key, str) else key).alias("key"), text.alias("line"))


def _fixed(df: DataFrame, part: int, *lines: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(part, f"{k:04d}", x) for k, x in enumerate(lines)], "part int, key string, line string")


def _if_none(df: DataFrame, part: int, line: str) -> DataFrame:
    """The line, if the frame has no rows."""
    return df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(line).alias("line"))


def _joined(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def _known(df: DataFrame) -> DataFrame:
    return df.where("conf <> 'Gap'")


def _code(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _table(edges: DataFrame, part: int) -> DataFrame:
    cell = lambda c: _code(markdown_safe(F.col(c)))
    return _lines(edges, part, edge_identity(F.col("src"), F.col("label"), F.col("dst")), "| ", cell("src"), " | ", F.col("label"), " | ", cell("dst"), " |")


def user_stories(nodes: DataFrame) -> Artifact:
    """Known capabilities, numbered in the order of their ids."""
    told = numbered(_known(nodes.where("label = 'Capability'")), "id", "US-R-%04d")
    body = _lines(told, 1, "id", "## ", F.col("ref"), f" {NONE} ", name_of(), "\n\n- Recovered capability assertion: ", _code(F.col("id")), "\n")
    return _joined(_fixed(nodes, 0, "# Recovered user stories", ""), body, _if_none(told, 1, "No Capability facts have been recovered yet.")), node_assertions(told)


def traceability(edges: DataFrame) -> Artifact:
    told = _known(edges.where(F.col("label").isin(*TRACE_LABELS)))
    return _joined(_fixed(edges, 0, "# Recovered US traceability matrix", "", "| Source | Relation | Target |", "|---|---|---|"), _table(told, 1), _if_none(told, 1, f"| {NONE} | No recovered mappings | {NONE} |")), edge_assertions(told)


def topology(nodes: DataFrame, edges: DataFrame) -> Artifact:
    """Known resources, channels that a known edge backs, and the known edges between them."""
    between = _known(edges.where(F.col("label").isin(*TOPOLOGY)))
    backed = between.where("label = 'BACKS'").select(F.col("dst").alias("id")).distinct()
    channels = nodes.where("label = 'Channel'").join(backed, "id", "left_semi")
    shown = _known(nodes.where("label = 'Resource'").unionByName(channels))
    ids = shown.select("id", "label")
    kept = between.join(ids.select(F.col("id").alias("src"), F.col("label").alias("_s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("label").alias("_d")), "dst")
    drawn = kept.where("_s = 'Resource' and (_d = 'Resource' or label = 'BACKS')")
    placeholder = prop("placeholder").isNotNull()
    display = F.coalesce(prop("logical_id"), F.regexp_replace("id", "^res:", ""))
    boxes = _lines(shown.where("label = 'Resource'"), 1, "id", "    ", mermaid_id(F.col("id")), F.when(placeholder, "([").otherwise("["), '"', display, F.when(placeholder, " ?").otherwise(""), '"', F.when(placeholder, "])").otherwise("]"))
    tubes = _lines(shown.where("label = 'Channel'"), 2, "id", "    ", mermaid_id(F.col("id")), '[("', F.regexp_replace("id", "^chan:", ""), '")]')
    arrow = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in TOPOLOGY.items()])
    arrows = drawn.select(F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit(" "), arrow, F.lit("|"), "label", F.lit("| "), mermaid_id(F.col("dst"))).alias("l")).distinct()
    lines = _joined(_fixed(nodes, 0, "# Resource topology", "", "```mermaid", "flowchart LR"), boxes, tubes, _lines(arrows, 3, "l", F.col("l")), _fixed(nodes, 4, "```"))
    return lines, node_assertions(shown).unionByName(edge_assertions(kept.select(*edges.columns)))


def data_edges(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an entity (``id``) on either side and known nodes on both."""
    ends = [edges.join(entities.select(F.col("id").alias(e)), e, "left_semi").select(*edges.columns) for e in ("src", "dst")]
    hit = ends[0].unionByName(ends[1]).dropDuplicates(["src", "dst", "label"])
    for e in ("src", "dst"):
        hit = hit.join(nodes.select(F.col("id").alias(e)), e, "left_semi").select(*edges.columns)
    return hit


def data_model(nodes: DataFrame, edges: DataFrame) -> Artifact:
    """Known entities, what reads, writes or maps to them, and these relations; aliases d0, d1 ... follow the ids."""
    entities = _known(nodes.where("label = 'DataEntity'"))
    maps = data_edges(entities, nodes, _known(edges.where(F.col("label").isin(*DATA_LABELS))))
    wanted = entities.select("id").unionAll(maps.select(F.explode(F.array("src", "dst")))).distinct()
    shown = running(nodes.join(wanted, "id", "left_semi"), F.lit(1), "_n", "id").withColumn("alias", F.concat(F.lit("d"), (F.col("_n") - 1).cast("string")))
    text = F.when(F.col("label") == "DataEntity", name_of()).otherwise(F.concat("label", F.lit(": "), name_of()))
    boxes = _lines(shown, 1, "id", "    ", F.col("alias"), '["', F.translate(F.translate(text, "\r\n", "  "), '"', "'"), '"]')
    to = shown.select("id", "alias")
    drawn = maps.join(to.select(F.col("id").alias("src"), F.col("alias").alias("_a")), "src").join(to.select(F.col("id").alias("dst"), F.col("alias").alias("_b")), "dst")
    arrows = _lines(drawn, 2, edge_identity(F.col("src"), F.col("label"), F.col("dst")), "    ", F.col("_a"), " -->|", F.col("label"), "| ", F.col("_b"))
    head = maps.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(5).alias("part"), F.lit("").alias("key"), F.lit("\n## Access and mapping relations\n\n| Source | Relation | Target |\n|---|---|---|").alias("line"))
    lines = _joined(_fixed(nodes, 0, "# Recovered data model", "", "```mermaid", "flowchart LR"), boxes, arrows, _fixed(nodes, 3, "```"), _if_none(entities, 4, "\nNo DataEntity facts have been recovered yet."), head, _table(maps, 6))
    return lines, node_assertions(shown.select(*nodes.columns)).unionByName(edge_assertions(maps))


def decision_set(nodes: DataFrame, edges: DataFrame) -> Artifact:
    """Known decision records with origin, status and body, and what they decide."""
    adrs = _known(nodes.where("label = 'ADR'"))
    links = _known(edges.where("label = 'DECIDES'")).join(adrs.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    part = lambda title, c: F.coalesce(F.concat(F.lit(f"\n\n**{title}:** "), c), F.lit(""))
    body = F.coalesce(F.concat(F.lit("\n\n"), F.coalesce(prop("body"), prop("content"), prop("decision"))), F.lit(""))
    told = _lines(adrs, 1, "id", "## ", name_of(), part("Origin", prop("origin")), part("Status", prop("status")), body, "\n")
    head = links.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(2).alias("part"), F.lit("").alias("key"), F.lit("\n## Decision links\n\n| ADR | Relation | Subject |\n|---|---|---|").alias("line"))
    lines = _joined(_fixed(nodes, 0, "# Found and recovered ADRs", ""), told, _if_none(adrs, 1, "No found or recovered ADR facts have been recovered yet."), head, _table(links, 3))
    return lines, node_assertions(adrs).unionByName(edge_assertions(links))


def gap_register(nodes: DataFrame, edges: DataFrame, flow_assertions: DataFrame | None = None) -> Artifact:
    """Gap nodes, gap edges and gap hops of flows, each once."""
    told = node_assertions(nodes.where(registers.GAP_NODE)).unionByName(edge_assertions(edges.where(registers.GAP_EDGE)))
    if flow_assertions is not None:
        told = told.unionByName(flow_assertions.where("conf = 'Gap'"))
    told = told.dropDuplicates(["id"])
    body = _lines(told, 1, "id", "| ", _code(markdown_safe(F.col("subject_id"))), " | ", markdown_safe(F.col("summary")), " |")
    return _joined(_fixed(nodes, 0, "# Gap register", "", "| Subject | Reason |", "|---|---|"), body, _if_none(told, 1, f"| {NONE} | No unresolved facts |")), told


def _listed(key: str) -> Column:
    """The strings of a JSON array, joined; a dash where there are none."""
    text = F.array_join(F.from_json(prop(key), "array<string>"), ", ")
    return F.when(F.coalesce(text, F.lit("")) == "", NONE).otherwise(text)


def _or_dash(c: Column) -> Column:
    return F.coalesce(c, F.lit(NONE))


def drift_register(nodes: DataFrame, edges: DataFrame) -> Artifact:
    """Drift nodes as rows; edges of drift support them as assertions."""
    told = nodes.where((F.col("label") == "Drift") | F.coalesce(prop("kind") == "drift", F.lit(False)))
    support = edges.where(F.col("label").isin(*registers.DRIFT_EDGES))
    cell = lambda c: markdown_safe(c)
    body = _lines(told, 1, "id", "| ", cell(name_of()), " | ", _code(cell(_or_dash(prop("adr_id")))), " | ", _code(cell(_or_dash(prop("offending_edge")))), " | ", cell(_listed("flow_triggers")), " | ", F.col("conf"), " |")
    head = _fixed(nodes, 0, "# Drift register", "", "| Finding | ADR | Offending edge | Flow triggers | Confidence |", "|---|---|---|---|---|")
    return _joined(head, body, _if_none(told, 1, f"| {NONE} | No ADR/code conflicts recovered |")), node_assertions(told).unionByName(edge_assertions(support))


def security_view(nodes: DataFrame) -> Artifact:
    told = nodes.where((F.col("label") == "Finding") & (prop("kind") == "security"))
    cell = lambda c: markdown_safe(c)
    body = _lines(
        told, 1, "id", "| ", cell(name_of()), " | ", _code(cell(F.coalesce(prop("category"), F.lit("security")))), " | ", _code(cell(_or_dash(prop("subject_id")))), " | ",
        cell(_listed("resource_scope")), " | ", cell(_listed("actions")), " | ", cell(F.coalesce(prop("us_id"), F.lit("US-0015"))), " / ", cell(_or_dash(prop("ac_id"))), " | ", F.col("conf"), " |",
    )
    head = _fixed(nodes, 0, "# Security findings", "", "| Finding | Type | Subject | Resource scope | Actions | US / AC | Confidence |", "|---|---|---|---|---|---|---|")
    return _joined(head, body, _if_none(told, 1, f"| {NONE} | {NONE} | {NONE} | {NONE} | {NONE} | No explicit security findings | {NONE} |")), node_assertions(told)


def toolchain_view(nodes: DataFrame, edges: DataFrame) -> Artifact:
    """Tools with the files that define them and their settings; settings kept in code are only said to exist."""
    tools = nodes.where("label = 'Tool'")
    files = edges.where("label = 'DEFINED_IN'").join(tools.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.when(F.col("dst").contains("@"), F.regexp_replace("dst", r"^[^@]*@", "")).otherwise(F.col("dst")).alias("_f")).distinct()
    defined = files.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("_f")), ", ").alias("defined"))
    settings = F.from_json(prop("settings"), "map<string,string>")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    shown = F.when(prop("settings_behind_code") == "true", f"settings live in code {NONE} detected by presence only").when(F.coalesce(shown, F.lit("")) == "", NONE).otherwise(shown)
    told = tools.join(defined, "id", "left").withColumns({"defined": F.coalesce("defined", F.lit("")), "_shown": shown, "_display": F.coalesce(prop("display"), F.col("id")), "_category": _or_dash(prop("category"))})
    cell = lambda c: markdown_safe(F.col(c))
    body = _lines(told, 1, "id", "| ", cell("_display"), " | ", cell("_category"), " | ", cell("defined"), " | ", cell("_shown"), " | ", F.col("conf"), " |")
    summary = F.concat(F.lit("Toolchain: "), "_display", F.lit(" ("), "_category", F.lit(") defined in "), "defined")
    assertions = told.select(F.concat(F.lit("tool:"), "id").alias("id"), F.col("id").alias("subject_id"), F.lit("Tool").alias("subject_kind"), summary.alias("summary"), *PROV)
    head = _fixed(nodes, 0, "# Toolchain", "", "| Tool | Category | Defined in | Settings | Confidence |", "|---|---|---|---|---|")
    return _joined(head, body, _if_none(tools, 1, f"| {NONE} | {NONE} | {NONE} | No toolchain facts recovered | {NONE} |")), assertions


def projected(hops: DataFrame, rejected: DataFrame, best_effort: bool = False) -> DataFrame:
    """Hops (``src, label, dst, conf, hash``, others kept) with excluded ones replaced by a gap that says why.

    An inferred hop whose hash was rejected is excluded, a weak one only unless in best effort; what is left is never
    stronger than it was.
    """
    out = hops.join(rejected.select("hash", F.lit(True).alias("_no")).distinct(), "hash", "left")
    inferred = F.col("conf").isin("InferredStrong", "InferredWeak")
    no = inferred & F.col("_no").isNotNull()
    weak = F.lit(False) if best_effort else F.col("conf") == "InferredWeak"
    reason = F.when(no, "inference rejected by Workbench curation").when(weak, "weak inference excluded by verified-only export")
    gap = F.concat(F.lit("gap:projection:"), F.substring(content_hash(F.concat_ws(" ", edge_identity(F.col("src"), F.col("label"), F.col("dst")), "hash", reason)), 1, 16))
    gone = no | weak
    keep = [c for c in hops.columns if c not in ("label", "dst", "conf", "tier", "extractor")]
    return out.select(*keep, F.when(gone, "UNRESOLVED").otherwise(F.col("label")).alias("label"), F.when(gone, gap).otherwise(F.col("dst")).alias("dst"), F.when(gone, "Gap").otherwise(F.col("conf")).alias("conf"),
                      *[F.when(gone, v).otherwise(F.col(c)).alias(c) for c, v in (("tier", "Deterministic"), ("extractor", "spec.projection-gap")) if c in hops.columns], reason.alias("reason"))


def flow_dossiers(hops: DataFrame, triggers: DataFrame, names: DataFrame) -> Artifact:
    """A section for every flow: a sequence diagram and a provenance table of its hops, in their order.

    hops: ``trigger_id, ord, src, label, dst, reason`` with provenance, as :func:`projected` leaves them; triggers:
    ``trigger_id, kind, depth_limited``; names: ``id, name``.  Participants are numbered by first appearance in the flow.
    """
    named = names.select("id", "name")
    scores = flow_scores(hops.select("trigger_id", "src", "dst", "label", "conf"), triggers.select("trigger_id", "depth_limited"), None)
    who = hops.select("trigger_id", F.explode(F.array(F.struct((F.col("ord") * 2).alias("at"), F.col("src").alias("id")), F.struct((F.col("ord") * 2 + 1).alias("at"), F.col("dst").alias("id")))).alias("p"))
    first = who.groupBy("trigger_id", F.col("p.id").alias("id")).agg(F.min("p.at").alias("at"))
    alias = first.withColumn("alias", F.concat(F.lit("p"), (F.row_number().over(Window.partitionBy("trigger_id").orderBy("at")) - 1).cast("string"))).join(named, "id", "left")
    alias = written(alias.withColumn("name", F.coalesce("name", "id")), "participants")
    ends = lambda e: alias.select("trigger_id", F.col("id").alias(e), F.col("alias").alias(f"{e}_p"), F.col("name").alias(f"{e}_name"))
    full = hops.join(ends("src"), ["trigger_id", "src"]).join(ends("dst"), ["trigger_id", "dst"])
    full = full.withColumn("dst_name", F.when(F.col("reason").isNotNull(), F.concat(F.lit("GAP: "), "reason")).otherwise(F.col("dst_name")))
    at = lambda section, place: F.concat(F.col("trigger_id"), F.lit(f" {section} "), F.lpad(place.cast("string"), 12, "0"))
    told = triggers.join(scores, "trigger_id").join(named.withColumnRenamed("id", "trigger_id"), "trigger_id", "left").withColumn("name", F.coalesce("name", "trigger_id"))
    cut = F.when(F.col("depth_limited"), f"\n\n**Truncated at the traversal depth bound** {NONE} downstream hops exist that are not shown.").otherwise("")
    empty = F.when(F.col("hops") == 0, "\n\nNo hops resolved from this trigger.").otherwise("\n\n```mermaid\nsequenceDiagram")
    zero = F.lit(0)
    heads = _lines(told, 1, at("a", zero), "\n## ", F.col("name"), f" {NONE} ", F.col("status"), " (score ", F.format_string("%.2f", F.bround("score", 2)), ")\n\nTrigger: ", F.col("kind"), " ", _code(F.col("trigger_id")), cut, empty)
    people = _lines(alias, 1, at("b", F.col("at")), "    participant ", F.col("alias"), " as ", F.translate(F.col("name"), "\n", " "))
    arrows = _lines(full, 1, at("c", F.col("ord")), "    ", F.col("src_p"), F.when(F.col("conf") == "Gap", "--x").otherwise("->>"), F.col("dst_p"), ": ", F.col("label"), " [", F.col("conf"), "]")
    middle = _lines(told.where("hops > 0"), 1, at("d", zero), "```\n\n| # | Hop | Tier | Confidence | Evidence | Extractor | Content hash |\n|---|-----|------|------------|----------|-----------|--------------|")
    evidence = F.when(F.coalesce("evidence", F.lit("")) == "", NONE).otherwise(F.col("evidence"))
    rows = _lines(full, 1, at("e", F.col("ord")), "| ", (F.col("ord") + 1).cast("string"), " | ", F.col("label"), " ", _code(F.col("src")), " → ", _code(F.col("dst")), " | ", F.col("tier"), " | ", F.col("conf"), " | ", evidence, " | ", _code(F.col("extractor")), " | ", _code(F.col("hash")), " |")
    assertions = full.select(
        F.concat(F.lit("flow:"), "trigger_id", F.lit(":"), F.col("ord").cast("string"), F.lit(":"), "label", F.lit(":"), "dst").alias("id"),
        edge_identity(F.col("src"), F.col("label"), F.col("dst")).alias("subject_id"),
        F.lit("FlowHop").alias("subject_kind"),
        F.concat("label", F.lit(": "), "src_name", F.lit(" → "), "dst_name").alias("summary"),
        *PROV,
    )
    return _joined(_fixed(hops, 0, "# Flow dossier"), heads, people, arrows, middle, rows), assertions


def with_assertions(lines: DataFrame, assertions: DataFrame) -> DataFrame:
    """The lines, followed by the table of assertions with their provenance."""
    cell = lambda c: markdown_safe(F.col(c))
    evidence = F.when(F.coalesce("evidence", F.lit("")) == "", NONE).otherwise(markdown_safe(F.col("evidence")))
    rows = _lines(assertions, 91, "id", "| ", cell("summary"), " | ", F.col("tier"), " | ", F.col("conf"), " | ", evidence, " | ", _code(cell("extractor")), " | ", _code(cell("hash")), " |")
    head = assertions.agg(F.count(F.lit(1)).alias("n")).select(F.lit(90).alias("part"), F.lit("").alias("key"), F.concat(F.lit("\n## Assertions and inline provenance\n\n"), F.when(F.col("n") == 0, "No graph-backed assertions were recovered for this artifact.").otherwise("| Assertion | Tier | Confidence | Evidence | Extractor | Content hash |\n|---|---|---|---|---|---|")).alias("line"))
    return _joined(lines, head, rows)


def derived(nodes: DataFrame, edges: DataFrame, hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts that follow from what survived a filter: recovered decisions, drift (with the flows that it breaks) and security
    findings, and their edges."""
    get = prop
    found = edges.where("label = 'DECIDES'").join(nodes.where(F.col("label") == "ADR").select(F.col("id").alias("src")), "src", "left_semi")
    open_ = registers.ungoverned_channels(nodes.where("label = 'Channel'"), found.select(F.col("dst").alias("id")), edges)
    h16 = lambda *c: F.substring(content_hash(F.concat_ws(" ", *c)), 1, 16)
    tier = lambda conf: F.when(conf == "Confirmed", "Deterministic").otherwise("Semantic")
    adr = open_.select(F.concat(F.lit("adr:recovered:async:"), h16("id")).alias("adr"), F.col("id").alias("channel"), "conf")
    stamp = lambda key, kind: [tier(F.col("conf")).alias("tier"), F.col("conf"), F.lit(f"spec.{kind}").alias("extractor"), content_hash(key).alias("hash"), F.lit("").alias("evidence")]
    adr_nodes = adr.select(F.col("adr").alias("id"), F.lit("ADR").alias("label"), F.to_json(F.struct(F.concat(F.lit("Asynchronous channel "), "channel").alias("title"), F.lit("recovered").alias("origin"), F.lit("Recovered").alias("status"))).alias("props"), *stamp(F.col("adr"), "recovered-adr"))
    adr_edges = adr.select(F.col("adr").alias("src"), F.col("channel").alias("dst"), F.lit("DECIDES").alias("label"), F.lit("{}").alias("props"), *stamp(F.concat_ws(" ", "adr", F.lit("DECIDES"), "channel"), "recovered-adr"))
    rules = nodes.where("label = 'ADR'").select(F.col("id").alias("adr"), F.explode(F.from_json(get("forbids"), "array<string>")).alias("forbids")).join(found.select(F.col("src").alias("adr"), F.col("dst").alias("governs")), "adr")
    broken = registers.with_triggers(registers.drift(rules, edges).join(edges.select("src", "dst", "label", "conf"), ["src", "dst", "label"]), hops)
    broken = broken.withColumn("edge", edge_identity(F.col("src"), F.col("label"), F.col("dst"))).withColumn("drift", F.concat(F.lit("drift:"), h16("adr", "edge")))
    drift_nodes = broken.select(F.col("drift").alias("id"), F.lit("Drift").alias("label"), F.to_json(F.struct(F.concat("label", F.lit(" is forbidden by "), "adr").alias("title"), F.col("adr").alias("adr_id"), F.col("edge").alias("offending_edge"), "flow_triggers")).alias("props"), *stamp(F.col("drift"), "drift"))
    drift_edges = broken.select(F.col("drift").alias("src"), F.explode(F.array(F.struct(F.col("adr").alias("dst"), F.lit("DRIFTS_FROM").alias("label")), F.struct(F.col("src").alias("dst"), F.lit("CONFLICTS").alias("label")))).alias("e"), "conf").select("src", "e.dst", "e.label", F.lit("{}").alias("props"), *stamp(F.concat_ws(" ", "src", "e.label", "e.dst"), "drift"))
    ends = nodes.where("label = 'Endpoint'").select("id", auth_state(F.col("props")).alias("auth"), "conf")
    listed = lambda key: F.coalesce(F.from_json(get(key), "array<string>"), F.array().cast("array<string>"))
    grants = edges.where("label = 'GRANTS'").select("src", "dst", listed("actions").alias("actions"), listed("resource_scopes").alias("scopes"), "conf")
    risks = registers.security_findings(ends, grants)
    risk_nodes = risks.select(F.concat(F.lit("finding:security:"), h16("finding", "subject")).alias("id"), F.lit("Finding").alias("label"), F.to_json(F.struct(F.lit("security").alias("kind"), F.col("finding").alias("category"), F.concat_ws(" ", "finding", "subject").alias("title"), F.col("subject").alias("subject_id"))).alias("props"), F.lit("Confirmed").alias("conf")).select("id", "label", "props", *stamp(F.col("id"), "security"))
    return adr_nodes.unionByName(drift_nodes).unionByName(risk_nodes), adr_edges.unionByName(drift_edges)


NODE = ["id", "label", "props", *PROV]
EDGE = ["src", "dst", "label", "props", *PROV]


def compile_spec(nodes: DataFrame, edges: DataFrame, hops: DataFrame, triggers: DataFrame, best_effort: bool = False, rejected: DataFrame | None = None) -> dict[str, Artifact]:
    """The ten artifacts by name.

    Facts are filtered by the mode before anything is derived from them, so nothing derived rests on a fact that is not
    shown; what is derived is filtered as well.
    """
    no = rejected if rejected is not None else nodes.select("hash").limit(0)
    keep = lambda df: registers.exported(df, no, best_effort)
    n, e = written(keep(nodes.select(*NODE)).select(*NODE), "nodes"), written(keep(edges.select(*EDGE)).select(*EDGE), "edges")
    shown = projected(hops, no, best_effort)
    more_nodes, more_edges = derived(n, e, shown)
    n = written(n.unionByName(keep(more_nodes).select(*NODE)), "nodes")
    e = written(e.unionByName(keep(more_edges).select(*EDGE)), "edges")
    names = n.select("id", name_of().alias("name"))
    dossiers = flow_dossiers(shown, triggers, names)
    return {
        "user-stories": user_stories(n),
        "us-tm": traceability(e),
        "flow-dossiers": dossiers,
        "topology": topology(n, e),
        "data-model": data_model(n, e),
        "adrs": decision_set(n, e),
        "gap-register": gap_register(n, e, dossiers[1]),
        "drift-register": drift_register(n, e),
        "security-view": security_view(n),
        "toolchain": toolchain_view(n, e),
    }


def bundle_counts(bundle: dict[str, Artifact]) -> DataFrame:
    """``artifact, assertions``: how many each artifact has."""
    return _joined(*[a.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("assertions")) for name, (_, a) in bundle.items()])


def write_artifacts(bundle: dict[str, Artifact], folder: str) -> None:
    """Each artifact as text files, in order, in a folder of its name; large ones in key ranges."""
    for name, (lines, assertions) in bundle.items():
        with_assertions(lines, assertions).repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(f"{folder}/{name}")
