"""Joins that bring configuration, state and observation to recovered facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normal_path, url_path
from .lineage import counted, written
from .resolve import nearest_scope
from .store import first_by, last_by

#: Source extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Resource types that stand between others; where their attributes refer to a source and a target, an
#: edge of this label leads from one to the other (a source of null is the resource itself).
CAPABILITIES = (
    ("aws_lambda_event_source_mapping", "TRIGGERS", "event_source_arn", "function_name"),
    ("aws_cloudwatch_event_target", "TRIGGERS", "rule", "arn"),
    ("aws_sns_topic_subscription", "SUBSCRIBES", "endpoint", "topic_arn"),
    ("aws_lb_listener", "ROUTES", "load_balancer_arn", "default_action"),
    ("aws_lb_target_group_attachment", "ROUTES", "target_group_arn", "target_id"),
    ("aws_api_gateway_integration", "ROUTES", "rest_api_id", "uri"),
    ("aws_lambda_permission", "TRIGGERS", "source_arn", "function_name"),
    ("aws_cloudfront_distribution", "TRIGGERS", None, "*cache_behavior.lambda_function_association.lambda_arn"),
    ("aws_pipes_pipe", "TRIGGERS", "source", "target"),
)
#: Resource types that back channels, the channels' kind, and the attribute that names the channel.
BACKINGS = (("aws_sqs_queue", "sqs-queue", "url"), ("aws_sns_topic", "sns-topic", "arn"))
REDACTED = "[redacted]"


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    return reduce(lambda a, e: a | path.endswith(e), endings, F.lit(False))


def _variants(path: Column) -> Column:
    """Files that a path may mean: itself with a source extension, else with each, else an index file below it."""
    tried = [F.concat(path, F.lit(e)) for e in EXTENSIONS] + [F.concat(path, F.lit(f"/index{e}")) for e in EXTENSIONS]
    return F.when(_ends(path, EXTENSIONS), F.array(path)).otherwise(F.array(*tried))


def module_targets(imports: DataFrame, configs: DataFrame, patterns: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """``importer, spec, target, via, config``: what bare imports (``importer, spec``) resolve to, of those that do.

    The nearest config (``dir, config_path, base_url``) of an importer governs alone, whether it has patterns
    (``config_path, pattern, targets``) or not.  Its patterns are tried first, exact ones before longer prefixes before
    shorter, then its base URL, then the packages of that very name (``name, dir, entries, config_path``).  Only what is
    among the files (``path``) counts.
    """
    asks = imports.select("importer", "spec").distinct()
    other = ~F.element_at(F.split("config_path", "/"), -1).isin("tsconfig.json", "jsconfig.json")
    scopes = first_by(configs.select("dir", "config_path", "base_url", other.alias("_other")), ["dir"], "_other", "config_path").drop("_other")
    near = nearest_scope(asks.select(F.col("importer").alias("path")).distinct(), scopes).withColumnRenamed("path", "importer")
    scoped = asks.join(near, "importer").join(scopes, "dir")
    base = F.when(F.col("base_url").isNull(), F.col("dir")).otherwise(normal_path(F.concat_ws("/", "dir", "base_url")))
    scoped = scoped.withColumn("base", base)
    below = lambda target: normal_path(F.concat_ws("/", "base", target))
    star = F.instr("pattern", "*")
    head, tail = F.substring("pattern", F.lit(1), star - 1), F.substring("pattern", star + 1, F.length("pattern"))
    fits = F.when(star == 0, F.col("pattern") == F.col("spec")).otherwise(F.startswith("spec", head) & F.endswith("spec", tail) & (F.length("spec") >= F.length(head) + F.length(tail)))
    kept = F.substring("spec", F.length(head) + 1, F.length("spec") - F.length(head) - F.length(tail))
    at = F.instr("target", "*")
    mapped = F.when((star == 0) | (at == 0), F.col("target")).otherwise(F.concat(F.substring("target", F.lit(1), at - 1), kept, F.substring("target", at + 1, F.length("target"))))
    rank = lambda kind, special, text, place: F.struct(F.lit(kind).alias("kind"), special.alias("special"), text.alias("text"), place.alias("place"))
    none, zero = F.lit(""), F.lit(0)
    by_path = scoped.join(patterns, "config_path").where(fits).select("*", F.posexplode("targets").alias("place", "target"))
    by_path = by_path.select("importer", "spec", below(mapped).alias("base"), rank(0, F.when(star == 0, -1_000_000_000).otherwise(-star), F.col("pattern"), F.col("place")).alias("rank"), F.lit("tsconfig-paths").alias("via"), F.col("config_path").alias("config"))
    by_base = scoped.where("base_url is not null").select("importer", "spec", below("spec").alias("base"), rank(1, zero, none, zero).alias("rank"), F.lit("tsconfig-baseurl").alias("via"), F.col("config_path").alias("config"))
    named = asks.join(packages.withColumnRenamed("name", "spec"), "spec").select("*", F.posexplode("entries").alias("place", "entry"))
    by_name = named.select("importer", "spec", normal_path(F.concat_ws("/", "dir", "entry")).alias("base"), rank(2, zero, F.col("config_path"), F.col("place")).alias("rank"), F.lit("workspace-package").alias("via"), F.col("config_path").alias("config"))
    tried = by_path.unionAll(by_base).unionAll(by_name).select("importer", "spec", "rank", "via", "config", F.posexplode(_variants(F.col("base"))).alias("variant", "target"))
    real = tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return first_by(real, ["importer", "spec"], "rank", "variant").select("importer", "spec", "target", "via", "config")


def handled_endpoints(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """Endpoints whose handler (``package_dir, exported``) is a symbol (``id, package_dir, simple_name, seq``): the last
    one of that name; others are dropped."""
    named = last_by(symbols, ["package_dir", "simple_name"], "seq").select("package_dir", F.col("simple_name").alias("exported"), F.col("id").alias("handler"))
    return pending.join(named, ["package_dir", "exported"])


def observed_resources(resources: DataFrame, state: DataFrame, modules: DataFrame) -> DataFrame:
    """Resources (``id, address, type, logical_id, placeholder``) with what state says of them.

    ``observed`` is the JSON of the state's values (``address, type, values``); a placeholder that is a module
    (``address, resources``) shows its number of resources.  An observed placeholder becomes a resource of the observed
    type.  Resources of which nothing is said come back with a null ``observed``.
    """
    said = state.groupBy("address").agg(F.max(F.struct(F.col("type").alias("t"), "values")).alias("s"))
    sizes = modules.groupBy("address").agg(F.max("resources").alias("_m"))
    out = resources.join(said, "address", "left").join(sizes, "address", "left")
    by_module = F.col("placeholder") & F.col("s").isNull() & F.col("_m").isNotNull()
    observed = F.when(F.col("s").isNotNull(), F.col("s.values")).when(by_module, F.to_json(F.struct(F.col("_m").alias("module_resources"))))
    resolved = observed.isNotNull() & F.col("placeholder")
    return out.select(
        "id",
        observed.alias("observed"),
        F.when(resolved, F.coalesce("s.t", F.lit("module"))).otherwise(F.col("type")).alias("type"),
        F.when(resolved, F.col("address")).otherwise(F.col("logical_id")).alias("logical_id"),
        (F.col("placeholder") & ~resolved).alias("placeholder"),
    )


def backing_edges(resources: DataFrame, channels: DataFrame) -> DataFrame:
    """``src, dst``: deployed resources (``id, type, observed`` JSON) that back an existing channel (``id``).

    The channel's identity is the type's attribute of what was observed, else of its outputs, else of its inputs; a
    redacted one names nothing.
    """
    found = None
    for kind_of, kind, attribute in BACKINGS:
        identity = F.coalesce(*[F.get_json_object("observed", f"$.{at}{attribute}") for at in ("", "outputs.", "inputs.")])
        rows = resources.where(F.col("type") == kind_of).select(F.col("id").alias("src"), F.when(identity != REDACTED, F.concat(F.lit(f"chan:{kind}:"), identity)).alias("dst"))
        found = rows if found is None else found.unionAll(rows)
    return found.where("dst is not null").join(channels.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def refreshed_edges(stored: DataFrame, fresh: DataFrame, label: str, extractors: list[str]) -> DataFrame:
    """Stored edges (``src, dst, label, extractor``) with all of this label and these extractors replaced by the fresh ones."""
    kept = stored.where(~((F.col("label") == label) & F.col("extractor").isin(extractors)))
    return first_by(fresh.withColumn("_o", F.lit(0)).unionByName(kept.withColumn("_o", F.lit(1))), ["src", "dst", "label"], "_o", "extractor").drop("_o")


def traced_endpoints(endpoints: DataFrame, spans: DataFrame) -> DataFrame:
    """``endpoint, span``: endpoints (``id, method, path, observed``) with the first span (``span, method, url``) of theirs.

    A span counts only where its method and path name exactly one endpoint; endpoints observed before are left alone.
    """
    only = endpoints.groupBy("method", "path").agg(F.count("*").alias("n"), F.first("id").alias("endpoint"), F.bool_or("observed").alias("seen")).where("n = 1 and not seen")
    asked = spans.select("span", F.upper("method").alias("method"), url_path(F.col("url")).alias("path"))
    return asked.join(only, ["method", "path"]).groupBy("endpoint").agg(F.min("span").alias("span"))


def resolved_by_traces(edges: DataFrame, told: DataFrame) -> DataFrame:
    """Edges (``src, dst, label``) with every edge into a resolved gap (``gap, kind, identity``) led to its channel."""
    to = told.where("identity is not null").select(F.col("gap").alias("dst"), F.concat_ws(":", F.lit("chan"), "kind", "identity").alias("_to"))
    return edges.join(to, "dst", "left").select("src", F.coalesce("_to", "dst").alias("dst"), "label", F.col("_to").isNotNull().alias("traced")).distinct()


def capability_edges(references: DataFrame) -> DataFrame:
    """``src, dst, label, via`` from references (``via, type, attribute, ref``): each source of a mediating resource with
    each of its targets.

    Only the refs of one resource's two attributes meet, never those of different resources.
    """
    spark = references.sparkSession
    registry = F.broadcast(spark.createDataFrame([(*c, k) for k, c in enumerate(CAPABILITIES)], "type string, label string, source string, target string, entry int"))
    plain = F.regexp_replace("attribute", r"^\w*cache_behavior\.", "*cache_behavior.")
    known = references.withColumn("attribute", plain).join(registry, "type")
    target = known.where("attribute = target").select("via", "entry", "label", F.col("ref").alias("dst")).distinct()
    source = known.where("attribute = source").select("via", "entry", F.col("ref").alias("src")).unionAll(known.where("source is null").select("via", "entry", F.col("via").alias("src"))).distinct()
    return source.join(target, ["via", "entry"]).select("src", "dst", "label", "via").distinct()


def decision_links(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """``adr, target, place``: nodes (``id, label``; no ADRs) that a record (``adr, governs, mentions``) names by exact id.

    What it governs comes first, then what it mentions; a target named twice is cited where it comes first.
    """
    each = None
    for k, c in enumerate(("governs", "mentions")):
        rows = records.select("adr", F.posexplode(c).alias("pos", "target")).select("adr", "target", F.struct(F.lit(k).alias("field"), "pos").alias("place"))
        each = rows if each is None else each.unionAll(rows)
    real = each.join(nodes.where("label <> 'ADR'").select(F.col("id").alias("target")), "target", "left_semi")
    return first_by(real, ["adr", "target"], "place").select("adr", "target", "place.field", "place.pos")


def relinked(adrs: DataFrame, edges: DataFrame, repos: DataFrame, records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found records and DECIDES edges after all repositories' records were read again.

    adrs: stored ``id, repo``; edges: stored ``src, dst``; repos: ``repo`` of those that are still there; records as in
    :func:`decision_links` with ``repo``.  Stale records and links of these repositories go; others stay as they are.
    """
    live = repos.select("repo").distinct()
    current = records.join(live, "repo", "left_semi")
    kept = adrs.join(live, "repo", "left_anti").select("id", "repo")
    now = kept.unionAll(current.select(F.col("adr").alias("id"), "repo")).distinct()
    renewed = adrs.join(live, "repo", "left_semi").select("id").unionAll(current.select(F.col("adr").alias("id"))).distinct()
    old = edges.select("src", "dst").join(renewed.withColumnRenamed("id", "src"), "src", "left_anti")
    fresh = decision_links(current, nodes).select(F.col("adr").alias("src"), F.col("target").alias("dst"))
    return now, old.unionAll(fresh).distinct()


def bound_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``context, declared, dst, from_build_path``: manifest entries (``context, repo, dir, declared``) bound to real files
    (``path``); a built ``.js`` file may mean the ``.ts`` file beside it; an entry without a file leads to a gap."""
    rel = normal_path(F.concat_ws("/", "dir", F.regexp_replace("declared", r"^/+", "")))
    asked = entries.withColumn("rel", rel)
    each = asked.select("*", F.explode(F.array(F.struct(F.lit(False).alias("built"), F.col("rel").alias("path")), F.struct(F.lit(True).alias("built"), F.when(F.col("rel").endswith(".js"), F.regexp_replace("rel", r"\.js$", ".ts")).alias("path")))).alias("c"))
    hits = each.select("context", "declared", "c.built", "c.path").join(files.select("path").distinct(), "path", "left_semi")
    told = first_by(hits, ["context", "declared"], "built")
    out = asked.join(told, ["context", "declared"], "left")
    dst = F.when(F.col("path").isNotNull(), F.concat(F.lit("file:"), "repo", F.lit("@"), "path")).otherwise(F.concat(F.lit("gap:webext:"), "repo", F.lit("@"), "rel"))
    return out.select("context", "declared", dst.alias("dst"), F.coalesce("built", F.lit(False)).alias("from_build_path"))


def expanded_modules(calls: DataFrame, resources: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """Addresses of all resources below a root folder, through local modules, and the modules' references.

    calls: ``dir, name, source`` (of a module block); resources: ``dir, address``.  A folder that is its own ancestor is
    not entered again; folders without files are not modules.  Returns ``address, dir`` of resources, and
    ``module, address`` of each module call with everything directly below it.  The rounds are as many as modules nest.
    """
    local = calls.where(F.col("source").startswith("./") | F.col("source").startswith("../"))
    known = calls.select("dir").unionAll(resources.select("dir")).distinct()
    local = written(local.select("dir", "name", normal_path(F.concat_ws("/", "dir", "source")).alias("child")).distinct().join(known.select(F.col("dir").alias("child")), "child", "left_semi").select("dir", "name", "child"), "modules")
    now = calls.sparkSession.createDataFrame([("", root, [root])], "prefix string, dir string, above array<string>")
    every = now
    while True:
        step = now.join(local, "dir").where(~F.array_contains("above", F.col("child")))
        prefix = F.concat("prefix", F.lit("module."), "name", F.lit("."))
        now, n = counted(step.select(prefix.alias("prefix"), F.col("child").alias("dir"), F.concat("above", F.array("child")).alias("above")), "modules")
        if not n:
            break
        every = every.unionAll(now)
    found = every.join(resources.select("dir", "address"), "dir")
    out = found.select(F.concat("prefix", "address").alias("address"), "dir")
    links = found.where("prefix <> ''").select(F.regexp_replace("prefix", r"\.$", "").alias("module"), F.concat("prefix", "address").alias("address"))
    return out, links.distinct()
