"""From source files to the graph: facts of all files are joined into nodes, edges, channels, fetches and gaps.

Files give rows (`sources.extractors.facts`), each file by itself; everything that ties one file to another is a join here,
keyed by what the languages themselves use: path and name for scripts, folder and name for Go, full type name for the JVM.
A reference that is not proven leaves a visible gap, or nothing where it leads out of the system; nothing is guessed.

Nodes: ``id, label, props`` (JSON), edges: ``src, dst, label``, both with ``conf, tier, extractor, evidence`` (array of
structs ``repo, path, byte_start, byte_end``) ``, hash``.  Facts with one key are one: the evidence of all, in order of place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import url_path
from ..sources.extractors import facts
from .graph import Flows
from .lineage import dropped, written
from .resolve import fetches, first_candidate, stitched_channels
from .store import closure, first_by, last_by

#: Endings tried for a module that is named without one, in this order.
ENDINGS = {"typescript": ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"), "python": (".py", "/__init__.py")}
SCRIPTS, JVM = ("typescript", "python"), ("java", "kotlin")
_PLACE = "repo", "path", "byte_start", "byte_end"


def _id(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}:"), *[p if isinstance(p, Column) else F.lit(p) if p in "@#:" else F.col(p) for p in parts])


def _member(first: Column, second: Column) -> Column:
    return F.when(second != "", F.concat(first, F.lit("."), second)).otherwise(first)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _normal(path: Column) -> Column:
    """Without ``.`` and ``..``; null where it leads out of the root."""
    put = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), put), "/")


def _relative(module: Column, language: Column) -> Column:
    return module.startswith(".") & language.isin(*SCRIPTS)


def _module_base(folder: Column, module: Column, language: Column) -> Column:
    """The path, without an ending, that a module of a script names."""
    script = F.when(module.startswith("."), _normal(F.concat(folder, F.lit("/"), module)))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    rest = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    python = F.when(dots > 0, _normal(F.concat(folder, F.lit("/"), up, rest))).otherwise(rest)
    return F.when(language == "python", python).otherwise(script)


def asked(rows: DataFrame) -> DataFrame:
    """``ask, src, label`` with the place and names of every reference to a symbol: calls, handlers and rendered components."""
    source = F.when(F.col("owner") == "", _id("file", "repo", "@", "path")).otherwise(_id("sym", "repo", "@", "path", "#", "owner"))
    calls = rows.where("kind = 'calls'").select("*", source.alias("src"), F.lit("CALLS").alias("label"), F.col("name").alias("root"), F.col("detail").alias("member"))
    # a handler: inside a class the method of that name, else a name of the file, perhaps with a member
    handler = rows.where("kind = 'endpoint' and detail <> ''")
    classed = handler.join(rows.where("kind = 'declares' and detail = 'class'").select("repo", "path", F.col("name").alias("owner"), F.lit(True).alias("_in")), ["repo", "path", "owner"], "left")
    endpoint = _id("ep", "repo", "@", F.substring_index("name", " ", 1), ":", F.substring(F.col("name"), F.instr("name", " ") + 1, F.lit(1 << 30)))
    root = F.when(F.col("_in"), F.col("owner")).otherwise(F.substring_index("detail", ".", 1))
    member = F.when(F.col("_in"), F.col("detail")).when(F.col("detail").contains("."), F.substring_index("detail", ".", -1)).otherwise("")
    handled = classed.select(*rows.columns, endpoint.alias("src"), F.lit("HANDLES").alias("label"), root.alias("root"), member.alias("member"))
    # what renders a tag is the function or class around it; outside of any, nothing does
    component = _id("sym", "repo", "@", "path", "#", F.substring_index("owner", ".", 1))
    shown = rows.where("(kind = 'renders' and owner <> '' or kind = 'screen') and detail <> ''").select("*", F.when(F.col("kind") == "screen", _id("screen", "repo", "@", "name")).otherwise(component).alias("src"), F.lit("RENDERS").alias("label"), F.substring_index("detail", ".", 1).alias("root"), F.when(F.col("detail").contains("."), F.substring_index("detail", ".", -1)).otherwise("").alias("member"))
    every = calls.unionByName(handled).unionByName(shown)
    return every.withColumn("ask", F.concat_ws("@", "label", "repo", "path", "byte_start", "root", "member"))


def resolved(rows: DataFrame) -> DataFrame:
    """Every reference of :func:`asked` that has a target or leaves a gap: ``dst`` is null for the latter."""
    asks = written(asked(rows), "asks")
    names = rows.where("kind = 'declares'").select("repo", "path", "language", "name", _id("sym", "repo", "@", "path", "#", "name").alias("dst")).distinct()
    whole = asks.withColumn("name", _member(F.col("root"), F.col("member")))
    here = whole.drop("dst").join(names.drop("language"), ["repo", "path", "name"]).select("ask", "dst")
    left = written(asks.join(here, "ask", "left_anti"), "unresolved")
    # the import scope of the file is a key; a name bound more than once takes the last binding
    told = F.from_json("detail", "array<string>")
    binds = rows.where("kind = 'binds'").select("repo", "path", F.col("name").alias("root"), told[0].alias("module"), told[1].alias("imported"), F.col("byte_start").alias("seq"))
    bound = written(left.join(last_by(binds, ["repo", "path", "root"], "seq").drop("seq"), ["repo", "path", "root"], "left").withColumn("folder", _folder(F.col("path"))), "bound")
    out = [here, _scripts(bound, names, rows), _go(bound, names, rows), _jvm(bound, names, rows)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    result = written(asks.select("ask", "src", "label", *_PLACE, "language").join(found, "ask"), "resolved")
    dropped(asks, left, bound)
    return result


def _scripts(bound: DataFrame, names: DataFrame, rows: DataFrame) -> DataFrame:
    """Modules are files: the first candidate that exists, and the imported name in it; only a relative import leaves a gap."""
    mine = bound.where(F.col("language").isin(*SCRIPTS) & F.col("module").isNotNull())
    base = _module_base(F.col("folder"), F.col("module"), F.col("language"))
    want = F.when(F.col("imported") == "*", F.col("member")).otherwise(_member(F.col("imported"), F.col("member")))
    mine = mine.select("ask", "repo", "language", "label", _relative(F.col("module"), F.col("language")).alias("relative"), base.alias("base"), want.alias("name"))
    modules = mine.where("base is not null").select("repo", "language", "base").distinct()
    tries = F.when(F.col("language") == "python", F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS["python"]])).otherwise(F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS["typescript"]]))
    # a module is looked up once, however many references it has; the repository is part of the path that is compared
    key = F.concat_ws("\x00", "repo", "language", "base")
    within = F.transform(tries, lambda p: F.concat_ws("\x00", F.col("repo"), p))
    files = rows.select(F.concat_ws("\x00", "repo", "path").alias("path")).distinct()
    places = first_candidate(modules.select(key.alias("ask"), within.alias("candidates")), files).select(F.col("ask").alias("_m"), F.substring_index("path", "\x00", -1).alias("path"))
    placed = mine.withColumn("_m", key).join(places, "_m", "left")
    hit = placed.join(names.select("repo", "path", "name", "dst"), ["repo", "path", "name"], "left")
    return hit.where("dst is not null or (relative and label = 'CALLS')").select("ask", "dst")


def _go(bound: DataFrame, names: DataFrame, rows: DataFrame) -> DataFrame:
    """A package is a folder: an import's path without the module's name, or the file's own; of equal names the last file's counts."""
    modules = last_by(rows.where("kind = 'module'").select("repo", F.col("name").alias("_mod"), "path"), ["repo"], "path").drop("path")
    mine = bound.where("language = 'go'").join(modules, "repo", "left")
    inside = F.col("module").startswith(F.concat(F.col("_mod"), F.lit("/")))
    folder = F.when(F.col("module").isNull(), F.col("folder")).when(inside, F.expr("substring(module, length(_mod) + 2)")).when(F.col("module") == F.col("_mod"), "")
    name = F.when(F.col("module").isNotNull(), F.col("member")).otherwise(_member(F.col("root"), F.col("member")))
    keyed = mine.select("ask", "repo", folder.alias("folder"), name.alias("name")).where("folder is not null and name <> ''")
    known = last_by(names.where("language = 'go'").select("repo", _folder(F.col("path")).alias("folder"), "name", "path", "dst"), ["repo", "folder", "name"], "path").drop("path")
    return keyed.join(known, ["repo", "folder", "name"]).select("ask", "dst")


def _jvm(bound: DataFrame, names: DataFrame, rows: DataFrame) -> DataFrame:
    """A type is its full name, declared once: its member is the target; a package of the system without it leaves a gap."""
    packages = first_by(rows.where("kind = 'package'").select("repo", "path", F.col("name").alias("package"), "byte_start"), ["repo", "path"], "byte_start").drop("byte_start")
    types = rows.where(F.col("language").isin(*JVM) & (F.col("kind") == "declares") & (F.col("detail") == "class")).join(packages, ["repo", "path"])
    types = types.groupBy("repo", "package", F.col("name").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    mine = bound.where(F.col("language").isin(*JVM)).join(packages, ["repo", "path"], "left")
    imported = F.col("module").isNotNull()
    function = imported & (F.col("member") == "")  # an imported function: the module is its type
    package = F.when(function, F.regexp_replace("module", r"\.?[^.]*$", "")).when(imported, F.col("module")).otherwise(F.col("package"))
    kind = F.when(function, F.substring_index("module", ".", -1)).when(imported, F.col("imported")).otherwise(F.col("root"))
    member = F.when(function, F.col("imported")).otherwise(F.col("member"))
    mine = mine.select("ask", "repo", "label", imported.alias("imported"), package.alias("package"), kind.alias("type"), member.alias("member"))
    own = types.select("repo", "package").distinct().withColumn("_own", F.lit(True))
    met = mine.join(types, ["repo", "package", "type"], "left").join(own, ["repo", "package"], "left")
    met = met.withColumn("name", F.when(F.col("n") == 1, _member(F.col("type"), F.col("member"))))
    hit = met.join(names.select("repo", "path", "name", "dst"), ["repo", "path", "name"], "left")
    return hit.where("dst is not null or (_own and imported and label = 'CALLS')").select("ask", "dst")


def _stamped(df: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """One row for a key: evidence gathered in order of place, the other columns of the first."""
    place = F.struct(*_PLACE)
    out = df.groupBy(*key).agg(F.array_sort(F.collect_set(place)).alias("evidence"), *[F.min_by(c, place).alias(c) for c in rest])
    tier = F.when(F.col("conf") == "Gap", F.lit("None")).otherwise("Deterministic")
    return out.withColumn("tier", tier).withColumn("hash", F.sha2(F.concat_ws(" ", *key, F.to_json("evidence")), 256))


def graph_of(rows: DataFrame, env: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of FACTS; `env` (``key, value``) is what environment references are looked up in."""
    rows = written(rows, "facts")
    env = env if env is not None else rows.sparkSession.createDataFrame([], "key string, value string")
    hits = resolved(rows)
    owner = F.when(F.col("owner") == "", _id("file", "repo", "@", "path")).otherwise(_id("sym", "repo", "@", "path", "#", "owner"))
    sure = F.lit("Confirmed").alias("conf")
    props = lambda **kv: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.col(v)).alias(k) for k, v in kv.items()])).alias("props")
    declared = rows.where("kind = 'declares'")
    route = F.substring(F.col("name"), F.instr("name", " ") + 1, F.lit(1 << 30))
    verb = F.substring_index("name", " ", 1)
    ends = rows.where("kind = 'endpoint'")
    endpoint = _id("ep", "repo", "@", verb, ":", route)
    # channels and fetches go through the rules that have them, by the site
    site = F.concat_ws("@", "repo", "path", "byte_start", "name")
    told = F.from_json("detail", "array<string>")
    events = written(rows.where("kind = 'event'").select(*_PLACE, "language", site.alias("site"), F.substring_index("name", " ", 1).alias("kind"), F.substring_index("name", " ", -1).alias("role"), told[0].alias("id_kind"), told[1].alias("id_value"), owner.alias("symbol")), "events")
    channels, silent = stitched_channels(events, env)
    asks = rows.where("kind = 'fetch'").select(*_PLACE, "language", site.alias("site"), F.col("name").alias("method"), told[0].alias("k"), told[1].alias("v"), owner.alias("symbol"))
    asks = written(asks.join(env.select(F.col("key").alias("v"), F.col("value").alias("_e")), "v", "left").withColumn("url", url_path(F.when(F.col("k") == "Literal", F.col("v")).when(F.col("k") == "EnvRef", F.col("_e")))), "fetches")
    met = fetches(asks.select("site", "repo", "method", "url"), ends.select("repo", verb.alias("method"), route.alias("route"), endpoint.alias("id")).distinct())
    met = written(asks.join(met.drop("candidates"), "site"), "met")
    where = events.select("site", *_PLACE, "language", "symbol", "role", F.col("kind").alias("channel"))
    silent = written(silent.join(where, "site"), "silent")
    lost = hits.where("dst is null and label = 'CALLS'").withColumn("gap", F.concat(F.lit("gap:call:"), F.col("repo"), F.lit("@"), F.col("path"), F.lit("@"), F.col("byte_start").cast("string")))
    unmet = met.where("status <> 'matched'").withColumn("gap", F.concat(F.lit("gap:fetch:"), F.col("repo"), F.lit("@"), F.col("path"), F.lit("@"), F.col("byte_start").cast("string")))
    of = lambda df, node, label, conf, p: df.select(node.alias("id"), F.lit(label).alias("label"), p, F.lit(conf).alias("conf"), F.col("language").alias("extractor"), *_PLACE)
    nodes = [
        of(rows.select("repo", "path", "language", F.lit(0).cast("long").alias("byte_start"), F.lit(0).cast("long").alias("byte_end")).distinct(), _id("file", "repo", "@", "path"), "File", "Confirmed", props(path="path")),
        of(declared, _id("sym", "repo", "@", "path", "#", "name"), "Symbol", "Confirmed", props(name="name", kind="detail", language="language")),
        of(ends, endpoint, "Endpoint", "Confirmed", props(method=verb, path=route)),
        of(rows.where("kind = 'screen'"), _id("screen", "repo", "@", "name"), "Screen", "Confirmed", props(route="name")),
        of(channels.withColumnRenamed("dst", "id").join(where, "site"), F.col("id"), "Channel", "Confirmed", props(kind="channel", identity=F.expr("substring(id, length(channel) + 7)"))),
        of(silent, F.concat(F.lit("gap:chan:"), F.col("site")), "Gap", "Gap", props(reason="reason", kind="channel")),
        of(lost, F.col("gap"), "Gap", "Gap", props(reason=F.lit("call not resolved"))),
        of(unmet, F.col("gap"), "Gap", "Gap", props(reason="status")),
        of(rows.where("kind = 'gap'"), F.concat(F.lit("gap:file:"), F.col("repo"), F.lit("@"), F.col("path"), F.lit("@"), F.col("byte_start").cast("string")), "Gap", "Gap", props(reason="name")),
    ]
    to = lambda df, src, dst, label, conf: df.select(src.alias("src"), dst.alias("dst"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), F.lit(conf).alias("conf"), F.col("language").alias("extractor"), *_PLACE)
    role = F.when(F.col("role") == "Produces", "PUBLISHES").otherwise("SUBSCRIBES")
    edges = [
        to(declared, _id("sym", "repo", "@", "path", "#", "name"), _id("file", "repo", "@", "path"), "DEFINED_IN", "Confirmed"),
        to(hits.where("dst is not null"), F.col("src"), F.col("dst"), F.col("label"), "Confirmed"),
        to(lost, F.col("src"), F.col("gap"), "CALLS", "Gap"),
        to(channels.select("site", "dst").join(where, "site"), F.col("symbol"), F.col("dst"), role, "Confirmed"),
        to(silent, F.col("symbol"), F.concat(F.lit("gap:chan:"), F.col("site")), role, "Gap"),
        to(met.where("status = 'matched'"), F.col("symbol"), F.col("target"), "FETCHES", "Confirmed"),
        to(unmet, F.col("symbol"), F.col("gap"), "FETCHES", "Gap"),
    ]
    every = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(every(frames[1:]))
    edges = written(_stamped(every(edges), ["src", "dst", "label"], ["conf", "extractor"]), "edges")
    nodes = _stamped(every(nodes), ["id"], ["label", "props", "conf", "extractor"])
    ghosts = closure(nodes, edges).withColumns({"props": F.lit("{}"), "conf": F.lit("Gap"), "extractor": F.lit(None).cast("string"), "evidence": F.array().cast(dict(edges.dtypes)["evidence"]), "tier": F.lit("None"), "hash": F.sha2("id", 256)})
    nodes = written(written(nodes, "nodes").unionByName(ghosts), "nodes")
    dropped(rows, hits, events, asks, met, silent)
    return nodes, edges


def ingested(files: DataFrame, env: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of a system's files (``repo, path, text``)."""
    return graph_of(facts(files), env)


def ingested_flows(files: DataFrame, env: DataFrame | None = None) -> DataFrame:
    """Files in, scores of flows out (as :meth:`Flows.scores`)."""
    nodes, edges = ingested(files, env)
    return Flows(nodes, edges).scores(nodes.where("label = 'Gap'").select("id"))
