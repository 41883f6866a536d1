"""Resolution joins: unresolved references meet their targets or leave a visible gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import plain_path
from .store import first_by, last_by


def calls_or_gaps(calls: DataFrame, nodes: DataFrame, gap_only_if: Column | None = None) -> DataFrame:
    """Pending calls (``call_id, caller, candidate``): ``call_id, src, dst, label``; a miss becomes an edge to its gap.

    `gap_only_if` restricts which misses leave a gap; others are dropped.
    """
    known = nodes.select(F.col("id").alias("candidate"), F.lit(True).alias("_hit"))
    out = calls.join(known, "candidate", "left")
    if gap_only_if is not None:
        out = out.where(F.col("_hit").isNotNull() | gap_only_if)
    hit = F.col("_hit").isNotNull()
    return out.select("call_id", F.col("caller").alias("src"), F.when(hit, F.col("candidate")).otherwise(F.concat(F.lit("gap:call:"), "call_id")).alias("dst"), F.lit("CALLS").alias("label"), F.when(hit, "Confirmed").otherwise("Gap").alias("conf"))


def last_wins_join(calls: DataFrame, symbols: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Calls joined to the last definition of their key; a miss is dropped."""
    return calls.join(last_by(symbols, key, seq), key)


def unique_match(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `left` with the number of rows of `right` on the key (``candidates``) and, if exactly one, its ``target``."""
    counted = right.groupBy(*key).agg(F.count("*").alias("candidates"), F.first("target").alias("target"))
    out = left.join(counted, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("target", F.when(F.col("candidates") == 1, F.col("target")))


def typed_calls(calls: DataFrame, types: DataFrame) -> DataFrame:
    """Calls (``call, package, fqn``) to types by full name (``fqn, package, id``): ``call, dst, conf``.

    A name declared once is the target; declared more than once, or missing from a package that is declared here, it
    leaves a gap; calls into other packages are dropped.
    """
    known = types.groupBy("fqn").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    own = types.select("package").distinct().withColumn("_own", F.lit(True))
    out = calls.join(known, "fqn", "left").join(own, "package", "left").where("_n is not null or _own")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    return out.select("call", F.when(one, F.col("_id")).otherwise(F.concat(F.lit("gap:call:"), F.col("call").cast("string"))).alias("dst"), F.when(one, "Confirmed").otherwise("Gap").alias("conf"))


def first_candidate(asks: DataFrame, existing: DataFrame) -> DataFrame:
    """``ask, path``: the first of each ask's ordered candidates (array ``candidates``) that exists."""
    each = asks.select("ask", F.posexplode("candidates").alias("ord", "path"))
    return first_by(each.join(existing.select("path").distinct(), "path", "left_semi"), ["ask"], "ord").select("ask", "path")


def nearest_scope(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """``path, dir``: the longest directory (``dir``) that contains each file.

    A file's own ancestor directories are exploded, so the prefix condition is an equi-join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = files.select("path", F.posexplode(ancestors).alias("depth", "dir"))
    return last_by(each.join(scopes.select("dir").distinct(), "dir", "left_semi"), ["path"], "depth").select("path", "dir")


def first_definition(config: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``key, value``: the first definition by file and line; an override comes before all."""
    out = first_by(config.select("key", "value", "file", "line"), ["key"], "file", "line").select("key", "value")
    if overrides is None:
        return out
    return out.join(overrides.select("key"), "key", "left_anti").unionByName(overrides.select("key", "value"))


def stitched_channels(sites: DataFrame, env: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channel edges and gaps of event sites (``site, kind, role, id_kind, id_value, symbol``).

    A literal names its channel, an environment reference is looked up, anything computed stays a gap.
    """
    looked = sites.join(env.select(F.col("key").alias("id_value"), F.col("value").alias("_v")), "id_value", "left")
    identity = F.when(F.col("id_kind") == "Literal", F.col("id_value")).when(F.col("id_kind") == "EnvRef", F.col("_v"))
    looked = looked.withColumn("identity", identity)
    edges = looked.where("identity is not null").select("site", F.col("symbol").alias("src"), F.concat_ws(":", F.lit("chan"), "kind", "identity").alias("dst"), F.when(F.col("role") == "Produces", "PUBLISHES").otherwise("SUBSCRIBES").alias("label"))
    reason = F.when(F.col("id_kind") == "EnvRef", F.concat(F.lit("environment key not defined: "), "id_value")).otherwise("computed identity")
    return edges, looked.where("identity is null").select("site", F.concat(F.lit("gap:chan:"), "site").alias("gap"), reason.alias("reason"))


def fetches(sites: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Fetch sites (``site, repo, method, url``; url null if unresolved) against endpoints (``id, repo, method, route``).

    ``site, status, target, candidates``: exactly one hit is a match, none or several leave a gap that says which.
    A route matches where it equals the URL's path with some segments taken for parameters.  The sets of parameter places
    that a repository's routes of one method and length have are few; each URL is written once per set, with ``:`` at its
    places, and joined by equality, so unlike routes never meet.
    """
    cut = lambda c: F.split(c, "/")
    mask = F.transform(cut(F.col("route")), lambda x: x.startswith(":"))
    shape = F.concat_ws("/", F.transform(cut(F.col("route")), lambda x: F.when(x.startswith(":"), ":").otherwise(x)))
    ends = endpoints.select("repo", "method", F.col("id").alias("target"), mask.alias("mask"), shape.alias("shape"), F.size(mask).alias("_n"))
    known = sites.where("url is not null and method <> '?'").withColumn("_n", F.size(cut(F.col("url"))))
    masks = ends.select("repo", "method", "_n", "mask").distinct()
    segments = F.zip_with(cut(F.col("url")), "mask", lambda x, m: F.when(m & (x != ""), ":").when(~m, x))
    written_ = known.select("site", "repo", "method", "url", "_n").join(masks, ["repo", "method", "_n"]).withColumn("_s", segments)
    asked = written_.where(~F.exists("_s", lambda x: x.isNull())).select("site", "repo", "method", "mask", F.concat_ws("/", "_s").alias("shape"))
    hits = asked.join(ends.drop("_n"), ["repo", "method", "mask", "shape"]).groupBy("site").agg(F.countDistinct("target").alias("candidates"), F.min("target").alias("target"))
    out = sites.join(hits, "site", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    status = F.when(F.col("url").isNull(), "url not resolved").when(F.col("method") == "?", "method not resolved").when(F.col("candidates") == 1, "matched").when(F.col("candidates") == 0, "no recovered endpoint").otherwise(F.format_string("ambiguous (%d candidates)", "candidates"))
    return out.select("site", status.alias("status"), F.when(status == "matched", F.col("target")).alias("target"), "candidates")


def expanded_policies(grants: DataFrame, statements: DataFrame) -> DataFrame:
    """Grants to a policy document become grants to its statements' targets with the union of actions."""
    each = grants.join(statements, "document", "left")
    told = each.select("principal", F.coalesce("target", "document").alias("target"), F.explode_outer("actions").alias("action")).distinct()
    return told.groupBy("principal", "target").agg(F.array_sort(F.collect_list("action")).alias("actions"))


def traced_gaps(gaps: DataFrame, spans: DataFrame) -> DataFrame:
    """Gaps (``gap, kind, path``) against spans (``kind, path, identity``; path null if not located).

    Where any span of a kind is located, only spans whose path is the gap's, or ends with it after a slash, count; else
    spans count for the only gap of their kind.  Exactly one identity resolves; otherwise ``reason`` says what was tried.
    An observed path's endings are exploded, so the suffix condition is an equi-join.
    """
    located = spans.groupBy("kind").agg(F.max(F.col("path").isNotNull()).alias("located"))
    alone = gaps.groupBy("kind").agg(F.count("*").alias("n"))
    asked = gaps.withColumn("path", plain_path(F.col("path"))).join(located, "kind", "left").join(alone, "kind")
    parts = F.split(plain_path(F.col("path")), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    ends = spans.where("path is not null").select("kind", "identity", F.explode(endings).alias("path")).distinct()
    by_path = asked.where("located").join(ends, ["kind", "path"]).select("gap", "identity")
    by_kind = asked.where("not located and n = 1").join(spans.select("kind", "identity"), "kind").select("gap", "identity")
    told = by_path.unionAll(by_kind).groupBy("gap").agg(F.countDistinct("identity").alias("identities"), F.min("identity").alias("identity"))
    reason = F.when(F.col("identities") == 0, "no trace observation uniquely matched this source gap").when(F.col("identities") > 1, "multiple observed channel identities matched this source gap")
    out = gaps.select("gap", "kind").join(told, "gap", "left").withColumn("identities", F.coalesce("identities", F.lit(0)))
    return out.select("gap", "kind", "identities", F.when(F.col("identities") == 1, F.col("identity")).alias("identity"), reason.alias("reason"))


def replaced_gaps(nodes: DataFrame, edges: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved proposals (``src, gap, label, target, conf``) over the graph; none of it is stored.

    A proposal counts only if its gap edge exists.  A resolved gap goes with every edge into it.
    """
    real = approved.join(edges.where("conf = 'Gap'").select("src", F.col("dst").alias("gap"), "label"), ["src", "gap", "label"], "left_semi")
    gone = real.select(F.col("gap").alias("id")).distinct()
    kept = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "label", "conf")
    new = real.select("src", F.col("target").alias("dst"), "label", "conf")
    return nodes.join(gone, "id", "left_anti"), first_by(kept.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1))), ["src", "dst", "label"], "_o", "conf").select("src", "dst", "label", "conf")


def worst_claims(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (``path, line``) with the worst of their claims (``path, line, outcome``)."""
    worst = claims.groupBy("path", "line").agg(F.bool_or(F.col("outcome") == "Dynamic").alias("_d"), F.bool_or(F.col("outcome") == "ConstUnproven").alias("_u"))
    verdict = F.when(F.col("_d").isNull() | F.col("_d"), "unsupported").when(F.col("_u"), "potential gap").otherwise("closed")
    return findings.join(worst, ["path", "line"], "left").select("path", "line", verdict.alias("verdict"))


def proven_constants(uses: DataFrame, imports: DataFrame, constants: DataFrame) -> DataFrame:
    """Two hops from a use (``use, file, name, member``) over its import to the constant; conflicting values prove nothing."""
    one = constants.groupBy("file", "object", "member").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").select(F.col("file").alias("source"), "object", "member", "value")
    bound = uses.join(imports.select("file", "name", "source", "object"), ["file", "name"])
    return uses.select("use").join(bound.join(one, ["source", "object", "member"]).select("use", "value").distinct(), "use", "left")


def ranked(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key.

    Before the window a struct-free prefilter is not needed: Spark limits groups on the map side
    (WindowGroupLimit), so a hot key sends at most k rows per task.
    """
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
