"""Readers of configuration and runtime observations: env files, OTLP traces, Terraform and Pulumi state, manifests, ADRs."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import last_by

LAYERS = ("infra", "cloud", "server", "events", "client")
#: Folders that hold dependencies, build output or version control, not sources.
SKIPPED_DIRS = (".git", ".venv", "__pycache__", "build", "dist", "node_modules", "target")
REDACTED = "[redacted]"


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, content`` (binary) of the files under `root`, without skipped folders; rows have no order."""
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.where(~F.col("path").rlike(f"/({skipped})/")).select("path", "content")


def listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, size`` of the files under `root`, without skipped folders, in the order of their paths; no content is read."""
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.where(~F.col("path").rlike(f"/({skipped})/")).select("path", F.col("length").alias("size")).orderBy("path")


def env_entries(lines: DataFrame) -> DataFrame:
    """``file, line, key, value`` of KEY=VALUE lines (``file, line, text``).

    Comments, blanks and keys with white space are left out; quotes go from both ends of a value, paired or not.
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    told = lines.withColumn("_t", text).where(F.col("_t").contains("=") & ~F.col("_t").startswith("#"))
    key = F.regexp_replace(F.regexp_replace(F.substring_index("_t", "=", 1), r"\s+$", ""), r"^(?:export )*\s*", "")
    value = F.regexp_replace(F.regexp_replace("_t", r"^[^=]*=\s*", ""), r"""^["']+|["']+$""", "")
    return told.select("file", "line", key.alias("key"), value.alias("value")).where((F.col("key") != "") & ~F.col("key").rlike(r"\s"))


def repo_name(url: Column) -> Column:
    """``owner/name`` of an https or ssh clone URL."""
    return F.regexp_extract(url, r"^(?:https?://[^/]+/|git@[^:]+:|ssh://[^/]+/)([^/]+/[^/]+?)(?:\.git)?/?$", 1)


def manifest(text: str) -> dict:
    """A system manifest (TOML); unknown layers are refused."""
    spec = tomllib.loads(text)
    for repo in spec.get("repos", []):
        if unknown := set(repo.get("layers", [])) - set(LAYERS):
            raise ValueError(f"unknown layers: {sorted(unknown)}")
    return spec


def manifest_frame(spark: SparkSession, text: str) -> DataFrame:
    """``url, layers, state_json, pulumi_json, otel_jsonl`` of a manifest's repositories, in its order."""
    rows = [(k, r["url"], r.get("layers", []), r.get("state_json"), r.get("pulumi_json"), r.get("otel_jsonl", [])) for k, r in enumerate(manifest(text).get("repos", []))]
    return spark.createDataFrame(rows, "place int, url string, layers array<string>, state_json string, pulumi_json string, otel_jsonl array<string>")


def manifests(files: DataFrame) -> DataFrame:
    """``path`` and the columns of :func:`manifest_frame` for the repositories of many manifests (``path, text``)."""
    names = ["path", "place", "url", "layers", "state_json", "pulumi_json", "otel_jsonl"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [(p, k, r) for p, t in zip(frame["path"], frame["text"], strict=True) if t is not None for k, r in enumerate(manifest(t).get("repos", []))]
            yield pd.DataFrame([(p, k, r["url"], r.get("layers", []), r.get("state_json"), r.get("pulumi_json"), r.get("otel_jsonl", [])) for p, k, r in told], columns=names)

    return files.select("path", "text").mapInPandas(run, "path string, place int, url string, layers array<string>, state_json string, pulumi_json string, otel_jsonl array<string>")


def manifest_env(spark: SparkSession, text: str) -> DataFrame:
    """``key, value``: identities that the author declares; they come before any env file."""
    return spark.createDataFrame(sorted((k, str(v)) for k, v in (manifest(text).get("env") or {}).items()), "key string, value string")


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,string_value:string,int_value:string,double_value:double,bool_value:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,trace_id:string,spanId:string,span_id:string,name:string,attributes:{_ATTRS}>"
_OTLP = ", ".join(f"{r} array<struct<resource:struct<attributes:{_ATTRS}>,{', '.join(f'{s}:array<struct<spans:array<{_SPAN}>>>' for s in ('scopeSpans', 'scope_spans'))}>>" for r in ("resourceSpans", "resource_spans"))


def _attributes(column: Column) -> Column:
    """Scalar attributes as a map of text; others are left out."""
    v = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["string_value"], a["value"]["intValue"], a["value"]["int_value"], a["value"]["doubleValue"].cast("string"), a["value"]["double_value"].cast("string"), a["value"]["boolValue"].cast("string"), a["value"]["bool_value"].cast("string"))
    entries = F.transform(F.coalesce(column, F.array().cast(_ATTRS)), lambda a: F.named_struct(F.lit("key"), a["key"], F.lit("value"), v(a)))
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    first = F.filter(kept, lambda e, i: F.array_position(F.transform(kept, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def otlp_spans(lines: DataFrame) -> DataFrame:
    """``trace_id, span_id, name, attributes, resource`` of JSON lines (``text``) in either spelling; spans without an id are left out."""
    doc = F.from_json("text", _OTLP)
    r = lines.select(doc.alias("d")).select(F.explode(F.coalesce("d.resourceSpans", "d.resource_spans")).alias("r"))
    s = r.select(_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode(F.coalesce("r.scopeSpans", "r.scope_spans")).alias("s"))
    p = s.select("resource", F.explode("s.spans").alias("p"))
    out = p.select(F.coalesce("p.traceId", "p.trace_id").alias("trace_id"), F.coalesce("p.spanId", "p.span_id").alias("span_id"), "p.name", _attributes(F.col("p.attributes")).alias("attributes"), "resource")
    return out.where("coalesce(span_id, '') <> ''")


def attribute(*keys: str) -> Column:
    """The first key that a span or, for that key, its resource has."""
    return F.coalesce(*[F.col(m)[k] for k in keys for m in ("attributes", "resource")])


def _tf_rows(text: str) -> list[tuple]:
    doc = json.loads(text)
    top = (doc.get("values") or doc.get("planned_values") or {}).get("root_module") or {}
    out, todo = [], [top]
    while todo:
        module = todo.pop(0)
        for r in module.get("resources", []):
            hidden = r.get("sensitive_values") or {}
            values = {k: (REDACTED if hidden.get(k) is True else v) for k, v in (r.get("values") or {}).items() if v is not None and not isinstance(v, dict | list)}
            out.append((r.get("address"), r.get("type"), r.get("name"), json.dumps(values, sort_keys=True)))
        todo += module.get("child_modules", [])
    return out


def _tf_modules(text: str) -> list[tuple]:
    doc = json.loads(text)
    todo, out = [(doc.get("values") or doc.get("planned_values") or {}).get("root_module") or {}], []
    while todo:
        module = todo.pop(0)
        if module.get("address"):
            out.append((module["address"], len(module.get("resources") or [])))
        todo += module.get("child_modules") or []
    return out


def _redact(value):
    """Pulumi secret wrappers are masked wherever they are."""
    if isinstance(value, dict):
        if "ciphertext" in value or "secure" in value or "4dabf18193072939515e22adb298388d" in value:
            return REDACTED
        return {k: _redact(v) for k, v in value.items()}
    return [_redact(v) for v in value] if isinstance(value, list) else value


def _pulumi_rows(text: str) -> list[tuple]:
    try:
        docs = [json.loads(text)]
    except ValueError:
        docs = [json.loads(x) for x in text.splitlines() if x.strip()]
    out = []
    for doc in docs:
        rows = (doc.get("deployment") or {}).get("resources") or doc.get("resources") or []
        for event in ("resourcePreEvent", "resOutputsEvent"):
            meta = (doc.get(event) or {}).get("metadata") or {}
            if meta.get("op") == "delete":
                continue
            rows = rows + ([meta["new"]] if meta.get("new") else [])
        for r in rows:
            if r.get("delete") or r.get("type", "").startswith(("pulumi:pulumi:Stack", "pulumi:providers:")):
                continue
            out.append((len(out), r.get("urn"), r.get("type"), json.dumps(_redact(r.get("inputs") or {}), sort_keys=True), json.dumps(_redact(r.get("outputs") or {}), sort_keys=True)))
    return out


def _parsed(rows, columns: list[str]):
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                yield pd.DataFrame([(path, *r) for r in rows(text)], columns=columns)

    return parse


def terraform_resources(documents: DataFrame) -> DataFrame:
    """``path, address, type, name, values`` (JSON of scalars, sensitive ones masked) of state or plan documents (``path, text``)."""
    return documents.select("path", "text").mapInPandas(_parsed(_tf_rows, ["path", "address", "type", "name", "values"]), "path string, address string, type string, name string, values string")


def terraform_modules(documents: DataFrame) -> DataFrame:
    """``path, address, resources``: the modules of state or plan documents and how many resources each has itself."""
    return documents.select("path", "text").mapInPandas(_parsed(_tf_modules, ["path", "address", "resources"]), "path string, address string, resources long")


def pulumi_resources(documents: DataFrame) -> DataFrame:
    """``path, urn, type, inputs, outputs``: the last record of each URN in exports, previews or event lines."""
    rows = documents.select("path", "text").mapInPandas(_parsed(_pulumi_rows, ["path", "seq", "urn", "type", "inputs", "outputs"]), "path string, seq long, urn string, type string, inputs string, outputs string")
    return last_by(rows, ["path", "urn"], "seq").drop("seq")


def decision_records(documents: DataFrame) -> DataFrame:
    """``path, title, status, governs, mentions, forbids`` of Markdown records by path (folder or file name) and size (up to 1 MiB).

    A record governs what its field lists; what it names as inline code it mentions.
    """
    named = F.col("path").rlike(r"(?i)(^|/)(adrs?|decisions?|rfcs?)/[^/]*\.md$") | F.col("path").rlike(r"(?i)(^|/)(adr|rfc)-[^/]*\.md$")
    field = lambda name: F.regexp_extract("text", rf"(?im)^\s*(?:[-*]\s*)?(?:\*\*)?{name}:(?:\*\*)?\s*(.+?)\s*$", 1)
    items = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.trim(x), "^`|`$", "")), lambda x: x != "")
    found = documents.where(named & (F.octet_length("text") <= 1 << 20))
    title = F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1)
    spans = F.regexp_extract_all("text", F.lit("`([^`\n]+)`"), F.lit(1))
    return found.select("path", title.alias("title"), field("Status").alias("status"), items(field("Governs")).alias("governs"), spans.alias("mentions"), F.filter(items(field("Forbids")), lambda x: x.rlike("^[A-Z_]+$")).alias("forbids"))


_JSONC = re.compile(r"""("(?:\\.|[^"\\])*"?)|//[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)
_TRAILING = re.compile(r"""("(?:\\.|[^"\\])*"?)|,(?=\s*[}\]])""", re.S)


def without_comments(text: str) -> str:
    """JSON text of JSONC: comments go, then trailing commas; strings stay as they are.  Two passes over the text."""
    for pattern in (_JSONC, _TRAILING):
        text = pattern.sub(lambda m: m[1] or "", text)
    return text


def tsconfig_paths(documents: DataFrame) -> DataFrame:
    """``dir, config_path, base_url, pattern, targets`` of tsconfig documents (``path, text``); one without patterns, or
    unreadable, has one row without a pattern."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    options = json.loads(without_comments(text)).get("compilerOptions") or {}
                except (ValueError, AttributeError, TypeError):
                    options = {}
                folder, base = path.rpartition("/")[0], options.get("baseUrl")
                paths = options.get("paths") or {}
                rows += [(folder, path, base, p, [x for x in t if isinstance(x, str)]) for p, t in paths.items()] or [(folder, path, base, None, [])]
            yield pd.DataFrame(rows, columns=["dir", "config_path", "base_url", "pattern", "targets"])

    return documents.select("path", "text").mapInPandas(parse, "dir string, config_path string, base_url string, pattern string, targets array<string>")


def package_entries(documents: DataFrame) -> DataFrame:
    """``name, dir, entries, config_path`` of package.json documents with a name and entries, in the order in which they
    are preferred: exports (import, default, require), module, main."""

    def entries(doc: dict) -> list[str]:
        exports = doc.get("exports")
        dot = exports.get(".") if isinstance(exports, dict) else exports
        told = [dot.get(k) for k in ("import", "default", "require")] if isinstance(dot, dict) else [dot]
        return [re.sub(r"^(?:\./)+", "", x) for x in [*told, doc.get("module"), doc.get("main")] if isinstance(x, str)]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    doc = json.loads(text)
                except (ValueError, TypeError):
                    continue
                if isinstance(doc, dict) and isinstance(doc.get("name"), str) and entries(doc):
                    rows.append((doc["name"], path.rpartition("/")[0], entries(doc), path))
            yield pd.DataFrame(rows, columns=["name", "dir", "entries", "config_path"])

    return documents.select("path", "text").mapInPandas(parse, "name string, dir string, entries array<string>, config_path string")


WINDOW = 256 << 10


def evidence_slice(content: DataFrame, limit: int = WINDOW) -> DataFrame:
    """``path, text, start_line``: the bytes byte_start to byte_end of each file (``path, content`` binary), then decoded."""
    part = F.expr("substring(content, cast(byte_start as int) + 1, cast(least(byte_end - byte_start, " + str(limit) + ") as int))")
    return content.select("path", F.decode(part, "UTF-8").alias("text"), _line_of("byte_start").alias("start_line"))


def _line_of(at: str) -> Column:
    before = F.expr(f"decode(substring(content, 1, cast({at} as int)), 'ISO-8859-1')")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def evidence_window(content: DataFrame, limit: int = WINDOW) -> DataFrame:
    """``path, window_start, text, start_line, truncated``: at most `limit` bytes of each file (``path, content, byte_start,
    byte_end``), from half the room before the span on, with the line that the window begins in; small files are whole."""
    size, span = F.octet_length("content").cast("bigint"), (F.col("byte_end") - F.col("byte_start")).cast("bigint")
    room = F.floor(F.greatest(F.lit(limit) - span, F.lit(0)) / 2)
    start = F.when(size <= limit, F.lit(0)).otherwise(F.least(F.greatest(F.col("byte_start") - room, F.lit(0)), size)).cast("bigint")
    framed = content.withColumn("window_start", start)
    part = F.expr(f"substring(content, cast(window_start as int) + 1, {int(limit)})")
    cut = (F.col("window_start") > 0) | (F.col("window_start") + limit < size)
    return framed.select("path", "window_start", F.decode(part, "UTF-8").alias("text"), _line_of("window_start").alias("start_line"), cut.alias("truncated"))
