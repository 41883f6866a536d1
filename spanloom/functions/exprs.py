"""Column expressions shared by the operators: provenance, confidence, routes, names, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
TIERS = ("Deterministic", "Dynamic", "Semantic", "Agentic")
CONFIDENCE = ("Gap", "InferredWeak", "InferredStrong", "Confirmed")
HOP_WEIGHT = {"Confirmed": 1.0, "InferredStrong": 0.6, "InferredWeak": 0.3, "Gap": 0.0}
ID_PREFIX_LABEL = {
    "repo": "Repo",
    "file": "File",
    "sym": "Symbol",
    "mod": "Module",
    "ep": "Endpoint",
    "screen": "Screen",
    "chan": "Channel",
    "res": "Resource",
    "data": "DataEntity",
    "ext": "Extension",
    "extctx": "ExtensionContext",
    "extcmd": "Command",
    "tool": "Tool",
    "adr": "ADR",
    "gap": "Gap",
}
OWNED_PREFIXES = ("file", "sym", "ep", "screen", "res", "tool", "adr", "drift", "gap:call", "gap:chan", "gap:fetch")


def case(value: Column, table: dict, other=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(other))


def confidence_rank(conf: Column) -> Column:
    return case(conf, {c: k for k, c in enumerate(CONFIDENCE)})


def tier_rank(tier: Column) -> Column:
    return case(tier, {t: k for k, t in enumerate(TIERS)})


def ceiling(tier: Column) -> Column:
    """The strongest confidence that a tier may state."""
    return case(tier, {"Deterministic": "Confirmed", "Dynamic": "Confirmed", "Semantic": "InferredStrong", "Agentic": "InferredWeak"})


def valid_provenance(tier: Column, conf: Column) -> Column:
    return F.coalesce(confidence_rank(conf) <= confidence_rank(ceiling(tier)), F.lit(False))


def shown(tier: Column, conf: Column, extractor: Column, fallback: str = "spec.invalid-provenance") -> tuple[Column, Column, Column]:
    """Tier, confidence and extractor as shown: an invalid record is a deterministic gap of the fallback extractor."""
    ok = valid_provenance(tier, conf)
    return F.when(ok, tier).otherwise("Deterministic"), F.when(ok, conf).otherwise("Gap"), F.when(ok, extractor).otherwise(fallback)


def may_overwrite(producer: Column, existing: Column) -> Column:
    rank = confidence_rank(existing)
    return F.when(producer.isin("Deterministic", "Dynamic"), True).when(producer == "Semantic", rank <= 2).when(producer == "Agentic", rank <= 1).otherwise(False)


def hop_weight(conf: Column) -> Column:
    return case(conf, HOP_WEIGHT, 0.0)


def label_of(node_id: Column) -> Column:
    return case(F.substring_index(node_id, ":", 1), ID_PREFIX_LABEL, "Symbol")


def id_owned(node_id: Column, repo: str) -> Column:
    out = F.lit(False)
    for p in OWNED_PREFIXES:
        out = out | node_id.startswith(f"{p}:{repo}@")
    return out | (node_id == f"repo:{repo}")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def edge_identity(src: Column, label: Column, dst: Column) -> Column:
    return F.concat_ws(" ", src, label, dst)


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment; of a URL with a host but no path ``/``."""
    cut = F.regexp_replace(url, r"(?s)[?#].*$", "")
    after = F.regexp_replace(cut, r"(?s)^.*?://", "")
    path = F.regexp_replace(after, r"(?s)^[^/]*", "")
    return F.when(~cut.contains("://"), cut).when(path == "", "/").otherwise(path)


def route_matches(pattern: Column, concrete: Column) -> Column:
    """Segment-wise equality, where a ``:name`` segment of the pattern takes any one non-empty segment.

    A slash at the end makes one more, empty, segment.
    """
    p, c = F.split(pattern, "/"), F.split(concrete, "/")
    same = F.forall(F.zip_with(p, c, lambda x, y: (x == y) | (x.startswith(":") & (y != ""))), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(p) == F.size(c)) & same


def join_route(prefix: Column, path: Column) -> Column:
    left, right = F.regexp_replace(prefix, r"^/+|/+$", ""), F.regexp_replace(path, r"^/+|/+$", "")
    return F.concat(F.lit("/"), F.concat_ws("/", F.when(left != "", left), F.when(right != "", right)))


def joined_route(base: Column, tail: Column) -> Column:
    """The rule of mapping annotations: the tail's slashes at the end stay, a base without a tail stays as it is written."""
    left, right = F.regexp_replace(base, r"/+$", ""), F.regexp_replace(tail, r"^/+", "")
    return F.when((right == "") & (left != ""), left).otherwise(F.concat(left, F.lit("/"), right))


def route_pattern(pattern: Column) -> tuple[Column, Column]:
    """Method and path of ``METHOD /path``, one blank between; else the method is ANY and the path all of it."""
    form = r"(?s)^([A-Z]+) (/.*)$"
    method = F.regexp_extract(pattern, form, 1)
    return F.when(method == "", "ANY").otherwise(method), F.when(method == "", pattern).otherwise(F.regexp_extract(pattern, form, 2))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def plain_path(path: Column) -> Column:
    """With forward slashes and without leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def paths_match(observed: Column, source: Column) -> Column:
    """The observed path is the source's, or ends with it after a slash; only the observed one may be longer."""
    o, s = plain_path(observed), plain_path(source)
    return (o == s) | F.endswith(o, F.concat(F.lit("/"), s))


def normal_path(path: Column) -> Column:
    """The path without ``.`` and with ``..`` applied; leading ``..`` are dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))), "/")


#: Messaging systems by their exact lower-case names, and the kinds of their channels.
CHANNEL_KINDS = {
    "aws_sqs": "sqs-queue",
    "sqs": "sqs-queue",
    "aws_sns": "sns-topic",
    "sns": "sns-topic",
    "aws_eventbridge": "eventbridge-bus",
    "eventbridge": "eventbridge-bus",
    "kafka": "kafka-topic",
    "inproc": "inproc-event",
    "in-process": "inproc-event",
}


def channel_kind(system: Column) -> Column:
    """Kind of a messaging system's channels; null for a system that is not known."""
    return case(F.lower(system), CHANNEL_KINDS)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double, clamped to [0, 1]; null for a zero norm or unequal lengths."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def mermaid_id(node_id: Column) -> Column:
    return F.concat(F.regexp_replace(node_id, "[^A-Za-z0-9]", "_"), F.lit("_"), F.substring(content_hash(node_id), 1, 8))


def markdown_safe(text: Column) -> Column:
    """For a table cell: bars escaped, each line break a blank."""
    return F.translate(F.replace(text, F.lit("|"), F.lit("\\|")), "\r\n", "  ")


def span_of(text: Column, needle: Column) -> tuple[Column, Column]:
    """Byte span of the first occurrence, or of the whole text."""
    at = F.position(needle, text)
    start = F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1))).otherwise(0)
    return start, F.when(at > 0, start + F.octet_length(needle)).otherwise(F.octet_length(text))


def est_usd(size: Column, usd_in: float, usd_out: float) -> Column:
    """Cost of a prompt of so many bytes (4 to a token) and 500 answer tokens, at dollars per million tokens."""
    return size / 4 * usd_in / 1e6 + F.lit(500 * usd_out / 1e6)


def secret_shape(text: Column) -> Column:
    return (F.octet_length(text) >= 40) & text.rlike(r"\A[A-Za-z0-9+/_=.-]+\z")


#: Fixed values, in order: each sees what those before it left.
REDACTIONS = (
    (r"(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]"),
    (r"\b(?:github_pat_|gh[pousr]_|sk-)[A-Za-z0-9_-]{8,}", "[REDACTED TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED AWS ACCESS KEY]"),
    (r"""(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\b(\s*[:=]\s*[\"']?)([^\s\"',;}\]\[]{4,})""", "$1$2[REDACTED]"),
)


def redacted(text: Column) -> tuple[Column, Column]:
    """The text with every pattern replaced, one after the other, and how many matches were found."""
    hits = F.lit(0)
    for pattern, by in REDACTIONS:
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, by)
    return text, hits


def _named(columns: dict[str, Column], order: tuple[str, ...]) -> Column:
    return F.coalesce(*[columns[c] for c in (*order, "id") if c in columns])


def display_name(**columns: Column) -> Column:
    """Name in artifacts: first non-null of title, name, identity, logical_id, route, path, reason, id; endpoints show METHOD path."""
    first = _named(columns, ("title", "name", "identity", "logical_id", "route", "path", "reason"))
    if "method" in columns and "label" in columns:
        return F.when((columns["label"] == "Endpoint") & columns["method"].isNotNull(), F.concat_ws(" ", columns["method"], columns["path"])).otherwise(first)
    return first


def context_name(**columns: Column) -> Column:
    """Name in context lines: first non-null of title, name, identity, path, reason, id."""
    return _named(columns, ("title", "name", "identity", "path", "reason"))


def flow_name(label: Column, node_id: Column, props: Column) -> Column:
    """Name of a node in a flow, by its label, from JSON text of its properties."""
    get = lambda key: F.get_json_object(props, f"$.{key}")
    context = F.coalesce(get("entries[0]"), F.when(get("title") != "", get("title")))
    shown = (
        F.when(label == "Screen", F.concat(F.lit("Screen "), get("route")))
        .when(label == "Endpoint", F.concat(get("method"), F.lit(" "), get("path")))
        .when(label.isin("Symbol", "Component"), F.coalesce(get("name"), F.substring_index(node_id, "#", -1)))
        .when(label == "Channel", F.concat(get("kind"), F.lit(":"), get("identity")))
        .when(label == "ExtensionContext", F.concat_ws(" · ", F.coalesce(get("kind"), F.lit("context")), context))
        .when(label == "Command", F.concat(F.lit("Command "), get("name")))
        .when(label == "Gap", F.concat(F.lit("GAP: "), F.coalesce(get("reason"), F.lit("unresolved"))))
        .when(label == "File", get("path"))
    )
    return F.coalesce(shown, node_id)


def auth_state(props: Column) -> Column:
    """True, False, or null where nothing is said, from JSON text: a flag, a flag below ``auth``, or a word."""
    v = F.try_parse_json(props)
    flag = lambda path: F.when(F.schema_of_variant(F.variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
    word = F.when(F.schema_of_variant(F.variant_get(v, "$.auth", "variant")) == "STRING", F.lower(F.try_variant_get(v, "$.auth", "string")))
    said = F.when(word.isin("none", "public", "unauthenticated"), False).when(word.isin("required", "authenticated", "protected"), True)
    return F.coalesce(flag("$.authenticated"), flag("$.auth.authenticated"), said)
