"""Source extractors: files become symbols, imports, endpoints and call sites; what cannot be proven yields nothing.

Each is a generator from text to rows ``(kind, name, detail, start, end)`` with byte offsets; `extracted` runs
the one that a path's extension names over a whole frame of files.
"""

from __future__ import annotations

import ast
import bisect
import functools
import json
import re
import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hcl
from .scopes import scope_rows

SCHEMA = "path string, language string, kind string, name string, detail string, byte_start long, byte_end long"
HTTP = ("get", "post", "put", "patch", "delete", "head", "options")
Row = tuple[str, str, str, int, int]

#: Forms of event SDK calls: channel kind, role, form, module, constructor or factory, method, key of the
#: identity (null: the first argument).
EVENT_SDKS = (
    ("sqs-queue", "Produces", "new", "@aws-sdk/client-sqs", "SendMessageCommand", None, "QueueUrl"),
    ("sns-topic", "Produces", "new", "@aws-sdk/client-sns", "PublishCommand", None, "TopicArn"),
    ("eventbridge-detail-type", "Produces", "new", "@aws-sdk/client-eventbridge", "PutEventsCommand", None, "DetailType"),
    ("sqs-queue", "Produces", "method", "aws-sdk", "AWS.SQS", "sendMessage", "QueueUrl"),
    ("sns-topic", "Produces", "method", "aws-sdk", "AWS.SNS", "publish", "TopicArn"),
    ("sqs-queue", "Consumes", "new", "sqs-consumer", "Consumer", None, "queueUrl"),
    ("kafka-topic", "Produces", "factory", "kafkajs", "producer", "send", "topic"),
    ("kafka-topic", "Consumes", "factory", "kafkajs", "consumer", "subscribe", "topic"),
    ("inproc-event", "Produces", "method", "events", "EventEmitter", "emit", None),
    ("inproc-event", "Consumes", "method", "events", "EventEmitter", "on", None),
)
#: Endings of Go file names that tie a file to a platform.
GO_SYSTEMS = ("aix", "android", "darwin", "dragonfly", "freebsd", "illumos", "ios", "js", "linux", "netbsd", "openbsd", "plan9", "solaris", "wasip1", "windows")
GO_MACHINES = ("386", "amd64", "arm", "arm64", "loong64", "mips", "mips64", "mips64le", "mipsle", "ppc64", "ppc64le", "riscv64", "s390x", "wasm")


@functools.lru_cache(maxsize=4)  # many patterns ask for one text's
def _offsets(text: str) -> Sequence[int]:
    """Byte offset of every character and of the end."""
    if text.isascii():
        return range(len(text) + 1)
    out, at = [0], 0
    for c in text:
        at += len(c.encode())
        out.append(at)
    return out


def _until(text: str, at: int, stops: str) -> int:
    """Where, outside brackets and strings, the first of the `stops` follows, or a bracket closes that was not opened."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "\"'`":
            at += 1
            while at < len(text) and text[at] != c:
                at += 2 if text[at] == "\\" else 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            if not depth:
                return at
            depth -= 1
        elif c in stops and not depth:
            return at
        at += 1
    return len(text)


def _arguments(text: str, at: int) -> list[str]:
    """The argument expressions of a call whose bracket opens before `at`."""
    out = []
    while at < len(text):
        end = _until(text, at, ",")
        if text[at:end].strip():
            out.append(text[at:end].strip())
        if end >= len(text) or text[end] != ",":
            return out
        at = end + 1
    return out


def _member(expression: str, key: str) -> str | None:
    """The expression under a key of an object literal, at any depth."""
    m = re.search(rf"(?<![\w$.]){re.escape(key)}\s*(:|(?=[,}}]))", expression)
    if not m:
        return None
    return expression[m.end() : _until(expression, m.end(), ",")].strip() if m[1] else key


def identity(expression: str, constants: dict[str, str] | None = None) -> tuple[str, str]:
    """Literal, EnvRef or Computed, and the value; a constant bound to one literal in the file is that literal."""
    e = expression.strip()
    if m := re.fullmatch(r"""(["'`])((?:(?!\1)[^\\$])*)\1""", e):
        return "Literal", m[2]
    if m := re.fullmatch(r"""process\.env(?:\.([A-Za-z_]\w*)|\[["']([^"']+)["']\])!?""", e):
        return "EnvRef", m[1] or m[2]
    if constants and e in constants:
        return "Literal", constants[e]
    return "Computed", e


def _constants(text: str) -> dict[str, str]:
    """Names bound by const to a string literal, once in the file."""
    found: dict[str, set[str]] = {}
    for m in re.finditer(r"""\bconst\s+([A-Za-z_$][\w$]*)(?:\s*:\s*\w+)?\s*=\s*(["'`])((?:(?!\2)[^\\$])*)\2\s*(?:as\s+const\s*)?(?=[;\n])""", text):
        found.setdefault(m[1], set()).add(m[3])
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1}


def _bindings(text: str) -> dict[str, tuple[str, str]]:
    """Names that a file imports: (module, imported name; ``*`` for the whole module)."""
    out: dict[str, tuple[str, str]] = {}
    for m in re.finditer(r"""\bimport\s+(?:type\s+)?([^"';]+?)\s+from\s+["']([^"']+)["']""", text):
        head, _, listed = m[1].partition("{")
        for name in re.findall(r"[A-Za-z_$][\w$]*", head.replace("* as", " ")):
            out[name] = (m[2], "*")
        for item in listed.rstrip("} \n").split(","):
            if w := re.findall(r"[A-Za-z_$][\w$]*", item):
                out[w[-1]] = (m[2], w[0])
    for m in re.finditer(r"""\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\s*\(\s*["']([^"']+)["']\s*\)""", text):
        if m[1][0] == "{":
            for item in m[1].strip("{} \n").split(","):
                if w := re.findall(r"[A-Za-z_$][\w$]*", item):
                    out[w[-1]] = (m[2], w[0])
        else:
            out[m[1]] = (m[2], "*")
    return {k: (module.removeprefix("node:"), name) for k, (module, name) in out.items()}


def _python(text: str) -> Iterator[Row]:
    tree = ast.parse(text)
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    span = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)
    proven: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, a.asname or "", *span(node)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "import", "." * node.level + (node.module or ""), a.name, *span(node)
                if node.module in ("fastapi", "flask"):
                    proven[a.asname or a.name] = a.name
    receivers: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
            made = proven.get(node.value.func.id)
            if made in ("FastAPI", "APIRouter", "Flask", "Blueprint"):
                prefix = next((k.value.value for k in node.value.keywords if k.arg in ("prefix", "url_prefix") and isinstance(k.value, ast.Constant)), "")
                receivers |= {t.id: prefix for t in node.targets if isinstance(t, ast.Name)}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield "symbol", node.name, type(node).__name__, *span(node)
            for d in node.decorator_list:
                f = d.func if isinstance(d, ast.Call) else None
                if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in receivers and d.args and isinstance(d.args[0], ast.Constant):
                    route = receivers[f.value.id] + str(d.args[0].value)
                    verbs = [f.attr.upper()] if f.attr in HTTP else []
                    if f.attr == "route":
                        verbs = next(([e.value for e in k.value.elts if isinstance(e, ast.Constant)] for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), ["GET"])
                    for verb in verbs:
                        yield "endpoint", f"{verb} {route}", node.name, *span(d)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            yield "call", node.func.id, "", *span(node)


def _matches(text: str, pattern: str, make) -> Iterator[Row]:
    at = None
    for m in re.finditer(pattern, text, re.M | re.S):
        at = at or _offsets(text)
        for kind, name, detail in make(m):
            yield kind, name, detail, at[m.start()], at[m.end()]


def _blanked(text: str) -> str:
    """Comments as spaces, so that offsets hold."""
    return re.sub(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", lambda m: m[1] or re.sub(r"[^\n]", lambda c: " " * len(c[0].encode()), m[0]), text, flags=re.S)


def _constructors(bindings: dict, module: str, ctor: str) -> list[str]:
    """The expressions by which a file may name a constructor of a module."""
    whole, _, part = ctor.partition(".")
    out = []
    for name, (source, imported) in bindings.items():
        if source != module:
            continue
        if part and (imported == "*" or imported == whole):
            out.append(f"{name}.{part}")
        elif not part and imported == ctor:
            out.append(name)
        elif not part and imported == "*":
            out += [f"{name}.{ctor}", name]
    return [re.escape(x) for x in out]


def _bound(text: str, value: str) -> list[str]:
    """Names (also of properties) bound to a value, given as a pattern."""
    return sorted({re.escape(x) for x in re.findall(rf"([A-Za-z_$][\w$]*)(?:\s*:\s*[\w.<>]+)?\s*=\s*(?:await\s+)?{value}", text)})


def _handler(text: str, at: int) -> str:
    """The last argument of a call, if it is a name."""
    given = _arguments(text, at)
    return given[-1] if given and re.fullmatch(r"[\w$.]+", given[-1]) else ""


def _events(text: str, bindings: dict, constants: dict) -> Iterator[Row]:
    """Event sites of SDK objects that are proven to come from their module."""
    for kind, role, form, module, ctor, method, key in EVENT_SDKS:
        if form == "factory":
            names = _bound(text, rf"[\w$.]+\.{ctor}\s*\(") if any(m == module for m, _ in bindings.values()) else []
        else:
            names = _constructors(bindings, module, ctor)
            if form == "method" and names:
                names = _bound(text, rf"new\s+(?:{'|'.join(names)})\s*\(")
        if not names:
            continue
        pattern = rf"\bnew\s+(?:{'|'.join(names)})\s*\(" if form == "new" else rf"(?<![\w$])(?:this\.)?(?:{'|'.join(names)})\.{method}\s*\("

        def site(m, kind=kind, role=role, key=key):
            given = _arguments(text, m.end())
            said = (_member(given[0], key) if key else given[0]) if given else None
            return [("event", f"{kind} {role}", json.dumps(identity(said, constants)))] if said is not None else []

        yield from _matches(text, pattern, site)


def _messages(text: str, constants: dict) -> Iterator[Row]:
    """Messages between the parts of a browser extension: sent ones, and those that a listener tells apart."""
    api = r"\b(?:chrome|browser)\.(?:runtime|tabs)\."

    def sent(m):
        given = [a for a in _arguments(text, m.end()) if a.startswith("{")]
        said = next((v for a in given for v in [_member(a, "type") or _member(a, "action") or _member(a, "kind")] if v), None)
        return [("event", "chrome-message Produces", json.dumps(identity(said, constants)))] if said else []

    yield from _matches(text, api + r"sendMessage\s*\(", sent)
    for m in re.finditer(api + r"onMessage\.addListener\s*\(", text):
        body = text[m.end() : _until(text, m.end(), "")]
        at = _offsets(text)
        told = [*re.finditer(r"""\.(?:type|action|kind)\s*={2,3}\s*(["'`][^"'`]*["'`]|[\w$.]+)""", body)]
        if re.search(r"\bswitch\s*\([^)]*\.(?:type|action|kind)\s*\)", body):
            told += [*re.finditer(r"""\bcase\s+(["'`][^"'`]*["'`]|[\w$.]+)\s*:""", body)]
        for t in told:
            yield "event", "chrome-message Consumes", json.dumps(identity(t[1], constants)), at[m.end() + t.start()], at[m.end() + t.end()]


def _pulumi(text: str, bindings: dict) -> Iterator[Row]:
    """Resources that a program constructs, and which of them the arguments of others name."""
    clouds = {re.escape(n): m.removeprefix("@pulumi/") for n, (m, _) in bindings.items() if m.startswith("@pulumi/") and m != "@pulumi/pulumi"}
    if not clouds:
        return
    found, at = [], _offsets(text)
    for m in re.finditer(rf"(?:\b(?:const|let|var)\s+([\w$]+)\s*=\s*)?\bnew\s+({'|'.join(clouds)})\.((?:\w+\.)*)(\w+)\s*\(", text):
        given = _arguments(text, m.end())
        kind, name = identity(given[0]) if given else ("Computed", "")
        module = m[3].rstrip(".").replace(".", "/") or "index"
        token = f"{clouds[re.escape(m[2])]}:{module}/{m[4][0].lower() + m[4][1:]}:{m[4]}"
        if kind != "Literal":
            yield "gap", "computed resource name", token, at[m.start()], at[m.end()]
            continue
        yield "pulumi", name, token, at[m.start()], at[m.end()]
        found.append((m[1], name, " ".join(given[1:]), at[m.start()], at[m.end()]))
    for _, name, given, a, z in found:
        for other, target, *_ in found:
            if other and target != name and re.search(rf"(?<![\w$.]){re.escape(other)}\b", given):
                yield "references", name, target, a, z


def _typescript(text: str, depth: int = 0) -> Iterator[Row]:
    text = _blanked(text)
    bindings, constants = _bindings(text), _constants(text)
    yield from _matches(text, r"""^\s*import\s+(?:([\w*{}\s,$]+?)\s+from\s+)?["']([^"']+)["']""", lambda m: [("import", m[2], (m[1] or "").strip())])
    yield from _matches(text, r"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", lambda m: [("symbol", m[1], "function")])
    yield from _matches(text, r"\bclass\s+([A-Za-z_$][\w$]*)", lambda m: [("symbol", m[1], "class")])
    yield from _matches(text, r"\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>", lambda m: [("symbol", m[1], "arrow")])
    # routers: made by an imported factory, mounted below a path
    factories = [re.escape(n) for n, (m, _) in bindings.items() if m in ("express", "fastify")]
    made = _bound(text, rf"(?:{'|'.join(factories)})(?:\.Router)?\s*\(") if factories else []
    mounts = {m[2]: m[1].rstrip("/") for m in re.finditer(r"""\b[\w$]+\.use\s*\(\s*["']([^"']+)["']\s*,\s*([\w$]+)\s*\)""", text)}
    verbs = "|".join(HTTP) + "|all"
    for name in made:
        base = mounts.get(name.replace("\\", ""), "")
        yield from _matches(text, rf"""\b{name}\.({verbs})\s*\(\s*["']([^"']+)["']""", lambda m, base=base: [("endpoint", f"{m[1].upper()} {base}{m[2]}", _handler(text, m.end()))])
        for m in re.finditer(rf"""\b{name}\.route\s*\(\s*["']([^"']+)["']\s*\)""", text):  # one path, a chain of methods
            end, at = m.end(), _offsets(text)
            while n := re.compile(rf"\s*\.({verbs})\s*\(").match(text, end):
                end = _until(text, n.end(), "") + 1
                yield "endpoint", f"{n[1].upper()} {base}{m[1]}", (_arguments(text, n.end()) or [""])[-1], at[m.start()], at[min(end, len(text))]
    if any(m == "@nestjs/common" for m, _ in bindings.values()):
        classes = [(m.start(), (m[1] or "").strip("/")) for m in re.finditer(r"""@Controller\s*\(\s*(?:["']([^"']*)["'])?\s*\)""", text)]
        base_at = lambda i: next((b for at, b in reversed(classes) if at < i), None)
        join = lambda i, p: "/" + "/".join(x for x in (base_at(i), (p or "").strip("/")) if x)
        yield from _matches(text, r"""@(Get|Post|Put|Patch|Delete|Head|Options|All)\s*\(\s*(?:["']([^"']*)["'])?\s*\)\s*(?:@\w+\([^)]*\)\s*)*(?:public\s+|private\s+)?(?:async\s+)?([\w$]+)""", lambda m: [("endpoint", f"{m[1].upper()} {join(m.start(), m[2])}", m[3])] if base_at(m.start()) is not None else [])
    yield from _events(text, bindings, constants)
    yield from _messages(text, constants)
    yield from _pulumi(text, bindings)
    verb = lambda v: "GET" if v is None else identity(v, constants)[1].upper() if identity(v, constants)[0] == "Literal" else "?"

    def fetched(m):
        given = _arguments(text, m.end())
        return [("fetch", verb(_member(given[1], "method") if len(given) > 1 and given[1].startswith("{") else None if len(given) < 2 else "?"), json.dumps(identity(given[0], constants)))] if given else []

    if not re.search(r"\b(?:function|const|let|var|import)\s+\{?\s*fetch\b", text):
        yield from _matches(text, r"(?<![\w.$])fetch\s*\(", fetched)
    for name in [re.escape(n) for n, (m, _) in bindings.items() if m == "axios"]:
        yield from _matches(text, rf"(?<![\w.$]){name}\.({'|'.join(HTTP)})\s*\(", lambda m: [("fetch", m[1].upper(), json.dumps(identity(g[0], constants)))] if (g := _arguments(text, m.end())) else [])

        def asked(m):
            given = _arguments(text, m.end())
            url = _member(given[0], "url") if given and given[0].startswith("{") else given[0] if given else None
            how = _member(given[0], "method") if given and given[0].startswith("{") else _member(given[1], "method") if len(given) > 1 else None
            return [("fetch", verb(how), json.dumps(identity(url, constants)))] if url else []

        yield from _matches(text, rf"(?<![\w.$]){name}(?:\.request)?\s*\(", asked)
    yield from _matches(text, r"""<Route\s[^>]*?path\s*=\s*["']([^"']+)["'][^>]*?(?:element\s*=\s*\{\s*<\s*([\w$.]+)|component\s*=\s*\{\s*([\w$.]+))""", lambda m: [("screen", m[1], m[2] or m[3])])
    # what a component renders: capitalised tags after the nearest component's beginning
    owners = [(m.start(), m[1] or m[2] or m[3]) for m in re.finditer(r"\bfunction\s+([A-Z][\w$]*)|\bconst\s+([A-Z][\w$]*)\s*=|\bclass\s+([A-Z][\w$]*)", text)]
    owner = lambda i: next((n for at, n in reversed(owners) if at < i), None)
    yield from _matches(text, r"<([A-Z][\w$.]*)(?=[\s/>])", lambda m: [("renders", o, m[1])] if (o := owner(m.start())) and re.search(r"[(>\s&?:{]$", text[max(0, m.start() - 1) : m.start()] or " ") and m[1] != "Route" else [])
    yield from _matches(text, r"\.objectStore\s*\(\s*(\"[^\"]+\"|'[^']+')\s*\)\s*\.(get|getAll|getKey|getAllKeys|count|openCursor|openKeyCursor|put|add|delete|clear)\b", lambda m: [("data", m[1][1:-1], "WRITES" if m[2] in ("put", "add", "delete", "clear") else "READS")])
    # an object store held in a variable
    for m in re.finditer(r"""\b(?:const|let|var)\s+([\w$]+)\s*=\s*[^;\n]*?\.objectStore\s*\(\s*(["'])([^"']+)\2\s*\)\s*(?=[;\n])""", text):
        yield from _matches(text, rf"\b{re.escape(m[1])}\.(get|getAll|getKey|getAllKeys|count|openCursor|openKeyCursor|put|add|delete|clear)\s*\(", lambda c, store=m[3]: [("data", store, "WRITES" if c[1] in ("put", "add", "delete", "clear") else "READS")])
    yield from _matches(text, r"\beval\s*\(|\bnew\s+Function\s*\(|\bWebAssembly\.instantiate\b|\bexecuteScript\b|\bimport\s*\(\s*(?![\"'])", lambda m: [("dynamic", re.sub(r"\s|\(", "", m[0]), "")])
    # code in a literal is read too, and its facts say that they come from there
    for m in re.finditer(r"\b(eval|new\s+Function)\s*\(", text) if depth < 3 else ():
        kind, code = identity((_arguments(text, m.end()) or [""])[-1])
        if kind == "Literal":
            at = _offsets(text)
            for k, name, detail, _, _ in _typescript(code, depth + 1):
                yield k if k.startswith("eval:") else f"eval:{k}", name, detail, at[m.start()], at[m.end()]


def _go(text: str) -> Iterator[Row]:
    text = _blanked(text)
    yield from _matches(text, r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$', lambda m: [("import", m[1], "")])
    yield from _matches(text, r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", lambda m: [("symbol", m[1], "func")])
    yield from _matches(text, r"^type\s+(\w+)\s+(struct|interface)", lambda m: [("symbol", m[1], m[2])])
    if '"net/http"' in text:
        told = lambda p: m.groups() if (m := re.match(r"([A-Z]+) (/.*)", p)) else ("ANY", p)
        yield from _matches(text, r'\b\w+\.(?:HandleFunc|Handle)\s*\(\s*"([^"]+)"\s*,\s*([\w.]+)', lambda m: [("endpoint", " ".join(told(m[1])), m[2])])
    if "go-chi/chi" in text or "gin-gonic/gin" in text:
        # blocks below a path, and groups held in a variable
        blocks = [(m.end(), _until(text, m.end(), ""), m[1].rstrip("/")) for m in re.finditer(r'\b\w+\.Route\s*\(\s*"([^"]*)"\s*,\s*func\s*\([^)]*\)\s*\{', text)]
        groups: dict[str, str] = {}
        for m in re.finditer(r'\b(\w+)\s*:?=\s*(\w+)\.Group\s*\(\s*"([^"]*)"', text):
            groups[m[1]] = groups.get(m[2], "") + m[3].rstrip("/")
        base = lambda i, r: "".join(p for a, z, p in blocks if a <= i < z) + groups.get(r, "")
        yield from _matches(text, r'\b(\w+)\.(Get|Post|Put|Patch|Delete|Head|Options|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(\s*"([^"]*)"', lambda m: [("endpoint", f"{m[2].upper()} {base(m.start(), m[1])}{m[3]}", _handler(text, m.end()))])


def _go_read(path: str, text: str) -> bool:
    """False for a file that a build constraint, in it or in its name, ties to a platform."""
    parts = path.rpartition("/")[2].removesuffix(".go").split("_")[1:]
    return not (parts and (parts[-1] in GO_SYSTEMS or parts[-1] in GO_MACHINES)) and not re.search(r"^//go:build|^// \+build", text, re.M)


def _go_file(path: str, text: str) -> Iterator[Row]:
    """A Go file; one for a platform is passed over."""
    if _go_read(path, text):
        yield from _go(text)


def _jvm(text: str, function: str) -> Iterator[Row]:
    text = _blanked(text)
    package = re.search(r"^\s*package\s+([\w.]+)", text, re.M)
    yield from _matches(text, r"^\s*import\s+(?:static\s+)?([\w.*]+)", lambda m: [("import", m[1], "")])
    types = list(re.finditer(r"\b(class|interface|enum|object|record)\s+(\w+)", text))
    yield from _matches(text, r"\b(class|interface|enum|object|record)\s+(\w+)", lambda m: [("symbol", f"{package[1] + '.' if package else ''}{m[2]}", m[1])])
    if "org.springframework.web.bind.annotation" not in text or not types:
        return
    # each type's own mapping: the one between the end of what comes before it and the type itself
    bases = []
    for t in types:
        before = text[: t.start()]
        head = before[max(before.rfind("}"), before.rfind(";")) + 1 :]
        m = re.search(r"@RequestMapping\s*\(", head)
        bases.append((t.start(), (_paths(head, m.end()) or [None])[0] if m else ""))
    base_at = lambda i: next((b for at, b in reversed(bases) if at < i), "")

    def join(base: str, tail: str) -> str:
        """The base without slashes at its end, and the tail with those at its own kept."""
        base, tail = base.rstrip("/"), tail.lstrip("/")
        return f"{base}/{tail}" if tail or not base else base

    def mapped(m):
        base = base_at(m.start())
        given = _paths(text, m.end()) if m[0].endswith("(") else [""]
        after = _until(text, m.end(), "") + 1 if m[0].endswith("(") else m.end()
        name = re.compile(rf"[^@{{;]*?{function}|(?:\s*@\w+(?:\([^)]*\))?)*[^@{{;]*?{function}").match(text, after)
        handler = next((g for g in name.groups() if g), "") if name else ""
        if given is None or base is None:
            return [("gap", "computed path", f"{m[1].upper()} {handler}")]
        return [("endpoint", f"{m[1].upper()} {join(base, p)}", handler) for p in given]

    yield from _matches(text, r"@(Get|Post|Put|Patch|Delete)Mapping\b(?:\s*\()?", mapped)


def _paths(text: str, at: int) -> list[str] | None:
    """The literal paths of a mapping annotation whose bracket opens before `at`; null where one is computed."""
    told: list[str] = []
    for given in _arguments(text, at):
        m = re.match(r"(\w+)\s*=\s*(?!=)", given)
        if m and m[1] not in ("value", "path"):
            continue
        value = given[m.end() :] if m else given
        inner = re.fullmatch(r"\s*(?:arrayOf\s*\(|[\[{])(.*)[\])}]\s*", value, re.S)
        for item in _arguments(inner[1], 0) if inner else [value.strip()]:
            if not re.fullmatch(r'"[^"$]*"', item):
                return None
            told.append(item[1:-1])
    return told or [""]


def _hcl(text: str) -> Iterator[Row]:
    """Resources, data sources and modules at the top of a file.  A row of an attribute stands where its reference stands, the
    others where the block does; what `depends_on` names is no other reference."""
    at = _offsets(text)
    for block in hcl.parsed(text):
        if not isinstance(block, hcl.Block) or (block.kind, len(block.labels)) not in (("resource", 2), ("data", 2), ("module", 1)):
            continue
        own = ".".join(block.labels if block.kind == "resource" else [block.kind, *block.labels])
        where = at[block.start], at[block.end]
        told = list(block.attributes())
        source = next((a.value.literal or a.text for path, a in told if path == "source"), "") if block.kind == "module" else block.labels[0]
        yield block.kind, own, source, *where
        before = {r for path, a in told if path.split(".")[0] == "depends_on" for r, _, _ in a.value.refs}
        for r in sorted(before):
            yield "depends_on", own, r, *where
        for r in sorted({r for _, a in told for r, _, _ in a.value.refs} - before - {own}):
            yield "references", own, r, *where
        for path, a in told:
            first = {r: (at[start], at[end]) for r, start, end in reversed(a.value.refs)}
            for r in sorted(first.keys() - {own}):
                yield "attribute", own, f"{path} {r}", *first[r]
        for _, a in told:
            for action in a.value.actions:
                yield "action", own, action, *where


def _object(text: str) -> dict:
    try:
        doc = json.loads(text)
    except ValueError:
        return {}
    return doc if isinstance(doc, dict) else {}


def _manifest(text: str) -> Iterator[Row]:
    doc, end = _object(text), len(text.encode())
    if "manifest_version" not in doc:
        return
    yield "extension", doc.get("name", ""), str(doc["manifest_version"]), 0, end
    background = doc.get("background") or {}
    action = doc.get("action") or doc.get("browser_action") or doc.get("page_action") or {}
    options = doc.get("options_ui") or {}
    entries = [("background", e) for e in [background.get("service_worker"), background.get("page"), *background.get("scripts", [])]]
    entries += [("popup", action.get("default_popup")), ("options", options.get("page") or doc.get("options_page")), ("devtools", doc.get("devtools_page"))]
    entries += [(f"content:{k}", e) for k, script in enumerate(doc.get("content_scripts", [])) for e in script.get("js", [])]
    for context, entry in entries:
        if entry:
            yield "context", context, entry, 0, end
    for p in sorted(set(doc.get("permissions", [])) | set(doc.get("host_permissions", []))):
        yield "permission", p, "", 0, end
    for c in sorted(doc.get("commands", {})):
        yield "command", c, "", 0, end


def _tool(name: str, category: str, **settings) -> tuple[str, str]:
    return name, json.dumps({"category": category, **{k: v for k, v in settings.items() if v not in (None, "", [], {})}}, sort_keys=True)


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _package_json(text: str) -> Iterator[tuple[str, str]]:
    doc = _object(text)
    if isinstance(manager := doc.get("packageManager"), str):
        yield _tool(manager.partition("@")[0], "package manager", version=manager.partition("@")[2])
    for group in ("dependencies", "devDependencies"):
        for name, version in sorted((doc.get(group) or {}).items()):
            yield _tool(name, "dependency", version=str(version), dev=group != "dependencies" or None)
    if isinstance(doc.get("engines"), dict):
        for name, version in sorted(doc["engines"].items()):
            yield _tool(name, "runtime", version=str(version))


def _cargo(text: str) -> Iterator[tuple[str, str]]:
    doc = _toml(text)
    package = doc.get("package") or {}
    version = lambda v: v if isinstance(v, str) else v.get("version", "") if isinstance(v, dict) else ""
    yield _tool("cargo", "build", edition=package.get("edition"), rust=package.get("rust-version"), members=(doc.get("workspace") or {}).get("members"))
    for group in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, v in sorted((doc.get(group) or {}).items()):
            yield _tool(name, "dependency", version=version(v))


def _pyproject(text: str) -> Iterator[tuple[str, str]]:
    doc = _toml(text)
    project = doc.get("project") or {}
    yield _tool("python", "runtime", version=project.get("requires-python"))
    if backend := (doc.get("build-system") or {}).get("build-backend"):
        yield _tool(backend.partition(".")[0], "build")
    for d in sorted(project.get("dependencies") or []):
        m = re.match(r"([\w.-]+)\s*(?:\[[^\]]*\])?\s*(.*)", d)
        yield _tool(m[1], "dependency", version=m[2])
    for name, settings in sorted((doc.get("tool") or {}).items()):
        yield _tool(name, "tool", keys=sorted(settings) if isinstance(settings, dict) else None)


def _go_mod(text: str) -> Iterator[tuple[str, str]]:
    if m := re.search(r"^go\s+([\d.]+)", text, re.M):
        yield _tool("go", "runtime", version=m[1])
    for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)", text, re.M):
        yield _tool(m[1], "dependency", version=m[2])


def _dockerfile(text: str) -> Iterator[tuple[str, str]]:
    stages = set()
    for m in re.finditer(r"^FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", text, re.M | re.I):
        if m[1].lower() not in stages and not m[1].startswith("$"):
            image, _, tag = m[1].partition(":") if "@" not in m[1] else m[1].partition("@")
            yield _tool(image, "container", version=tag)
        stages.add((m[2] or "").lower())


def _compose(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"""^\s+image\s*:\s*["']?([^\s"'#:]+)(?::([^\s"'#]+))?""", text, re.M):
        yield _tool(m[1], "container", version=m[2])


def _workflow(text: str) -> Iterator[tuple[str, str]]:
    yield _tool("github-actions", "ci")
    for m in re.finditer(r"""^\s*-?\s*uses\s*:\s*["']?([\w./-]+)@([^\s"'#]+)""", text, re.M):
        yield _tool(m[1], "ci", version=m[2])


def _tsconfig(text: str) -> Iterator[tuple[str, str]]:
    from .observations import without_comments

    options = _object(without_comments(text)).get("compilerOptions") or {}
    yield _tool("typescript", "language", **{k: options.get(k) for k in ("target", "module", "strict", "jsx", "moduleResolution")})


def _env_names(text: str) -> Iterator[tuple[str, str]]:
    """Names only: values may be secrets, so no span points at them either."""
    for line in text.splitlines():
        if (m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", line)) and not line.lstrip().startswith("#"):
            yield _tool(m[1], "environment")


#: Lock files and the tools that write them.
LOCKFILES = {"package-lock.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "bun.lockb": "bun", "Cargo.lock": "cargo", "poetry.lock": "poetry", "uv.lock": "uv", "Pipfile.lock": "pipenv", "go.sum": "go", "Gemfile.lock": "bundler", "composer.lock": "composer"}
_BY_NAME = {"package.json": _package_json, "Cargo.toml": _cargo, "pyproject.toml": _pyproject, "go.mod": _go_mod}


def detector(path: str):
    """What reads the tools from a file of this path; null if nothing does."""
    name = path.rpartition("/")[2]
    if name in _BY_NAME:
        return _BY_NAME[name]
    if name in LOCKFILES:
        return lambda text: [_tool(LOCKFILES[name], "package manager")]
    if name == "Dockerfile" or name.startswith("Dockerfile."):
        return _dockerfile
    if re.fullmatch(r"(docker-)?compose(\.[\w-]+)?\.ya?ml", name):
        return _compose
    if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path):
        return _workflow
    if name in ("tsconfig.json", "jsconfig.json") or re.fullmatch(r"tsconfig\..+\.json", name):
        return _tsconfig
    if name == ".env" or name.startswith(".env."):
        return _env_names
    return None


_BY_SUFFIX = {
    ".py": ("python", lambda p, t: _python(t)),
    **{e: ("typescript", lambda p, t: _typescript(t)) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")},
    ".go": ("go", _go_file),
    ".java": ("java", lambda p, t: _jvm(t, r"(\w+)\s*\(")),
    ".kt": ("kotlin", lambda p, t: _jvm(t, r"fun\s+(\w+)\s*\(")),
    ".tf": ("hcl", lambda p, t: _hcl(t)),
}


def rows_of(path: str, text: str) -> list[tuple]:
    """Rows of one file; a file that does not parse yields a gap and nothing else."""
    name = path.rpartition("/")[2]
    if name == "manifest.json":
        language, run = "webextension", lambda p, t: _manifest(t)
    elif tools := detector(path):
        end = 0 if name.startswith(".env") else len(text.encode())
        language, run = "toolchain", lambda p, t: [("tool", n, d, 0, end) for n, d in tools(t)]
    else:
        language, run = _BY_SUFFIX.get("." + name.rpartition(".")[2], (None, None))
    if run is None:
        return []
    try:
        return [(path, language, *r) for r in run(path, text)]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, language, "gap", "unreadable", type(e).__name__, 0, len(text.encode()))]


def _framed(files: DataFrame, keys: list[str], make, columns: list[str], schema: str) -> DataFrame:
    """What `make` yields of path and text, with the keys of the file before each row; a frame of rows for a frame of files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*key, *r) for *key, path, text in zip(*[frame[k] for k in keys], frame["path"], frame["text"], strict=True) if text is not None for r in make(path, text)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(*keys, "path", "text").mapInPandas(run, schema)


def extracted(files: DataFrame) -> DataFrame:
    """Rows of all files (``path, text``; none of a null text)."""
    return _framed(files, [], rows_of, ["path", "language", "kind", "name", "detail", "byte_start", "byte_end"], SCHEMA)


#: Languages whose declarations and calls are read.
SCOPED = ("typescript", "python", "go", "java", "kotlin")
FACTS = "repo string, path string, language string, kind string, name string, detail string, owner string, byte_start long, byte_end long"


def _facts(path: str, text: str) -> list[tuple]:
    """Rows of a file and of its scopes; owner is the innermost declaration around a row, empty at file level."""
    rows = rows_of(path, text)
    language = _BY_SUFFIX.get("." + path.rpartition(".")[2], ("", None))[0]
    scoped: list[tuple] = []
    if language in SCOPED and not (language == "go" and not _go_read(path, text)):
        try:
            scoped = scope_rows(text, language)
        except (SyntaxError, ValueError, RecursionError):
            scoped = []  # rows_of has left a gap
    if language == "typescript" and scoped:  # a fetch that a parameter or variable shadows is none
        raw, called = text.encode(), {a for k, n, member, a, *_ in scoped if k == "calls" and (n, member) == ("fetch", "")}
        rows = [r for r in rows if r[2] != "fetch" or r[5] in called or raw[r[5] : r[5] + 5] != b"fetch"]
    spans = sorted((a, -z, n) for k, n, _, a, z, _ in scoped if k == "declares")

    def around(at: int) -> str:
        inner = [n for a, z, n in spans[: bisect.bisect_right(spans, (at, 1))] if -z > at]
        return inner[-1] if inner else ""

    out = [(path, lang, kind, name, detail, around(a), a, z) for path, lang, kind, name, detail, a, z in rows if (kind, lang) not in (("call", "python"), ("symbol", lang))]
    out += [(path, language, kind, name, detail, owner, a, z) for kind, name, detail, a, z, owner in scoped]
    if path.rpartition("/")[2] == "go.mod" and (m := re.search(r"^module\s+(\S+)", text, re.M)):
        out.append((path, "go", "module", m[1], "", "", m.start(), m.end()))
    return out


def facts(files: DataFrame) -> DataFrame:
    """FACTS of all files (``repo, path, text``): the extractors' rows with their owners, declarations, import scopes and calls."""
    columns = ["repo", "path", "language", "kind", "name", "detail", "owner", "byte_start", "byte_end"]
    return _framed(files, ["repo"], _facts, columns, FACTS)


def heard_messages(rows: DataFrame, repo: str = "repo") -> DataFrame:
    """Rows (of :func:`extracted`, with a repository column) without messages sent where no listener of the repository tells
    messages apart; everything else stays."""
    sent = (F.col("kind") == "event") & (F.col("name") == "chrome-message Produces")
    heard = rows.where("kind = 'event' and name = 'chrome-message Consumes'").select(repo).distinct().withColumn("_heard", F.lit(True))
    return rows.join(heard, repo, "left").where(~sent | F.col("_heard").isNotNull()).drop("_heard")


def page_screens(files: DataFrame) -> DataFrame:
    """``path, route`` of Next.js pages, by path only: ``pages/`` files, index dropped, ``[x]`` as ``:x``; no api, _app or _document."""
    route = F.regexp_extract("path", r"(?:^|/)pages/(.+)\.(?:tsx|jsx|ts|js)$", 1)
    clean = F.regexp_replace(F.regexp_replace(route, r"(^|/)index$", ""), r"\[(?:\.\.\.)?([^\]]+)\]", ":$1")
    return files.where((route != "") & ~route.rlike(r"^(api/|_)")).select("path", F.concat(F.lit("/"), clean).alias("route"))


def eval_findings(files: DataFrame) -> DataFrame:
    """``path, line, finding`` of lines that run code from text, with no parsing."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    marks = {"eval": r"\beval\(", "new Function": r"new Function\(", "wasm": r"WebAssembly\.instantiate", "executeScript": "executeScript", "computed import": r"\bimport\((?![\"'])"}
    each = F.array_compact(F.array(*[F.when(F.col("l").rlike(p), k) for k, p in marks.items()]))
    return lines.select("path", (F.col("p") + 1).alias("line"), F.explode(each).alias("finding"))
