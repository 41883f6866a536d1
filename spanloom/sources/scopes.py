"""Declarations, import scopes and call sites of source files, read from their tokens and block nesting.

A file becomes rows that Spark joins with those of all other files (see ``operators.ingest``):

* ``declares`` qualified name (``Class.method`` for members), detail: function, method or class; the span is that of the body;
* ``binds`` local name, detail: JSON of module and imported name (``*``: the module itself);
* ``calls`` root name, detail: member (empty for a plain call).  The root is a name of file scope: a function, a class, a
  module, or the type of the receiver where an annotation, a parameter, a property or a constructor call tells it.  A
  receiver without a known type, and a name that a parameter or local variable shadows, give no row.

Types are those that the text states; nothing is inferred from values other than ``new T(...)`` (in Kotlin ``T(...)``).
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

Row = tuple[str, str, str, int, int]

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>\"{3}.*?\"{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    |(?P<name>@?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)
    |(?P<mark>=>|\?\.|:=|->|[=!<>]=+|&&|\|\||.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Names before a bracket that are no calls.
_WORDS = frozenset("if for while switch catch return new else do super try import class".split())
_OWN_WORDS = {
    "typescript": frozenset("function typeof await throw in of instanceof constructor yield require delete void".split()),
    "go": frozenset("func go defer range select".split()),
    "java": frozenset("synchronized throw instanceof assert yield void".split()),
    "kotlin": frozenset("fun when throw in is constructor".split()),
}
_CLASSES = ("class", "interface", "object", "enum", "record", "struct")
#: What may stand before the end of a line, or begin the next, within one statement.
_GOES_ON = frozenset(". ? ?. : , ( [ = => := && || + - * / < & | ! extends implements throws -> <= >= ==".split())
_JOINS = frozenset("{ . ? ?. : ) ] => = && || + * / extends implements throws , -> == as".split())
_MODIFIERS = frozenset("private public protected readonly static final override async export default abstract declare val var internal lateinit open suspend const let mut data sealed".split())


class _Scope:
    def __init__(self, kind: str, name: str, begin: int, paren: int, until: str = "}"):
        self.kind, self.name, self.begin, self.paren, self.until = kind, name, begin, paren, until
        self.types: dict[str, str] = {}  # names declared here; '' without a known type


def tokens(text: str, language: str) -> list[tuple[str, str, int, int, bool]]:
    """Kind, text, span and whether a line ends before, without space and comments."""
    out, at, line = [], 0, True
    while at < len(text):
        m = None
        if text[at] == "/" and language == "typescript" and (not out or out[-1][1] in "(,=:[!&|?{};" or out[-1][1] in ("return", "=>", "&&", "||")):
            m = _REGEX.match(text, at)
        if m:
            out.append(("string", m[0], at, m.end(), line))
        else:
            m = _TOKEN.match(text, at)
            if m.lastgroup == "space":
                line = line or "\n" in m[0]
                at = m.end()
                continue
            out.append((m.lastgroup, m[0], at, m.end(), line))
        at, line = m.end(), False
    return out


def _closing(t: list, at: int, to: int | None = None) -> int:
    """Where the bracket at `at` closes."""
    depth = 0
    for i in range(at, to or len(t)):
        if t[i][0] == "mark":
            if t[i][1] in "([{":
                depth += 1
            elif t[i][1] in ")]}":
                depth -= 1
                if not depth:
                    return i
    return (to or len(t)) - 1


def _simple(part: list[str]) -> str:
    """A type that is one name, perhaps with arguments, a pointer or a mark that it may be null; else nothing."""
    text = re.sub(r"<.*>", "", "".join(part)).strip("*?&")
    return text if re.fullmatch(r"(?:[^\W\d]|\$)[\w$.]*", text) else ""


def _split(t: list, begin: int, end: int) -> Iterator[list[str]]:
    """The parts between commas of the tokens inside a bracket."""
    part, depth = [], 0
    for i in range(begin, end):
        x = t[i][1]
        if x == "," and not depth:
            yield part
            part = []
            continue
        depth += (x in "([{<" and t[i][0] == "mark") - (x in ")]}>" and t[i][0] == "mark")
        part.append(x)
    if part:
        yield part


def _parameters(t: list, begin: int, end: int, language: str) -> list[tuple[str, str, bool]]:
    """Name, type and whether it is a property as well, of the parameters inside a bracket."""
    out, waiting = [], []
    for part in _split(t, begin, end):
        words = [w for w in part if not w.startswith("@")]
        kept = bool(_MODIFIERS & {"private", "public", "protected", "readonly", "val", "var"} & set(words))
        words = [w for w in words if w not in _MODIFIERS and w != "..."]
        if not words or words[0] in "{[":
            out += [(w, "", False) for w in words if re.fullmatch(r"(?:[^\W\d]|\$)[\w$]*", w)]
            continue
        if language in ("typescript", "kotlin"):
            stop = words.index("=") if "=" in words else len(words)
            colon = words.index(":") if ":" in words[:stop] else stop
            out.append((words[0], _simple(words[colon + 1 : stop]), kept))
        elif language == "java":
            out.append((words[-1], _simple(words[:-1]), False))
        else:  # Go: one type may follow several names
            waiting.append(words[0])
            if len(words) > 1:
                out += [(w, _simple(words[1:]), False) for w in waiting]
                waiting = []
    return out + [(w, "", False) for w in waiting]


class _Reader:
    """One pass over the tokens of a file in a language with braces."""

    def __init__(self, text: str, language: str):
        self.t, self.language, self.words = tokens(text, language), language, _WORDS | _OWN_WORDS[language]
        self.rows: list[tuple] = []
        self.scopes = [_Scope("file", "", 0, 0)]
        self.properties: dict[tuple[str, str], str] = {}
        self.pending: list[tuple] = []
        self.head = 0  # where the statement begins
        self.paren = 0

    def owner(self) -> str:
        return next((s.name for s in reversed(self.scopes) if s.kind == "function" and s.name), "")

    def inside(self) -> str:
        return next((s.name for s in reversed(self.scopes) if s.kind == "class"), "")

    def open(self, kind: str, name: str, at: int, until: str = "}") -> _Scope:
        self.scopes.append(_Scope(kind, name, self.t[self.head][2] if self.head < len(self.t) else self.t[at][2], self.paren, until))
        if name:
            self.rows.append(["declares", name, "class" if kind == "class" else "method" if "." in name else "function", self.scopes[-1].begin, 0])
            self.scopes[-1].row = self.rows[-1]
        return self.scopes[-1]

    def close(self, end: int) -> None:
        scope = self.scopes.pop()
        if scope.name:
            scope.row[4] = end

    def opened(self, at: int) -> None:
        """A brace or an arrow at `at`: what it is the body of."""
        t, head = self.t, self.head
        words = [t[i][1] for i in range(head, at)]
        top = self.scopes[-1]
        member = top.kind == "class"
        # a class
        for i in range(head, at):
            if t[i][1] in _CLASSES and t[i][0] == "name" and (i + 1 < at and t[i + 1][0] == "name" or self.language == "go") and (i == head or t[i - 1][1] not in (".", "(", "=", ":")):
                name = t[i - 1][1] if self.language == "go" else t[i + 1][1]
                scope = self.open("class", name, at)
                if self.language == "kotlin" and i + 2 < at and t[i + 2][1] == "(":
                    for p, kind, kept in _parameters(t, i + 3, _closing(t, i + 2, at), "kotlin"):
                        if kept:
                            self.properties[scope.name, p] = kind
                return
        keyword = {"go": "func", "kotlin": "fun"}.get(self.language, "function")
        if keyword in words:
            i = head + words.index(keyword) + 1
            receiver = None
            if self.language == "go" and i < at and t[i][1] == "(" and head + words.index(keyword) == head:  # a method
                end = _closing(t, i, at)
                receiver, i = _parameters(t, i + 1, end, "go"), end + 1
            while i < at and t[i][1] in ("*", "<"):
                i = _closing_angle(t, i, at) + 1 if t[i][1] == "<" else i + 1
            name = ""
            if i < at and t[i][0] == "name":
                name, i = t[i][1], i + 1
                if self.language == "kotlin" and i + 1 < at and t[i][1] == ".":  # an extension
                    name, i = f"{name}.{t[i + 1][1]}", i + 2
            if receiver:
                name = f"{receiver[0][1] or '?'}.{name}"
            elif member and name:
                name = f"{top.name}.{name}"
            self.function(name, at, i, receiver)
            return
        if self.language in ("typescript", "kotlin") and (t[at][1] == "=>" or at > head and t[at - 1][1] == "=>"):
            arrow = at if t[at][1] == "=>" else at - 1
            m = next((k for k in range(head, arrow) if t[k][1] == "="), None)
            name, k = "", arrow
            if m is not None and m > head:
                k = m + 2 if t[m + 1][1] == "async" else m + 1
                whole = k < arrow and (t[k][1] == "(" and _plain_type(t, _closing(t, k, arrow) + 1, arrow) or t[k][0] == "name" and k + 1 == arrow)
                names = [t[i][1] for i in range(head, m) if t[i][0] == "name" and t[i][1] not in _MODIFIERS]
                if whole and names:
                    name = f"{top.name}.{names[0]}" if member else names[0]
            if not name:  # a function without a name: its parameters begin at the last bracket before the arrow
                k = arrow - 1
                if t[k][1] == ")":
                    depth = 0
                    while k >= 0:
                        depth += (t[k][1] == ")") - (t[k][1] == "(")
                        if not depth:
                            break
                        k -= 1
            self.function(name, at, k, None)
            return
        if member and self.language in ("typescript", "java") and "(" in words and "=" not in words[: words.index("(")]:
            i = head + words.index("(")
            while i < at and t[i - 1][0] == "name" and t[i - 1][1].startswith("@"):  # past annotations
                i = next((k for k in range(_closing(t, i, at) + 1, at) if t[k][1] == "("), at)
            if i < at and t[i - 1][0] == "name":
                self.function(f"{top.name}.{t[i - 1][1]}", at, i, None)
                return
        self.open("block", "", at)

    def function(self, name: str, at: int, bracket: int, receiver: list | None) -> None:
        scope = self.open("function", name, at, "}" if self.t[at][1] == "{" else ";")
        for p, kind, _ in receiver or ():
            scope.types[p] = kind
        if bracket < at and self.t[bracket][1] == "(":
            for p, kind, kept in _parameters(self.t, bracket + 1, _closing(self.t, bracket, at), self.language):
                scope.types[p] = kind
                if kept and name.endswith(".constructor"):
                    self.properties[self.inside(), p] = kind
        elif bracket < at and self.t[bracket][0] == "name":
            scope.types[self.t[bracket][1]] = ""

    def declared(self, i: int) -> None:
        """A variable or property whose declaration begins at token i."""
        t, n, language = self.t, len(self.t), self.language
        scope = self.scopes[-1]
        word = lambda k: t[k][1] if k < n else ""
        name, kind = "", ""
        if language in ("typescript", "kotlin") and word(i) in ("const", "let", "var", "val"):
            if word(i + 1) in ("{", "[", "("):
                scope.types |= {t[k][1]: "" for k in range(i + 2, _closing(t, i + 1)) if t[k][0] == "name" and word(k + 1) != ":"} if scope.kind != "file" else {}
                return
            name, k = word(i + 1), i + 2
        elif language == "go" and word(i) == "var":
            name, k = word(i + 1), i + 2
            kind = _simple([x for x in (word(k), word(k + 1), word(k + 2), word(k + 3)) if x in "*." or re.fullmatch(r"\w+", x)][: 4 if word(k) == "*" else 3]) if word(k) != "=" else ""
            scope.types[name] = kind if scope.kind != "file" or kind else scope.types.get(name, "")
            return
        elif language == "go" and t[i][0] == "name" and word(i + 1) in (":=", ","):
            k = i
            while t[k][0] == "name" and word(k + 1) == ",":
                scope.types[t[k][1]] = ""
                k += 2
            if k < n and word(k + 1) == ":=":
                kind = word(k + 3) if word(k + 2) == "&" and word(k + 4) == "{" else word(k + 2) if word(k + 3) == "{" and t[k + 2][0] == "name" else ""
                scope.types[t[k][1]] = kind
            return
        elif language == "typescript" and scope.kind == "class" and t[i][0] == "name":
            k = i
            while word(k) in _MODIFIERS:
                k += 1
            name, k = word(k), k + 1
            if word(k) not in (":", "=", "?", "!"):
                return
            k += word(k) in ("?", "!")
        elif language == "java":
            k = i
            while word(k) in _MODIFIERS and word(k) != "var" or word(k).startswith("@"):
                k = _closing(t, k + 1) + 1 if word(k).startswith("@") and word(k + 1) == "(" else k + 1
            begin = k
            while k < n and (t[k][0] == "name" or word(k) in (".", "<", ">", ",", "?", "[", "]")) and not (t[k][0] == "name" and word(k + 1) in ("=", ";", ":")):
                k += 1
            if k == begin or k >= n or t[k][0] != "name" or word(begin) in self.words:
                return
            name, kind = word(k), _simple([t[x][1] for x in range(begin, k)])
            if kind == "var":
                kind = word(k + 3) if word(k + 1) == "=" and word(k + 2) == "new" else ""
        if not name or not re.fullmatch(r"(?:[^\W\d]|\$)[\w$]*", name):
            return
        if language != "java":
            if word(k) == ":":
                stop = k + 1
                while stop < n and word(stop) not in ("=", ";", ",", ")", "}") and not (t[stop][4] and stop > k + 1):
                    stop += 1
                kind, k = _simple([t[x][1] for x in range(k + 1, stop)]), stop
            if not kind and word(k) == "=":
                k += 1 + (word(k + 1) == "await")
                made = word(k + 1) if language == "typescript" and word(k) == "new" else word(k) if language == "kotlin" and word(k)[:1].isupper() and word(k + 1) == "(" else ""
                kind = made if re.fullmatch(r"(?:[^\W\d]|\$)[\w$]*", made) else ""
                if word(k) == "(" or word(k) in ("async", "function") or word(k + 1) == "=>":  # a function bound to a name of file scope stays one
                    if scope.kind == "file":
                        return
        if scope.kind == "class":
            self.properties[scope.name, name] = kind
        elif scope.kind != "file" or kind:
            scope.types[name] = kind

    def called(self, at: int) -> None:
        """A bracket at `at` after a name."""
        t, i = self.t, at - 1
        if t[i][0] != "name" or t[i][1] in self.words or t[i][1].startswith("@"):
            return
        chain = [t[i][1]]
        while i >= 2 and t[i - 1][1] in (".", "?.") and t[i - 2][0] == "name":
            i -= 2
            chain.insert(0, t[i][1])
        before = t[i - 1][1] if i else ""
        if before in (".", "?.", "new", "function", "fun", "func", "class", "interface", "record", "object", "->") or chain[0].startswith("@") or before == ")" and self.language == "go" and t[self.head][1] == "func":
            return
        if self.language == "go" and t[self.head][1] == "func" and self.scopes[-1].kind == "file":
            return
        top = self.scopes[-1]
        if top.kind == "class" and not any(t[k][1] == "=" for k in range(self.head, at)):
            return
        if self.language == "kotlin" and any(t[k][1] == "fun" for k in range(self.head, at)) and not any(t[k][1] == "=" for k in range(self.head, at)):
            return
        jvm = self.language in ("java", "kotlin")
        find = lambda x: next((s.types[x] for s in reversed(self.scopes) if x in s.types), None)
        owner, mine = self.owner(), self.inside()
        span = (t[i][2], t[at][3])
        if chain[0] == "this":
            if len(chain) == 2 and mine:
                self.pending.append((mine, chain[1], None, owner, *span))
            elif len(chain) == 3:
                self.pending.append((None, chain[2], (mine, chain[1]), owner, *span))
        elif len(chain) == 1:
            if find(chain[0]) is None:
                self.pending.append((mine, chain[0], None, owner, *span) if jvm and mine else (chain[0], "", None, owner, *span))
        elif len(chain) == 2:
            kind = find(chain[0])
            if kind:
                self.pending.append((kind, chain[1], None, owner, *span))
            elif kind is None:
                self.pending.append((chain[0], chain[1], (mine, chain[0]) if jvm and mine else None, owner, *span))

    def read(self) -> list[tuple]:
        t = self.t
        i = 0
        while i < len(t):
            kind, x, begin, end, line = t[i]
            top = self.scopes[-1]
            fresh = i == self.head
            if i and line and self.paren == top.paren and x not in _JOINS and t[i - 1][1] not in _GOES_ON:
                if top.until == ";":
                    self.close(t[i - 1][3])
                self.head, fresh = i, True
            if fresh and (kind == "name"):
                j = i
                while j < len(t) and t[j][1] in ("export", "private", "public", "protected", "readonly", "static", "final", "override", "lateinit", "internal") and self.language != "java":
                    j += 1
                if not (self.language == "typescript" and self.scopes[-1].kind == "class"):
                    self.declared(j)
                else:
                    self.declared(i)
            elif kind == "name" and x in ("const", "let") and self.language == "typescript":  # in the head of a loop
                self.declared(i)
            if kind == "mark":
                if x == "(":
                    self.called(i)
                    self.paren += 1
                    if self.language == "java" and i and t[i - 1][1] in ("for", "try"):
                        self.declared(i + 1)
                elif x == "[":
                    self.paren += 1
                elif x in ")]":
                    if top.until == ";" and self.paren == top.paren:
                        self.close(begin)
                    self.paren -= 1
                elif x == "{":
                    self.opened(i)
                    self.head = i + 1
                elif x == "}":
                    while len(self.scopes) > 1 and self.scopes[-1].until == ";":
                        self.close(begin)
                    if len(self.scopes) > 1:
                        self.paren = self.scopes[-1].paren
                        self.close(end)
                    self.head = i + 1
                elif x in ";," and top.until == ";" and self.paren == top.paren:
                    self.close(begin)
                    self.head = i + 1
                elif x == ";" and self.paren == top.paren:
                    self.head = i + 1
                elif x == "=>" and self.language == "typescript" and i + 1 < len(t) and t[i + 1][1] != "{":
                    self.opened(i)
                elif x == "=" and self.language == "kotlin" and self.paren == top.paren and any(t[k][1] == "fun" for k in range(self.head, i)):
                    self.opened(i)
                    self.scopes[-1].until = ";"
                elif x == "->" and self.language in ("java", "kotlin") and i and t[i - 1][0] == "name" and self.scopes[-1].kind != "file":
                    self.scopes[-1].types.setdefault(t[i - 1][1], "")
            i += 1
        while len(self.scopes) > 1:
            self.close(t[-1][3])
        rows = [tuple(r) for r in self.rows]
        for root, member, of, owner, a, z in self.pending:
            if of is not None and of in self.properties:
                root = self.properties[of]
            if root:
                rows.append(("calls", root, member, a, z, owner))
        return rows


def _closing_angle(t: list, at: int, to: int) -> int:
    depth = 0
    for i in range(at, to):
        depth += (t[i][1] == "<") - (t[i][1] == ">")
        if not depth:
            return i
    return to - 1


def _plain_type(t: list, at: int, to: int) -> bool:
    """Nothing, or a result type, stands between."""
    return at == to or t[at][1] == ":"


def _import_rows(text: str, language: str) -> Iterator[tuple[str, str, str]]:
    """Local name, module, imported name."""
    from .extractors import _bindings, _blanked

    plain = _blanked(text)
    if language == "typescript":
        for name, (module, imported) in _bindings(plain).items():
            # a default import is bound like the module: the export under that name is looked for
            default = imported == "*" and re.search(rf"\bimport\s+(?:type\s+)?{re.escape(name)}\b", plain)
            yield name, module, name if default else imported
    elif language == "go":
        for m in re.finditer(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([\w./-]+)"\s*$', plain, re.M):
            yield m[1] or m[2].rpartition("/")[2], m[2], "*"
    else:
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+)(?:\s+as\s+(\w+))?\s*;?\s*$", plain, re.M):
            yield m[3] or m[2], m[1], m[2]


def _python_scopes(text: str) -> Iterator[tuple]:
    tree = ast.parse(text)
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    span = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)
    function = ast.FunctionDef | ast.AsyncFunctionDef

    def visit(node, inside: str, owner: str, local: set) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield ("declares", child.name, "class", *span(child))
                yield from visit(child, child.name, owner, local)
            elif isinstance(child, function):
                name = f"{inside}.{child.name}" if inside and isinstance(node, ast.ClassDef) else child.name
                yield ("declares", name, "method" if "." in name else "function", *span(child))
                args = child.args
                bound = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if a}
                bound |= {n.id for n in ast.walk(child) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
                yield from visit(child, inside, name, local | bound)
            else:
                if isinstance(child, ast.Import):
                    for a in child.names:
                        yield ("binds", a.asname or a.name.partition(".")[0], json.dumps([a.name, "*"]), *span(child))
                elif isinstance(child, ast.ImportFrom):
                    for a in child.names:
                        yield ("binds", a.asname or a.name, json.dumps(["." * child.level + (child.module or ""), a.name]), *span(child))
                elif isinstance(child, ast.Call):
                    f = child.func
                    if isinstance(f, ast.Name) and f.id not in local:
                        yield ("calls", f.id, "", *span(child), owner)
                    elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                        if f.value.id == "self" and inside:
                            yield ("calls", inside, f.attr, *span(child), owner)
                        elif f.value.id not in local:
                            yield ("calls", f.value.id, f.attr, *span(child), owner)
                yield from visit(child, inside, owner, local)

    yield from visit(tree, "", "", set())


def scope_rows(text: str, language: str) -> list[tuple]:
    """``(kind, name, detail, start, end, owner)`` with byte offsets; owner is the function or method around a call."""
    if language == "python":
        return [(*r, "") if len(r) == 5 else r for r in _python_scopes(text)]
    found = _Reader(text, language).read()
    if not text.isascii():
        ends = [0]
        for c in text:
            ends.append(ends[-1] + len(c.encode()))
        found = [(k, n, d, ends[a], ends[z], *rest) for k, n, d, a, z, *rest in found]
    rows = [(*r, "") if len(r) == 5 else r for r in found]
    imports = list(_import_rows(text, language))
    if language in ("java", "kotlin"):  # a plain call of an imported function, unless the class has one of its name
        known, own = {n for n, _, _ in imports}, {n for k, n, *_ in rows if k == "declares"}
        rows = [("calls", r[2], "", *r[3:]) if r[0] == "calls" and r[2] in known and f"{r[1]}.{r[2]}" not in own else r for r in rows]
    rows += [("binds", name, json.dumps([module, imported]), 0, 0, "") for name, module, imported in imports]
    if language in ("java", "kotlin") and (m := re.search(r"^\s*package\s+([\w.]+)", text, re.M)):
        rows.append(("package", m[1], "", 0, 0, ""))
    return rows
