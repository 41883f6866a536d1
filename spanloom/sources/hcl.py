"""A parser of HCL: blocks, attributes and expressions, and what they refer to by position in the syntax.

Only what facts need is kept of an expression: the addresses that its traversals name, its literal strings and the
literal actions of its objects.  Names inside plain strings and comments are none; those inside ``${ }`` and ``%{ }`` of strings
and heredocs are.  Names bound by ``for``, ``%{ for }`` or a dynamic block shadow addresses and are no references.  Text that
is no HCL raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: First names of traversals that never name a resource.
OWN = ("var", "local", "each", "count", "path", "terraform", "self")
ACTIONS = ("action", "actions")

_NAME = re.compile(r"[^\W\d][\w-]*")
_NUMBER = re.compile(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_BLANK = re.compile(r"(?:[ \t\r\f\ufeff]|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_BLANK_LINES = re.compile(r"(?:\s|\ufeff|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_OPERATOR = re.compile(r"==|!=|<=|>=|&&|\|\||[-+*/%<>]")
_HEREDOC = re.compile(r"<<-?([^\W\d][\w-]*)[ \t\r]*\n")
_FOR = re.compile(r"for(?=\s+[^\W\d][\w-]*\s*(?:,|\sin\b))")
#: Runs of a template without meaning of their own.
_PLAIN = {True: re.compile(r'(?:[^"\\$%\n]|\\.|\$\$\{|%%\{|[$%](?!\{))+'), False: re.compile(r"(?:[^$%]|\$\$\{|%%\{|[$%](?!\{))+")}


@dataclass
class Expression:
    """``refs`` are addresses with their first and last position; ``literal`` is the whole expression if it is one plain string."""

    refs: list[tuple[str, int, int]] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    literal: str | None = None

    def take(self, other: Expression) -> Expression:
        self.refs += other.refs
        self.strings += other.strings
        self.actions += other.actions
        return other


@dataclass
class Attribute:
    key: str
    value: Expression
    text: str


@dataclass
class Block:
    kind: str
    labels: list[str]
    body: list[Attribute | Block]
    start: int
    end: int

    def attributes(self) -> Iterator[tuple[str, Attribute]]:
        """Dotted path and attribute of all attributes within; the content of a dynamic block counts as a block of its label."""
        for item in self.body:
            if isinstance(item, Attribute):
                yield item.key, item
                continue
            name = item.labels[0] if item.kind == "dynamic" and item.labels else item.kind
            for path, attribute in item.attributes():
                inside = path.removeprefix("content.") if item.kind == "dynamic" else path
                yield f"{name}.{inside}", attribute


def address(root: str, names: list[str]) -> str | None:
    """The address that a traversal names by its first attributes, if it is one of a resource, data source or module."""
    if root in OWN:
        return None
    if root == "module":
        return f"module.{names[0]}" if names else None
    if root == "data":
        return f"data.{names[0]}.{names[1]}" if len(names) > 1 else None
    return f"{root}.{names[0]}" if "_" in root and names else None


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.lines, self.bound = text, 0, True, []

    # --- characters -------------------------------------------------------------------------------------
    def blank(self) -> None:
        self.at = (_BLANK_LINES if self.lines else _BLANK).match(self.text, self.at).end()

    def sees(self, *marks: str) -> bool:
        self.blank()
        return self.text.startswith(marks, self.at)

    def eat(self, mark: str) -> bool:
        found = self.sees(mark)
        if found:
            self.at += len(mark)
        return found

    def need(self, mark: str) -> None:
        if not self.eat(mark):
            raise ValueError(f"{mark!r} expected at {self.at}")

    def match(self, pattern: re.Pattern) -> re.Match | None:
        self.blank()
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def name(self) -> str:
        m = self.match(_NAME)
        if not m:
            raise ValueError(f"name expected at {self.at}")
        return m[0]

    def word(self, word: str) -> bool:
        return bool(self.match(re.compile(re.escape(word) + r"(?![\w-])")))

    def across(self, lines: bool, parse):
        """What `parse` gives while line ends are blanks, or are not."""
        self.lines, before = lines, self.lines
        try:
            return parse()
        finally:
            self.lines = before

    # --- structure --------------------------------------------------------------------------------------
    def body(self, close: str | None) -> list[Attribute | Block]:
        items: list[Attribute | Block] = []
        while True:
            self.blank()
            if close and self.eat(close):
                return items
            if self.at >= len(self.text):
                if close:
                    raise ValueError("block is not closed")
                return items
            items.append(self.item())

    def item(self) -> Attribute | Block:
        start, key = self.at, self.name()
        if self.sees("=") and not self.sees("=="):
            return self.attribute(key)
        labels = []
        while not self.eat("{"):
            label = self.across(False, self.quoted).literal if self.sees('"') else self.name()
            if label is None:
                raise ValueError(f"template in a label at {self.at}")
            labels.append(label)
        bound = [labels[0]] if key == "dynamic" and labels else []
        self.bound.append(bound)
        body = self.across(True, lambda: self.body("}"))
        self.bound.pop()
        return Block(key, labels, body, start, self.at)

    def attribute(self, key: str) -> Attribute:
        self.need("=")

        def line():
            self.blank()
            start = self.at
            value = self.expression()
            text = self.text[start : self.at]
            self.blank()
            if self.at < len(self.text) and self.text[self.at] not in "\n}":
                raise ValueError(f"line end expected at {self.at}")
            return Attribute(key, value, text)

        found = self.across(False, line)
        if key in ACTIONS:
            found.value.actions += found.value.strings
        if key == "iterator" and self.bound and self.bound[-1]:  # a dynamic block's own name for its element
            self.bound[-1][:] = [found.text.strip()]
        return found

    # --- expressions ------------------------------------------------------------------------------------
    def expression(self) -> Expression:
        first = self.operand()
        if not (self.sees("?") or self.operator_ahead()):
            return first
        out = Expression()
        out.take(first)
        while self.operator_ahead():
            self.match(_OPERATOR)
            out.take(self.operand())
        if self.eat("?"):
            out.take(self.expression())
            self.need(":")
            out.take(self.expression())
        return out

    def operator_ahead(self) -> bool:
        self.blank()
        return bool(_OPERATOR.match(self.text, self.at)) and not self.text.startswith(("=>", "<<"), self.at)

    def operand(self) -> Expression:
        while self.eat("-") or self.eat("!"):
            pass
        self.blank()
        start, root, names = self.at, None, []
        if self.sees('"'):
            out = self.across(False, self.quoted)
        elif m := self.match(_HEREDOC):
            out = self.heredoc(m[1])
        elif self.sees("("):
            out = self.bracket("(", ")", lambda: Expression(), self.expression)
        elif self.sees("["):
            out = self.tuple()
        elif self.sees("{"):
            out = self.object()
        elif self.match(_NUMBER):
            out = Expression()
        else:
            root, out = self.name(), Expression()
            while self.eat("::"):
                root = self.name()
            if self.sees("("):
                root, out = None, self.arguments()
        return self.trailed(out, start, root, names)

    def trailed(self, out: Expression, start: int, root: str | None, names: list[str]) -> Expression:
        """An operand with the attributes, indices and splats after it; names count up to the first index."""
        named, end = True, self.at
        while True:
            if self.sees(".") and not self.sees("..."):
                self.at += 1
                if self.eat("*") or self.match(re.compile(r"\d+")):
                    named = False
                else:
                    part = self.name()
                    names += [part] if named else []
            elif self.text.startswith("[", self.at):
                named, held = False, out
                out = Expression(list(held.refs), list(held.strings), list(held.actions))
                out.take(self.bracket("[", "]", Expression, lambda: Expression() if self.eat("*") else self.expression()))
            else:
                break
            out.literal, end = None, self.at
        found = address(root, names) if root and not any(root in names_ for names_ in self.bound) else None
        if found:
            out.refs.insert(0, (found, start, end))
        return out

    def bracket(self, opening: str, closing: str, empty, parse) -> Expression:
        self.need(opening)

        def inside():
            out = empty() if self.sees(closing) else parse()
            self.need(closing)
            return out

        return self.across(True, inside)

    def listed(self) -> Expression:
        out = Expression()
        while not self.sees(")", "]"):
            out.take(self.expression())
            self.eat("...")
            if not self.eat(","):
                break
        return out

    def arguments(self) -> Expression:
        return self.bracket("(", ")", Expression, self.listed)

    def tuple(self) -> Expression:
        return self.bracket("[", "]", Expression, lambda: self.loop() if self.match(_FOR) else self.listed())

    def loop(self) -> Expression:
        """After ``for``: names, collection and results, which alone see the names."""
        out, names = Expression(), [self.name()]
        if self.eat(","):
            names.append(self.name())
        self.need("in")
        out.take(self.expression())
        self.need(":")
        self.bound.append(names)
        out.take(self.expression())
        if self.eat("=>"):
            out.take(self.expression())
            self.eat("...")
        if self.word("if"):
            out.take(self.expression())
        self.bound.pop()
        return out

    def object(self) -> Expression:
        self.need("{")
        out = Expression()
        if self.across(True, lambda: self.match(_FOR)):
            out.take(self.across(True, self.loop))
            self.across(True, lambda: self.need("}"))
            return out
        while not self.across(True, lambda: self.eat("}")):
            self.across(False, lambda: self.member(out))
            self.across(False, lambda: self.eat(","))
        return out

    def member(self, out: Expression) -> None:
        start = self.at
        key = self.operand()
        told = key.literal if key.literal is not None else self.text[start : self.at].strip()
        out.refs += key.refs
        if not self.eat("=") and not self.eat(":"):
            raise ValueError(f"'=' expected at {self.at}")
        value = out.take(self.expression())
        if told.lower() in ACTIONS:
            out.actions += [x for x in value.strings if x not in value.actions]
        self.blank()
        if self.at < len(self.text) and self.text[self.at] not in ",}\n":
            raise ValueError(f"',' expected at {self.at}")

    # --- templates --------------------------------------------------------------------------------------
    def quoted(self) -> Expression:
        self.need('"')
        out = self.template('"', len(self.text))
        self.at += 1
        return out

    def heredoc(self, mark: str) -> Expression:
        closing = re.compile(rf"^[ \t]*{re.escape(mark)}[ \t\r]*$", re.M).search(self.text, self.at)
        if not closing:
            raise ValueError(f"heredoc {mark} is not closed")
        out = self.template("", closing.start())
        self.at = closing.end()
        return out

    def template(self, quote: str, end: int) -> Expression:
        out, plain, depth = Expression(), [], len(self.bound)
        whole = True
        while not (self.at == end if not quote else self.text.startswith(quote, self.at)):
            m = _PLAIN[bool(quote)].match(self.text, self.at, end)
            if m:
                plain.append(m[0])
                self.at = m.end()
            elif self.text.startswith(("${", "%{"), self.at) and self.at < end:
                directive, whole = self.text[self.at] == "%", False
                self.at += 2
                self.across(True, lambda directive=directive: self.directive(out, depth) if directive else self.interpolated(out))
            else:
                raise ValueError(f"string is not closed at {self.at}")
        if len(self.bound) > depth:
            raise ValueError("endfor is missing")
        if whole:
            out.literal = re.sub(r"\\(.)", r"\1", "".join(plain)) if quote else "".join(plain)
            out.strings.append(out.literal)
        return out

    def interpolated(self, out: Expression) -> None:
        self.eat("~")
        out.take(self.expression())
        self.eat("~")
        self.closed()

    def directive(self, out: Expression, depth: int) -> None:
        self.eat("~")
        if self.word("if"):
            out.take(self.expression())
        elif self.word("for"):
            names = [self.name()]
            if self.eat(","):
                names.append(self.name())
            self.need("in")
            out.take(self.expression())
            self.bound.append(names)
        elif self.word("endfor"):
            if len(self.bound) == depth:
                raise ValueError("endfor without for")
            self.bound.pop()
        elif not (self.word("else") or self.word("endif")):
            raise ValueError(f"unknown directive at {self.at}")
        self.eat("~")
        self.closed()

    def closed(self) -> None:
        self.need("}")


def parsed(text: str) -> list[Attribute | Block]:
    """The attributes and blocks of a file, in order."""
    return _Parser(text).body(None)
