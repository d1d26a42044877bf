"""Tokens of Java and Scala texts with 0-based positions; comments apart."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)
|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
|(?P<string>(?:[A-Za-z_]\w*)?\"\"\".*?(?:\"\"\"\"*|\Z)|(?:[A-Za-z_]\w*)?"(?:\\.|[^"\\\n])*"?)
|(?P<char>'(?:\\.[^'\n]*|[^'\\\n])')
|(?P<number>\d[\w]*(?:\.\d\w*)?)
|(?P<name>`[^`\n]*`|[^\W\d][\w$]*|\$[\w$]*)
|(?P<mark>[()\[\]{}.,;@])
|(?P<operator>[^\s\w()\[\]{}.,;@"'`]+|.)""",
    re.X | re.S,
)
#: Java's operators one by one, so that closing angle brackets stay apart.
_JAVA_TOKEN = re.compile(_TOKEN.pattern.rpartition("|(?P<operator>")[0] + r"|(?P<operator>->|::|&&|\|\||.)", re.X | re.S)

PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int
    char: int
    end_line: int
    end_char: int
    first: bool  # first token of its line

    @property
    def range(self) -> tuple[int, int, int, int]:
        return self.line, self.char, self.end_line, self.end_char


class Tokens:
    """tokens, the comments beside them, and for each opening bracket the index of its closing one."""

    def __init__(self, text: str, java: bool = False):
        self.tokens: list[Token] = []
        self.comments: list[Token] = []
        line = at_line = 0
        last = -1
        for m in (_JAVA_TOKEN if java else _TOKEN).finditer(text):
            kind, part, char = m.lastgroup, m[0], m.start() - at_line
            breaks = part.count("\n")
            end_line = line + breaks
            end_char = len(part) - part.rfind("\n") - 1 if breaks else char + len(part)
            if kind != "space":
                token = Token(kind, part, line, char, end_line, end_char, line != last)
                (self.comments if kind == "comment" else self.tokens).append(token)
                if kind != "comment":
                    last = end_line
            if breaks:
                line, at_line = end_line, m.start() + part.rfind("\n") + 1
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in PAIRS:
                stack.append(i)
            elif t.text in PAIRS.values():
                while stack and PAIRS[self.tokens[stack[-1]].text] != t.text:
                    self.close[stack.pop()] = i
                if stack:
                    self.close[stack.pop()] = i
        self.open_brackets = len(stack)
        for i in stack:
            self.close[i] = len(self.tokens)

    def __len__(self) -> int:
        return len(self.tokens)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def after(self, i: int) -> int:
        """The index after token i, or after the bracket that it opens."""
        return self.close[i] + 1 if i in self.close else i + 1

    def parts(self, begin: int, end: int, angles: bool = False) -> list[tuple[int, int]]:
        """(begin, end) of what commas part, outside brackets (and, for Java, angle brackets)."""
        out, at, i, depth = [], begin, begin, 0
        while i < end:
            if angles and self.text(i) in "<>" and self.text(i):
                depth += 1 if self.text(i) == "<" else -1
            if self.text(i) == "," and depth <= 0:
                out.append((at, i))
                at = i + 1
            i = self.after(i)
        return out + [(at, end)] if at < end else out


_IDENTIFIER = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")


def bare(name: str) -> str:
    return name[1:-1] if len(name) > 1 and name[0] == name[-1] == "`" else name


def escaped(name: str) -> str:
    """A name as it stands in a symbol."""
    name = bare(name)
    return name if _IDENTIFIER.fullmatch(name) else f"`{name}`"


class Definitions:
    """Rows of a file's definitions, with overload numbers in file order."""

    ZERO = (0, 0, 0, 0)

    def __init__(self):
        self.rows: list[tuple[str, str, bool, tuple[int, int, int, int]]] = []
        self.symbols: set[str] = set()
        self._counts: dict[tuple[str, str], int] = {}

    def add(self, symbol: str, name: str, at: tuple[int, int, int, int], is_type: bool = False) -> str:
        self.rows.append((symbol, bare(name), is_type, at))
        self.symbols.add(symbol)
        return symbol

    def type(self, owner: str, name: str, at) -> str:
        return self.add(f"{owner}{escaped(name)}#", name, at, True)

    def term(self, owner: str, name: str, at) -> str:
        return self.add(f"{owner}{escaped(name)}.", name, at)

    def method(self, owner: str, name: str, at) -> str:
        n = self._counts.get((owner, bare(name)), 0)
        self._counts[owner, bare(name)] = n + 1
        return self.add(f"{owner}{escaped(name)}({f'+{n}' if n else ''}).", name, at)

    def parameters(self, method: str, names: list[tuple[str, tuple]]) -> None:
        for name, at in names:
            self.add(f"{method}({escaped(name)})", name, at)

    def type_parameters(self, owner: str, names: list[tuple[str, tuple]]) -> None:
        for name, at in names:
            self.add(f"{owner}[{escaped(name)}]", name, at)
