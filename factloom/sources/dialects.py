"""Which dialect a Scala text is written in, and where it breaks each one's rules.

A text is checked statement by statement against the rules of a dialect; after an error the check
goes on with the next statement, so all are found. Dialects come in a fixed order by the kind of
file; the first without an error is the text's, else the first errors of all are joined.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from . import scala
from .blocks import indented
from .lexer import PAIRS, Tokens


@dataclass(frozen=True)
class Dialect:
    name: str
    three: bool  # words and indented bodies of version 3; without, what it has dropped
    top_statements: bool
    top_terms: bool


SCALA3 = Dialect("scala3", True, True, False)
SCALA3_BUILD = Dialect("scala3", True, True, True)
SBT1 = Dialect("sbt1", False, True, True)
SCALA2 = Dialect("scala2", False, False, False)

#: Statements that stand at the top of a text in every dialect.
TOP = frozenset("package import class trait object".split())
NEW_WORDS = frozenset("enum given extension export".split())
NEEDS_NAME = frozenset("def val var class trait object type enum".split())
_OPENING = {close: opening for opening, close in PAIRS.items()}


def order(file_name: str) -> tuple[Dialect, ...]:
    return (SCALA3_BUILD, SBT1, SCALA2) if file_name.endswith(".sbt") else (SCALA3, SCALA2)


class Check:
    """errors: (line, column, message), from 1, in the order of the text."""

    def __init__(self, text: str, dialect: Dialect, file_name: str = "X.scala"):
        self.dialect = dialect
        self.shape = scala.Scala(text, file_name)
        self.t = self.shape.t
        self.indents = indented(self.t)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(self.t) + 1000))  # brackets may nest as deep as a text is long
        self.entered: set[int] = set()
        self.found: list[tuple[int, int, str]] = []
        self._brackets()
        self._texts()
        if not self.found:  # statements are known only where brackets match
            self._statements(0, len(self.t), top=True)
        self.errors = sorted(set(self.found))

    def _fail(self, i: int, message: str) -> None:
        if i < len(self.t):
            token = self.t.tokens[i]
            self.found.append((token.line + 1, token.char + 1, message))
        elif len(self.t):
            token = self.t.tokens[-1]
            self.found.append((token.end_line + 1, token.end_char + 1, message))

    def _seen(self, i: int) -> str:
        return f"{self.t.text(i)} found" if i < len(self.t) else "end of file found"

    def _brackets(self) -> None:
        stack: list[int] = []
        for i, token in enumerate(self.t.tokens):
            if token.kind != "mark":
                continue
            if token.text in PAIRS:
                stack.append(i)
            elif token.text in _OPENING:
                if stack and self.t.text(stack[-1]) == _OPENING[token.text]:
                    stack.pop()
                else:
                    self._fail(i, f"unexpected {token.text}")
                    return
        for i in stack:
            self._fail(i, f"{self.t.text(i)} is not closed")

    def _texts(self) -> None:
        for i, token in enumerate(self.t.tokens):
            if token.kind == "string":
                body = token.text[token.text.index('"') :]
                ends = '"""' if body.startswith('"""') else '"'
                if len(body) < 2 * len(ends) or not body.endswith(ends):
                    self._fail(i, "unclosed string")
        for token in self.t.comments:
            if token.text.startswith("/*") and not (len(token.text) > 3 and token.text.endswith("*/")):
                self.found.append((token.line + 1, token.char + 1, "unclosed comment"))

    def _statements(self, i: int, end: int, top: bool = False) -> None:
        t = self.t
        while i < end:
            if t.text(i) in (";", "}", ")", "]"):
                i += 1
                continue
            stop = max(self.shape._end(i + 1, end, i), i + 1)
            self._statement(i, min(stop, end), top)
            i = stop

    def _statement(self, start: int, end: int, top: bool) -> None:
        t, i = self.t, start
        while i < end and (t.text(i) in scala.MODIFIERS or t.text(i) == "@" or t.text(i) == "case" and t.text(i + 1) in ("class", "object")):
            if t.text(i) == "@":
                i += 2
                while t.text(i) in (".", "(", "[") and i < end:
                    i = i + 2 if t.text(i) == "." else t.after(i)
            else:
                i += 1
                i = t.after(i) if t.text(i) == "[" else i
        word = t.text(i)
        definition = word in scala.STARTS and not (word in NEW_WORDS | {"type"} and not (t.is_name(i + 1) or t.text(i + 1) in ("(", "[")))
        if top and not self.dialect.top_terms and not definition:
            self._fail(i, f"expected a definition, {self._seen(i)}")
            return
        if top and not self.dialect.top_statements and definition and word not in TOP and not (word in NEW_WORDS):
            self._fail(i, "expected class or object definition")
            return
        if definition and word in NEW_WORDS and not self.dialect.three:
            self._fail(i, f"{word} is no statement of this dialect")
            return
        if definition and word == "package" and t.text(i + 1) != "object":
            self._package(i, end)
            return
        if definition and word in NEEDS_NAME and not self._named(i, word):
            return
        if definition and word == "def" and not self._method(i, end):
            return
        if definition and word in ("val", "var") and not any(t.text(k) in ("=", ":") for k in range(i + 1, end)):
            self._fail(end, f"= expected, {self._seen(end)}")
            return
        self._inside(i, end)

    def _named(self, i: int, word: str) -> bool:
        t, k = self.t, i + 1
        pattern = word in ("val", "var") and (t.text(k) in ("(", "_") or k < len(t) and t.tokens[k].kind in ("number", "string", "char"))
        name = t.is_name(k) and (t.text(k) not in scala.STARTS | scala.GOES_ON or word == "type") or word == "def" and (t.text(k) == "this" or k < len(t) and t.tokens[k].kind == "operator" and t.text(k) not in ("=", ":", "=>", "<-"))
        if not (name or pattern):
            self._fail(k, f"identifier expected, {self._seen(k)}")
        return name or pattern

    def _method(self, i: int, end: int) -> bool:
        t, k = self.t, i + 2
        k = t.after(k) if t.text(k) == "[" else k
        while t.text(k) == "(" and k < end:
            for a, b in t.parts(k + 1, t.close[k]):
                while a < b and (t.text(a) in scala.PARAMETER_WORDS or t.text(a) == "@") and t.text(a + 1) != ":":
                    a += 2 if t.text(a) == "@" else 1
                if self.dialect.three and t.text(k + 1) == "using":
                    continue  # types alone may stand there
                if not (t.is_name(a) and t.text(a + 1) == ":"):
                    self._fail(a + 1, f": expected, {self._seen(a + 1)}")
                    return False
            k = t.after(k)
        if t.text(k) == "{" and k < end and self.dialect.three:
            self._fail(k, "= expected before the body of a method")
            return False
        return True

    def _package(self, i: int, end: int) -> None:
        t, k = self.t, i + 1
        while t.is_name(k) and t.text(k + 1) == ".":
            k += 2
        if not t.is_name(k):
            self._fail(k, f"identifier expected, {self._seen(k)}")
        elif t.text(k + 1) == "{":
            self._statements(k + 2, t.close[k + 1], top=True)

    def _inside(self, i: int, end: int) -> None:
        """Words and bodies of a statement, outside of statements nested in it, which are checked by themselves."""
        t, k = self.t, i
        while k < end:
            text, before = t.text(k), t.text(k - 1)
            if t.tokens[k].kind == "name" and before != ".":
                if text == "then" and not self.dialect.three or text == "forSome" and self.dialect.three:
                    self._fail(k, f"unexpected {text}")
                elif text == "do" and self.dialect.three and self._loops_back(k, end):
                    self._fail(k, "do and while is no loop of this dialect")
                elif text in ("import", "extends", "new") and not (t.is_name(k + 1) or t.text(k + 1) in ("(", "{")):
                    self._fail(k + 1, f"identifier expected, {self._seen(k + 1)}")
                elif text == "if" and (k + 1 >= end or t.text(k + 1) in (")", "}", ";", "else", "then")):
                    self._fail(k + 1, f"expression expected, {self._seen(k + 1)}")
            body = k in self.indents and k not in self.entered
            if body and before == ":" and not self.dialect.three:
                self._fail(k - 1, "indented body in this dialect")
                return
            if text in ("=", "=>", "<-", ".", ",") and t.tokens[k].kind in ("operator", "mark") and (k + 1 >= len(t) or t.text(k + 1) in ("}", "]", ")")) and not (text in ("=>", ",") and k + 1 < len(t)):
                self._fail(k + 1, f"expression expected, {self._seen(k + 1)}")
            if body:
                self.entered.add(k)
                stop = min(self.indents[k], end)
                self._statements(k, stop)
                k = max(stop, k + 1)
            elif text == "{":
                self._statements(k + 1, min(t.close[k], end))
                k = t.after(k)
            elif text in ("(", "["):
                self._inside(k + 1, min(t.close[k], end))
                k = t.after(k)
            else:
                k += 1

    def _loops_back(self, k: int, end: int) -> bool:
        """Whether a do begins a loop, with its condition behind it."""
        t = self.t
        if not (t.tokens[k].first or t.text(k - 1) in ("{", ";", "=")):
            return False
        after = self.indents.get(k + 1, t.after(k + 1))
        line = t.tokens[k].line
        while after < len(t) and t.tokens[after].line == line and t.text(after) != "while":
            after = t.after(after)
        return t.text(after) == "while" or t.text(k + 1) == "{" and t.text(t.after(k + 1)) == "while"


def dialect_of(text: str, file_name: str) -> tuple[str | None, str | None]:
    """(name of the first dialect without an error, None), or (None, each dialect's first error with line and column)."""
    failed = []
    for dialect in order(file_name):
        errors = Check(text, dialect, file_name).errors
        if not errors:
            return dialect.name, None
        line, column, message = errors[0]
        failed.append(f'{dialect.name}: "{line}:{column}: {message}"')
    return None, "; ".join(failed)


def dialects(sources: DataFrame) -> DataFrame:
    """path, dialect, error of the Scala and build texts among sources (path, content); null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *dialect_of(content, path.rpartition("/")[2])) for path, content in zip(batch["path"], batch["content"]) if content is not None and not path.endswith(".java")]
            yield pd.DataFrame(rows, columns=["path", "dialect", "error"])

    return sources.select("path", "content").mapInPandas(run, "path string, dialect string, error string")
