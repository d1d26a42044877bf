"""Definitions of a Scala text, in braces or indentation. A structural scan, not a full parse."""

from __future__ import annotations

from .blocks import Block
from .lexer import Definitions, Tokens, escaped

MODIFIERS = frozenset("private protected final sealed implicit lazy override abstract inline transparent opaque open infix erased tracked".split())
PARAMETER_WORDS = frozenset("val var private protected override implicit using inline final erased".split())
STARTS = frozenset("class trait object enum def val var type given extension package import export case".split())
#: Those whose body has members of an owner.
OWNS = frozenset("class trait object enum given".split())
#: Words that carry on a statement at the start of a line.
GOES_ON = frozenset("else catch finally yield then extends with derives do match".split())


class Scala:
    def __init__(self, text: str, file_name: str):
        self.t = Tokens(text)
        self.out = Definitions()
        self.file_name = file_name
        self.synthetic: list[tuple[str, str, str, list, tuple]] = []
        self.blocks: dict[int, Block] = {}  # of statements, by the token of their word

    def run(self) -> Definitions:
        self._statements(0, len(self.t), "_empty_/", package=True)
        for kind, owner, name, parameters, at in self.synthetic:
            symbol = f"{owner}{escaped(name)}" + ("." if kind == "term" else "().")
            if symbol in self.out.symbols:
                continue
            if kind == "term":
                self.out.term(owner, name, at)
            else:
                self.out.parameters(self.out.method(owner, name, at), parameters)
        return self.out

    def _wrapper(self, owner: str) -> str:
        """The owner of top-level members; its row is added once, without a place."""
        name = self.file_name
        base = "package$package" if name == "package.scala" else name.removesuffix(".sbt") if name.endswith(".sbt") else name.removesuffix(".scala") + "$package"
        symbol = f"{owner}{escaped(base)}."
        if symbol not in self.out.symbols:
            self.out.term(owner, base, Definitions.ZERO)
        return symbol

    # regions ---------------------------------------------------------------------------------

    def _indented_end(self, i: int, end: int, column: int) -> int:
        """Where lines no longer stand right of the column."""
        while i < end and not (self.t.tokens[i].first and self.t.tokens[i].char <= column):
            i = self.t.after(i)
        return min(i, end)

    def _end(self, i: int, end: int, start: int) -> int:
        """End of the statement that begins at `start`, looking from i on."""
        t = self.t
        column = t.tokens[start].char if t.tokens[start].first else -1
        while i < end:
            token = t.tokens[i]
            if token.text == ";":
                return i + 1
            if i > start and token.first and token.char <= max(column, 0) and not (token.text in GOES_ON or token.text == "." or (token.kind == "operator" and token.text not in ("@",))):
                if column >= 0 or token.text in STARTS or token.text in MODIFIERS or token.text == "@":
                    return i
            if i > start and column < 0 and token.first and (token.text in STARTS or token.text in MODIFIERS or token.text == "@"):
                return i
            i = t.after(i)
        return end

    def _body(self, i: int, end: int, start: int) -> tuple[int, int, int] | None:
        """(begin, end, next) of a template body: `{ ... }`, or `:` or `with` at a line's end and what is indented."""
        t = self.t
        column = t.tokens[start].char if t.tokens[start].first else self._line_column(start)
        while i < end:
            token = t.tokens[i]
            if token.text == "{":
                close = t.close.get(i, end)
                return i + 1, min(close, end), min(close + 1, end)
            following = t.tokens[i + 1] if i + 1 < end else None
            if token.text in (":", "with") and following is not None and following.first and following.char > column and following.line > token.line:
                stop = self._indented_end(i + 1, end, column)
                return i + 1, stop, stop
            if token.text in (";", "=") or (token.first and i > start and token.char <= column and token.text not in GOES_ON and token.text != "{"):
                return None
            i = t.after(i)
        return None

    def _line_column(self, i: int) -> int:
        while i > 0 and not self.t.tokens[i].first:
            i -= 1
        return self.t.tokens[i].char

    # statements ------------------------------------------------------------------------------

    def _statements(self, i: int, end: int, owner: str, package: bool = False, cases: bool = False, extension: list | None = None) -> None:
        t = self.t
        while i < end:
            start = i
            if t.text(i) in (";", "}", ")", "]"):
                i += 1
                continue
            flags = set()
            while i < end:
                if t.text(i) == "@":
                    i += 2
                    while t.text(i) in (".", "(", "[") and i < end:
                        i = i + 2 if t.text(i) == "." else t.after(i)
                elif t.text(i) in MODIFIERS and not (t.text(i) in ("open", "infix", "opaque", "inline", "transparent", "erased", "tracked") and t.text(i + 1) not in STARTS | MODIFIERS):
                    flags.add(t.text(i))
                    i += 1
                    if t.text(i) == "[" and flags & {"private", "protected"}:
                        i = t.after(i)
                elif t.text(i) == "case" and t.text(i + 1) in ("class", "object"):
                    flags.add("case")
                    i += 1
                else:
                    break
            word, at = t.text(i), i
            known = len(self.out.rows)
            if word == "package" and package:
                i, owner, _ = self._package(i, end, owner)
            elif word in ("class", "trait") and t.is_name(i + 1):
                i = self._class(i, end, start, owner, word, flags, package)
            elif word == "object" and (t.is_name(i + 1)):
                symbol = self.out.term(owner, t.text(i + 1), t.tokens[i + 1].range)
                i = self._template(i + 2, end, start, symbol)
            elif word == "enum" and t.is_name(i + 1):
                i = self._enum(i, end, start, owner)
            elif word == "case" and cases:
                i = self._cases(i, end, start, owner)
            elif word == "def":
                i = self._def(i, end, start, self._wrapper(owner) if package else owner, owner, extension or [])
            elif word in ("val", "var"):
                i = self._values(i, end, start, self._wrapper(owner) if package and self._simple(i + 1) else owner)
            elif word == "type" and t.is_name(i + 1):
                self.out.type(self._wrapper(owner) if package else owner, t.text(i + 1), t.tokens[i + 1].range)
                i = self._end(i + 2, end, start)
            elif word == "given":
                i = self._given(i, end, start, owner, package)
            elif word == "extension" and t.text(i + 1) in ("(", "["):
                i = self._extension(i, end, start, self._wrapper(owner) if package else owner)
            else:
                i = self._end(i + 1 if i == start else i, end, start)
            i = max(i, start + 1)
            if word in STARTS and word not in ("import", "export"):
                named = [r[0] for r in self.out.rows[known:] if word in OWNS and r[3] == t.tokens[at + 1].range and r[0].endswith(("#", "."))]
                self.blocks[at] = Block(start, min(i, end), (named[1] if word == "enum" else named[0]) if named else None)

    def extent(self, i: int, end: int) -> Block:
        """The block of the statement whose word is token i, where the definition scan does not go."""
        start = i
        while not self.t.tokens[start].first and (self.t.text(start - 1) in MODIFIERS or self.t.text(start - 1) == "case"):
            start -= 1
        return Block(start, self._end(i + 1, end, start))

    def _package(self, i: int, end: int, owner: str) -> tuple[int, str, bool]:
        t = self.t
        prefix = "" if owner == "_empty_/" else owner
        if t.text(i + 1) == "object" and t.is_name(i + 2):
            name = i + 2
            symbol = self.out.term(f"{prefix}{escaped(t.text(name))}/", "package", t.tokens[name].range)
            return self._template(name + 1, end, i, symbol), owner, False
        k = i + 1
        names = []
        while t.is_name(k):
            names.append(escaped(t.text(k)))
            k += 1
            if t.text(k) != "." or not t.is_name(k + 1):
                break
            k += 1
        inner = prefix + "".join(f"{n}/" for n in names)
        if t.text(k) in ("{", ":"):
            body = self._body(k, end, i)
            if body:
                self._statements(body[0], body[1], inner, package=True)
                return body[2], owner, False
        return k, inner, False

    def _template(self, i: int, end: int, start: int, owner: str, **how) -> int:
        """The members of the body that follows, if there is one."""
        body = self._body(i, end, start)
        if body is None:
            return self._end(i, end, start)
        self._statements(body[0], body[1], owner, **how)
        return body[2]

    def _type_parameters(self, opening: int):
        t = self.t
        for a, b in t.parts(opening + 1, t.close[opening]):
            while a < b and (t.text(a) in ("+", "-") or t.text(a) == "@"):
                a += 2 if t.text(a) == "@" else 1
            if t.is_name(a) and t.text(a) != "_":
                yield t.text(a), t.tokens[a].range

    def _parameters(self, i: int, end: int) -> tuple[list, int]:
        """Names of all parameter lists from i on, and the index after them."""
        t, out = self.t, []
        while i < end and t.text(i) == "(":
            for a, b in t.parts(i + 1, t.close[i]):
                while a < b and (t.text(a) in PARAMETER_WORDS or t.text(a) == "@") and t.text(a + 1) != ":":
                    if t.text(a) == "@":
                        a += 2
                        a = t.after(a) if t.text(a) == "(" else a
                    else:
                        a += 1
                        a = t.after(a) if t.text(a) == "[" else a
                if t.is_name(a) and t.text(a + 1) == ":":
                    out.append((t.text(a), t.tokens[a].range))
            i = t.after(i)
        return out, i

    def _class(self, i: int, end: int, start: int, owner: str, word: str, flags: set, package: bool) -> int:
        t, out = self.t, self.out
        name, at = t.text(i + 1), t.tokens[i + 1].range
        symbol = out.type(owner, name, at)
        i += 2
        if word == "trait":
            out.term(owner, name, at)
        if t.text(i) == "[":
            out.type_parameters(symbol, list(self._type_parameters(i)))
            i = t.after(i)
        while t.text(i) in ("private", "protected", "@"):
            i += 2 if t.text(i) == "@" else 1
            i = t.after(i) if t.text(i) == "[" else i
        method = out.method(symbol, "<init>", at)
        parameters: list = []
        if word == "class" and i < end and not t.tokens[i].first or t.text(i) == "(":
            parameters, i = self._parameters(i, end)
            out.parameters(method, parameters)
            for p, _ in parameters:
                out.term(symbol, p, at)
        if "case" in flags:
            companion = f"{owner}{escaped(name)}."
            self.synthetic += [
                ("method", symbol, "copy", parameters, at),
                ("term", owner, name, [], at),
                ("method", companion, "apply", parameters, at),
                ("method", companion, "unapply", [("x$1", at)], at),
                ("method", companion, "toString", [], at),
            ]
        if "implicit" in flags:
            out.method(self._wrapper(owner) if package else owner, name, at)
        return self._template(i, end, start, symbol)

    def _enum(self, i: int, end: int, start: int, owner: str) -> int:
        t, out = self.t, self.out
        name, at = t.text(i + 1), t.tokens[i + 1].range
        symbol = out.type(owner, name, at)
        term = out.term(owner, name, at)
        out.method(symbol, "<init>", at)
        i += 2
        if t.text(i) == "[":
            out.type_parameters(symbol, list(self._type_parameters(i)))
            i = t.after(i)
        _, i = self._parameters(i, end)
        return self._template(i, end, start, term, cases=True)

    def _cases(self, i: int, end: int, start: int, owner: str) -> int:
        stop = self._end(i + 1, end, start)
        for a, _ in self.t.parts(i + 1, stop):
            if self.t.is_name(a) and self.t.text(a) not in ("extends",):
                self.out.term(owner, self.t.text(a), self.t.tokens[a].range)
        return stop

    def _def(self, i: int, end: int, start: int, owner: str, scope: str, extension: list) -> int:
        t = self.t
        k = i + 1
        if k >= end:
            return end
        if t.text(k) == "this":
            method = self.out.method(scope, "<init>", t.tokens[k].range)
        elif t.is_name(k) or t.tokens[k].kind == "operator":
            method = self.out.method(owner, t.text(k), t.tokens[k].range)
        else:
            return self._end(k, end, start)
        k += 1
        if t.text(k) == "[":
            k = t.after(k)
        parameters, k = self._parameters(k, end)
        self.out.parameters(method, extension + parameters)
        return self._end(k, end, start)

    def _simple(self, k: int) -> bool:
        """Whether a simple pattern begins at k: a name, not an extractor."""
        return self.t.is_name(k) and self.t.text(k + 1) in (":", "=", ",", ";", "") or (self.t.is_name(k) and k + 1 < len(self.t) and self.t.tokens[k + 1].first)

    def _values(self, i: int, end: int, start: int, owner: str) -> int:
        t, k = self.t, i + 1
        while k < end and self._simple(k):
            self.out.term(owner, t.text(k), t.tokens[k].range)
            if t.text(k + 1) != ",":
                break
            k += 2
        return self._end(k, end, start)

    def _given(self, i: int, end: int, start: int, owner: str, package: bool) -> int:
        t, k = self.t, i + 2
        if not t.is_name(i + 1):
            return self._end(i + 1, end, start)
        if t.text(k) == "[":
            k = t.after(k)
        while t.text(k) == "(":
            k = t.after(k)
        if t.text(k) != ":":
            return self._end(i + 1, end, start)  # anonymous
        symbol = self.out.term(self._wrapper(owner) if package else owner, t.text(i + 1), t.tokens[i + 1].range)
        return self._template(k + 1, end, start, symbol)

    def _extension(self, i: int, end: int, start: int, owner: str) -> int:
        t, k = self.t, i + 1
        if t.text(k) == "[":
            k = t.after(k)
        parameters, k = self._parameters(k, end)
        if t.text(k) == "{":
            close = t.close.get(k, end)
            self._statements(k + 1, min(close, end), owner, extension=parameters)
            return close + 1
        stop = self._end(k, end, start)
        self._statements(k, stop, owner, extension=parameters)
        return stop


def definitions(text: str, file_name: str) -> Definitions:
    return Scala(text, file_name).run()
