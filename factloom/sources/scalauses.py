"""Reference candidates of a Scala text, along its blocks.

The scan goes through the tree of blocks, braced or indented: a statement's signature and body, a
bracket, a case, the body of a loop over generators and of a lambda each have a scope of their own.
Type parameters are locals of the statement that binds them; their context bounds serve as types of
values. A name between two operands is a member of the left one's type, or nothing.
"""

from __future__ import annotations

import re

from . import references, scala
from .blocks import Block, indented
from .lexer import Tokens, bare, escaped

STATEMENTS = frozenset("class trait object enum def given extension type".split())
#: Words before a bracket whose end is no operand.
NO_OPERAND = frozenset("if while for match case".split())
TYPE_BEFORE = frozenset(": extends with [ <: >: new".split())


class ScalaScan(references.Scan):
    def __init__(self, text: str, file_name: str):
        super().__init__(text, file_name)
        self.indents = indented(self.t)
        self.opened = {b: a for a, b in self.t.close.items()}
        self.entered: set[int] = set()
        self.type_depth = 0
        self.tail: tuple[int, int | None, list[str]] = (-1, None, [])  # the end of the expression walked last, its ref, its candidates

    # blocks ------------------------------------------------------------------------------------

    def _walk(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> None:
        end = min(end, len(self.t))  # what stays open reaches beyond the last token
        while i < end:
            i = max(self._step(i, end, owners, scopes), i + 1)

    def _step(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """Handles what begins at token i; the index after it."""
        t, token = self.t, self.t.tokens[i]
        if i in self.indents and i not in self.entered:
            self.entered.add(i)
            stop = min(self.indents[i], end)
            self._walk(i, stop, owners, [*scopes, {}])
            return stop
        if token.kind == "mark" and token.text in ("(", "[", "{"):
            return self._bracket(i, end, owners, scopes)
        if token.kind == "string" and token.text[0] != '"':
            self._interpolated(token, owners, scopes)
        if token.kind != "name" or token.text == "_":
            return i + 1
        word = token.text
        if word == "package" and t.is_name(i + 1) and t.text(i + 1) != "object":
            return self._package(i, end, owners, scopes)
        if word == "import":
            use = lambda k, symbols, package=None: self._emit(k, symbols, "name" if package is None else "segment", name=package)
            return references.scala_imports(t, i + 1, end, self.imports, use)
        if word in ("this", "super") and t.text(i + 1) == "." and t.is_name(i + 2):
            return self._chain(i, end, owners, scopes, owners[-1:] if word == "this" else [])
        if word in STATEMENTS and self._states(i):
            return self._definition(i, end, owners, scopes)
        if word in ("val", "var"):
            return self._values(i, end, owners, scopes)
        if word == "case" and t.text(i + 1) not in ("class", "object"):
            return self._case(i, end, owners, scopes)
        if word == "for":
            return self._for(i, end, owners, scopes)
        if word in self.words or token.range[:2] in self.bound or token.range[:2] in self.defined:
            return i + 1
        if t.text(i + 1) in ("=>", "?=>") and self._begins_lambda(i):
            return self._lambda(i, i + 1, end, owners, scopes)
        if self._is_infix(i, end):
            return self._infix(i, owners, scopes)
        return self._use(i, end, owners, scopes)

    def _bracket(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """What a bracket encloses, with a scope of its own; parameters of a lambda reach to its end."""
        t = self.t
        after = min(t.after(i), end)
        if t.text(i) == "(" and t.text(after) in ("=>", "?=>") and after < end and not self.type_depth:
            return self._lambda(i + 1, after, end, owners, scopes)
        self.type_depth += t.text(i) == "["
        self._walk(i + 1, min(t.close[i], end), owners, [*scopes, {}])
        self.type_depth -= t.text(i) == "["
        return after

    def _states(self, i: int) -> bool:
        """Whether a word begins a statement here: a soft one needs what it binds."""
        t = self.t
        if i + 1 >= len(t):
            return False
        if t.text(i) == "extension":
            return t.text(i + 1) in ("(", "[")
        if t.text(i) == "given":
            return t.text(i - 1) not in (".", "{", ",")
        if t.text(i) == "type":
            return t.text(i - 1) != "." and t.is_name(i + 1)
        return t.text(i - 1) != "."

    def _package(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        path, k = references._dotted(self.t, i + 1, end)
        outer = "" if self.packages[-1] == "_empty_/" else self.packages[-1]
        inner = [p for p in self.packages if p != "_empty_/"] + [outer + "".join(escaped(p) + "/" for p in path)]
        if self.t.text(k) not in ("{", ":"):
            self.packages = inner  # to the end of what is around it
            return k
        before, self.packages = self.packages, inner
        stop = self.t.after(k) if self.t.text(k) == "{" else self.indents.get(k + 1, k + 1)
        self.entered.add(k + 1)
        self._walk(k + 1, min(stop, end), owners, [*scopes, {}])
        self.packages = before
        return stop

    def _definition(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """A statement's name in the scope around it, its parameters and body in one of its own."""
        t, word, k = self.t, self.t.text(i), i + 1
        block = self.shape.blocks.get(i) or (self.shape.extent(i, end) if self.shape.t is t else Block(i, end))
        stop, inner, symbol = min(block.end, end), [*scopes, {}], None
        if word == "package" or t.text(k) == "package":
            return k
        if word != "extension":
            symbol = self.defined.get(t.tokens[k].range[:2])
            named = symbol is not None or word != "given"
            if symbol is None and word not in ("given", "type") and (t.is_name(k) or t.tokens[k].kind == "operator") and t.text(k) != "this":
                symbol = self._local(k, scopes)
            elif symbol is None and word == "type":
                symbol = self._local(k, scopes)
            k += named
        if t.text(k) == "[" and k < stop:
            self._type_parameters(k, owners, inner)
            k = t.after(k)
        while word in ("class", "trait", "enum") and t.text(k) in ("private", "protected") and k < stop:
            k = t.after(k + 1) if t.text(k + 1) == "[" else k + 1
        while t.text(k) == "(" and k < stop and word != "type":
            self._parameters(k, owners, inner, block.owner if word in ("class", "trait", "enum") else None)
            k = t.after(k)
        if symbol and word in ("def", "given"):
            self._result(symbol, owners, inner)
        if block.owner:
            owners = [*owners, block.owner]
        self._walk(k, stop, owners, inner)
        return max(stop, k)

    def _type_parameters(self, opening: int, owners: list[str], scopes: list[dict[str, str]]) -> None:
        """Binds the names as locals; then the bounds are names in use."""
        t, rest = self.t, []
        for a, b in t.parts(opening + 1, t.close[opening]):
            while a < b and (t.text(a) in ("+", "-", "@")):
                a += 2 if t.text(a) == "@" else 1
            if not t.is_name(a) or t.text(a) == "_":
                continue
            symbol = self._local(a, scopes)
            self.types.pop(symbol, None)
            k = t.after(a + 1) if t.text(a + 1) == "[" else a + 1
            rest.append((k, b))
            colon = next((j for j in range(k, b) if t.text(j) == ":"), None)
            if colon is not None and (path := references._dotted(t, colon + 1, b)[0]):
                self.types[symbol] = path
        self.type_depth += 1
        for k, b in rest:
            self._walk(k, b, owners, scopes)
        self.type_depth -= 1

    def _parameters(self, opening: int, owners: list[str], scopes: list[dict[str, str]], member_of: str | None = None) -> None:
        """member_of: the class whose members they are, as which its body sees them."""
        t = self.t
        for a, b in t.parts(opening + 1, t.close[opening]):
            while a < b and (t.text(a) in scala.PARAMETER_WORDS or t.text(a) == "@") and t.text(a + 1) != ":":
                a += 2 if t.text(a) == "@" else 1
                a = t.after(a) if t.text(a) in ("(", "[") else a
            if t.is_name(a) and t.text(a + 1) == ":":
                place = t.tokens[a].range[:2]
                symbol = self.defined.get(place) or self.parameters.get(place)
                if symbol is None:
                    symbol = self._local(a, scopes)
                elif member_of:
                    accessor = f"{member_of}{escaped(t.text(a))}."
                    self.types |= {accessor: self.types[symbol]} if symbol in self.types else {}
                    self._result(accessor, owners, scopes)
                else:
                    scopes[-1][bare(t.text(a))] = symbol
                self._result(symbol, owners, scopes)
                a += 1
            self._walk(a, b, owners, scopes)

    def _values(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """The names that a val or var binds; names of other patterns than plain ones are locals everywhere."""
        t, k = self.t, i + 1
        stop = k
        while stop < end and t.text(stop) not in ("=", ";", ":") and not (stop > k and t.tokens[stop].first):
            stop = t.after(stop)
        plain = all(b - a == 1 and t.is_name(a) for a, b in t.parts(k, stop))
        if not plain:
            self._bind(k, stop, scopes)
            self._walk(k, stop, owners, scopes)
            return stop
        for a, _ in t.parts(k, stop):
            symbol = self.defined.get(t.tokens[a].range[:2])
            if symbol is None and t.text(a) != "_":
                symbol = self._local(a, scopes)
            if symbol:
                self._result(symbol, owners, scopes)
        return stop

    def _bind(self, a: int, b: int, scopes: list[dict[str, str]]) -> None:
        """The names that a pattern binds become locals of the innermost scope."""
        t = self.t
        for k in range(a, b):
            if t.is_name(k) and t.text(k)[0].islower() and t.text(k) not in self.words and t.text(k + 1) not in ("(", ".", "[") and t.text(k - 1) not in (".", ":"):
                self.bound.add(t.tokens[k].range[:2])
                self._local(k, scopes)

    def _past(self, k: int) -> int:
        """The index after token k and what it opens, bracket or indented block."""
        return self.indents[k] if k in self.indents and k not in self.entered else self.t.after(k)

    def _case(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """A case of a match, up to the next one, or of an enum."""
        t = self.t
        if t.tokens[i + 1].range[:2] in self.defined if i + 1 < len(t) else True:
            k, inner = i + 2, [*scopes, {}]
            if t.text(k) == "(":
                self._parameters(k, owners, inner)
                k = t.after(k)
            return k
        stop, arrow = i + 1, None
        while stop < end and not (t.text(stop) == "case" and t.text(stop + 1) not in ("class", "object")):
            if arrow is None and t.text(stop) in ("=>", "if"):
                arrow = stop
            stop = self._past(stop)
        inner = [*scopes, {}]
        if arrow is not None:
            self._bind(i + 1, arrow, inner)
            self._walk(i + 1, arrow, owners, inner)
        self._walk(i + 1 if arrow is None else arrow, min(stop, end), owners, inner)
        return stop

    def _for(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """Generators, which bind from left to right, and the body that sees what they bind."""
        t, k = self.t, i + 1
        if k in self.indents:
            a, b, after = k, min(self.indents[k], end), min(self.indents[k], end)
            self.entered.add(k)
        elif t.text(k) in ("(", "{") and t.text(t.after(k)) != "<-":
            a, b, after = k + 1, min(t.close[k], end), t.after(k)
        else:
            a, b = k, k
            while b < end and t.text(b) not in ("do", "yield"):
                b = t.after(b)
            b = after = min(b, end)
        inner, begin, k = [*scopes, {}], a, a
        while begin < b:
            k, arrow = begin, None
            while k < b and t.text(k) != ";" and not (k > begin and t.tokens[k].first and arrow is not None and t.tokens[k].char <= t.tokens[a].char):
                if arrow is None and t.text(k) in ("<-", "="):
                    arrow = k
                k = self._past(k)
            if arrow is not None and t.text(begin) != "if":
                self._bind(begin + (t.text(begin) == "case"), arrow, inner)
            self._walk(begin, min(k, b), owners, inner)
            begin = max(k, begin) + (t.text(k) == ";" if k < b else 0)
            if k == begin and k < b and arrow is None:
                begin += 1
        if t.text(after) in ("yield", "do"):
            after += 1
        if t.text(after) == "{" or after in self.indents:
            stop = self._past(after)
        else:
            stop = self._expression_end(after, end, i)
        self._walk(after, min(stop, end), owners, inner)
        return stop

    def _expression_end(self, k: int, end: int, start: int) -> int:
        """Where the expression from token k on ends: at a comma, a semicolon, or a line no further right than that of `start`."""
        column, begin = self.shape._line_column(start) if self.shape.t is self.t else 0, k
        while k < end:
            token = self.t.tokens[k]
            if token.text in (",", ";") or k > begin and token.first and token.char <= column and token.text != ".":
                return k
            k = self._past(k)
        return end

    def _begins_lambda(self, i: int) -> bool:
        return self.t.text(i - 1) in ("{", "(", ",", "=", ":", "implicit", "=>") or self.t.tokens[i].first

    def _lambda(self, i: int, arrow: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """Parameters from token i to the arrow, and the body, which alone sees them."""
        t, inner = self.t, [*scopes, {}]
        if arrow == i + 1:
            self._local(i, inner)
        else:
            for a, b in t.parts(i, arrow - 1):
                if t.is_name(a) and t.text(a) not in self.words and (t.text(a + 1) == ":" or b == a + 1):
                    self._result(self._local(a, inner), owners, scopes)
                    a += 1
                self._walk(a, b, owners, inner)
        stop = end if t.text(i - 1) == "{" else self._expression_end(arrow + 1, end, i)
        self._walk(arrow + 1, stop, owners, inner)
        return stop

    def _interpolated(self, token, owners: list[str], scopes: list[dict[str, str]]) -> None:
        """Names in use in an interpolated string, at their own places in the text."""
        whole = self.t, self.indents, self.entered, self.tail
        for m in re.finditer(r"\$\$|\$([^\W\d]\w*)|\$\{", token.text):
            if m[0] == "$$":
                continue
            begin, end = m.end() - len(m[1] or ""), m.end()
            if m[0] == "${":
                depth = 1
                while end < len(token.text) and depth:
                    depth += {"{": 1, "}": -1}.get(token.text[end], 0)
                    end += 1
                end -= 1
            before = token.text[:begin]
            line = token.line + before.count("\n")
            char = begin - before.rfind("\n") - 1 if "\n" in before else token.char + begin
            self.t, self.indents, self.entered, self.tail = Tokens("\n" * line + " " * char + token.text[begin:end]), {}, set(), (-1, None, [])
            self._walk(0, len(self.t), owners, [*scopes, {}])
        self.t, self.indents, self.entered, self.tail = whole

    # names in use ------------------------------------------------------------------------------

    def _typed(self, symbol: str, i: int) -> None:
        """Remembers the declared type of the value or method that token i names, or what a `new` gives it."""
        t, k = self.t, i + 1
        if not symbol.endswith("#"):
            if symbol.endswith(")."):
                k = t.after(k) if t.text(k) == "[" else k
                while t.text(k) == "(":
                    k = t.after(k)
            at = k + 1 if t.text(k) == ":" else k + 2 if t.text(k) == "=" and t.text(k + 1) == "new" else None
            path = self._whole(at, t.text(k) == "=") if at else []
            if path:
                self.types[symbol] = path

    def _order(self, i: int, new: bool) -> tuple[str, ...]:
        kind = self._kind(i, new)
        if self.type_depth or kind == "new":
            return references.TYPE
        if kind == "call":
            return references.CALL
        return references.TYPE if self.t.text(i - 1) in TYPE_BEFORE else references.VALUE

    def _applied(self, k: int, end: int, owners: list[str], scopes: list[dict[str, str]], ref: int | None) -> tuple[int, bool]:
        t, j, called = self.t, k + 1, False
        if t.text(j) == "[" and j < end:
            j = self._bracket(j, end, owners, scopes)
        while j < end and t.text(j) in ("(", "{") and not t.tokens[j].first and not (t.text(j) == "{" and self.type_depth):
            if t.text(j) == "(" and t.text(t.after(j)) in ("=>", "?=>"):
                break
            if t.text(j) == "(" and ref is not None and not called:
                self._arguments(j, ref)
            self._walk(j + 1, min(t.close[j], end), owners, [*scopes, {}])
            called = called or t.text(j) == "("
            j = t.after(j)
        return min(j, end), called

    def _arguments(self, opening: int, called: int) -> None:
        """Named arguments of a call whose bracket is token `opening`."""
        t = self.t
        for a, _ in t.parts(opening + 1, t.close[opening]):
            if t.is_name(a) and t.text(a + 1) == "=":
                self.rows.append((called, "argument", 0, escaped(t.text(a)), None, None, t.tokens[a].range))
                self.bound.add(t.tokens[a].range[:2])

    def _is_infix(self, i: int, end: int) -> bool:
        """Whether the name stands between two operands of one line."""
        t = self.t
        token, before = t.tokens[i], t.tokens[i - 1] if i else None
        if before is None or token.first or i + 1 >= end or t.tokens[i + 1].first or self.type_depth:
            return False
        if before.text in (")", "]"):
            opening = self.opened.get(i - 1)
            left = self.tail[0] == i or (opening is not None and t.text(opening - 1) not in NO_OPERAND and t.text(opening - 1) not in ("", "@"))
        else:
            left = before.kind in ("number", "string", "char") or (before.kind == "name" and (before.text not in self.words or before.text in ("this", "true", "false", "null")))
        right = t.tokens[i + 1]
        return left and (right.kind in ("number", "string", "char") or right.text in ("(", "{", "new", "this", "true", "false", "null") or (right.kind == "name" and right.text not in self.words))

    def _infix(self, i: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        end, ref, before = self.tail
        if end == i:
            found = self._members(before, [], self.t.text(i), references.CALL, owners, scopes)
            self._emit(i, found, "infix", of=ref, name=escaped(self.t.text(i)))
        return i + 1
