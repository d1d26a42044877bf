"""Definitions of a Java text: types, members, parameters. A structural scan, not a full parse."""

from __future__ import annotations

from .lexer import Definitions, Tokens

MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
KINDS = ("class", "interface", "enum", "record")


class Java:
    def __init__(self, text: str):
        self.t = Tokens(text, java=True)
        self.out = Definitions()

    def run(self) -> Definitions:
        t, i, owner = self.t, 0, "_empty_/"
        i = self._modifiers(0, len(t))
        if t.text(i) == "package":
            end = i
            while end < len(t) and t.text(end) != ";":
                end += 1
            owner = "/".join(x.text for x in t.tokens[i + 1 : end] if x.kind == "name") + "/"
            i = end + 1
        else:
            i = 0
        self._members(i, len(t), owner, "")
        return self.out

    def _modifiers(self, i: int, end: int) -> int:
        """After annotations and modifiers; `@interface` stays."""
        t = self.t
        while i < end:
            if t.text(i) == "@" and t.text(i + 1) != "interface":
                i += 2
                while t.text(i) == "." and t.is_name(i + 1):
                    i += 2
                if t.text(i) == "(":
                    i = t.after(i)
            elif t.text(i) in MODIFIERS:
                i += 1
                if t.text(i - 1) == "non" and t.text(i) == "-":
                    i += 2
            else:
                break
        return i

    def _angles(self, i: int) -> int:
        """After `<...>` that begins at i, or i."""
        t, depth = self.t, 0
        if t.text(i) != "<":
            return i
        while i < len(t):
            depth += {"<": 1, ">": -1}.get(t.text(i), 0)
            i = t.after(i)
            if not depth:
                break
        return i

    def _type_parameters(self, begin: int, end: int):
        for a, b in self.t.parts(begin + 1, end - 1, angles=True):
            a = self._modifiers(a, b)
            if self.t.is_name(a):
                yield self.t.text(a), self.t.tokens[a].range

    def _parameters(self, opening: int):
        """The last name of each parameter; receivers and unnamed ones are none."""
        t = self.t
        for a, b in t.parts(opening + 1, t.close.get(opening, opening), angles=True):
            a = self._modifiers(a, b)
            names = [k for k in range(a, b) if t.is_name(k)]
            last = b - 1
            while last > a and t.text(last) in ("[", "]"):
                last -= 1
            if len(names) > 1 and t.is_name(last) and t.text(last) != "this":
                yield t.text(last), t.tokens[last].range

    def _statement_end(self, i: int, end: int) -> int:
        """After the next `;`."""
        while i < end and self.t.text(i) != ";":
            i = self.t.after(i)
        return min(i + 1, end)

    def _members(self, i: int, end: int, owner: str, type_name: str) -> list[str]:
        """All members in [i, end); the names of its methods without parameters."""
        t, plain = self.t, []
        while i < end:
            begin = i
            i = self._modifiers(i, end)
            if t.text(i) in (";", "}"):
                i += 1
            elif t.text(i) == "{":
                i = t.after(i)
            elif t.text(i) in ("import", "package"):
                i = self._statement_end(i, end)
            elif (t.text(i) in KINDS and t.is_name(i + 1) and t.text(i + 2) not in ("=", ";", ",", "(")) or (t.text(i) == "record" and t.is_name(i + 1) and t.text(i + 2) in ("(", "<")) or t.text(i) == "@":
                i = self._type(i, end, owner)
            else:
                i, name = self._member(i, end, owner, type_name)
                plain += [name] if name else []
            i = max(i, begin + 1)
        return plain

    def _member(self, i: int, end: int, owner: str, type_name: str) -> tuple[int, str]:
        t = self.t
        after = self._angles(i)
        if after > i:
            self.out.type_parameters(owner, list(self._type_parameters(i, after)))
            i = self._modifiers(after, end)
        if type_name and t.text(i) == type_name and t.text(i + 1) in ("(", "{"):  # constructors, compact ones too
            method = self.out.method(owner, "<init>", t.tokens[i].range)
            if t.text(i + 1) == "(":
                self.out.parameters(method, list(self._parameters(i + 1)))
                i = t.after(i + 1)
            while i < end and t.text(i) not in ("{", ";"):
                i = t.after(i)
            return t.after(i), ""
        # a type, then names: the last name before a bracket or a separator
        begin = i
        while i < end and (t.is_name(i) or t.text(i) in (".", "[", "?", "&", "<", "@")):
            if t.is_name(i) and t.text(i + 1) == "(":
                name, opening = i, i + 1
                method = self.out.method(owner, t.text(name), t.tokens[name].range)
                names = list(self._parameters(opening))
                self.out.parameters(method, names)
                i = t.after(opening)
                while i < end and t.text(i) not in ("{", ";"):
                    i = t.after(i)
                return t.after(i), "" if names else t.text(name)
            if t.is_name(i) and t.text(i + 1) in ("=", ";", ",", "[") and i > begin and (t.is_name(i - 1) or t.text(i - 1) in ("]", ">")):
                finish = self._statement_end(i, end)
                for a, _ in t.parts(i, finish - 1, angles=False):
                    if t.is_name(a) and t.text(a + 1) in ("=", ";", ",", "["):
                        self.out.term(owner, t.text(a), t.tokens[a].range)
                return finish, ""
            i = self._angles(i) if t.text(i) == "<" else self._modifiers(i, end) if t.text(i) == "@" else t.after(i)
        while i < end and t.text(i) not in (";", "{"):
            i = t.after(i)
        return t.after(i), ""

    def _type(self, i: int, end: int, owner: str) -> int:
        t = self.t
        annotation = t.text(i) == "@"
        kind = "annotation" if annotation else t.text(i)
        i += 2 if annotation else 1
        name, at = t.text(i), t.tokens[i].range if i < len(t) else Definitions.ZERO
        symbol = self.out.type(owner, name, at)
        i += 1
        after = self._angles(i)
        if after > i:
            self.out.type_parameters(symbol, list(self._type_parameters(i, after)))
            i = after
        components = []
        if kind == "record" and t.text(i) == "(":
            components = list(self._parameters(i))
            method = self.out.method(symbol, "<init>", at)
            self.out.parameters(method, components)
            i = t.after(i)
        while i < end and t.text(i) not in ("{", ";"):
            i = self._angles(i) if t.text(i) == "<" else t.after(i)
        if t.text(i) != "{":
            return i + 1
        body, close = i + 1, t.close.get(i, end)
        if kind == "enum":
            body = self._constants(body, close, symbol)
        before = (symbol, "<init>") in self.out._counts
        plain = self._members(body, close, symbol, name)
        if kind == "class" and not before and (symbol, "<init>") not in self.out._counts:
            self.out.method(symbol, "<init>", at)
        for component, place in components:
            if component not in plain:
                self.out.method(symbol, component, place)
        return close + 1

    def _constants(self, i: int, end: int, owner: str) -> int:
        t = self.t
        while i < end and t.text(i) != ";":
            i = self._modifiers(i, end)
            if t.is_name(i):
                self.out.term(owner, t.text(i), t.tokens[i].range)
            while i < end and t.text(i) not in (",", ";"):
                i = t.after(i)
            if t.text(i) == ",":
                i += 1
        return min(i + 1, end)


def definitions(text: str) -> Definitions:
    return Java(text).run()
