"""Reference candidates of a source text: names in use, each with the symbols it may mean, in order.

A structural scan finds packages, imports and enclosing types and walks all names that are not
themselves definitions, bodies of all kinds included. What a name means depends on other files,
so the scan only ranks candidates: locals of the file, members of the enclosing owners from the
inside out, explicit imports, the own package, wildcard imports, default names, the default
package; members of a value come from its declared type. `occurrences` then joins: a name is
the first candidate that is defined anywhere, a method's first overload; calls and `new` add what
they imply, and named arguments the parameter.

This covers more places than a resolver of declarations alone would: bodies of conditionals,
loops, lambdas and constructors, interpolated strings, parameter and result types (a documented
superset).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import defaults
from ..functions import symbols as S
from ..operators import lookup
from ..tables import written
from . import java, scala
from .lexer import Tokens, bare, escaped

# Words of the two languages that are never names in use.
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int "
    "interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null "
    "var record yield sealed permits".split()
)
SCALA_WORDS = frozenset(
    "abstract case catch class def do else enum export extends extension false final finally for forSome given if implicit import lazy macro match new null object override package private "
    "protected return sealed super then this throw trait true try type using val var while with yield inline opaque open transparent infix derives end as".split()
)
#: Rows that a worker hands over at a time, about.
ROWS = 50_000
#: Words before the name of what has a body of members.
OPENS = frozenset("class enum interface record".split())
#: kind: name, call, new; segment (of an import; name: its package) and infix (a name between two operands), which are nothing if
#: unknown; asked (symbol: what symbols have before their shape, uses: the candidates of the text that begin so, as `_use` packs
#: them); argument (symbol: its name, ref: the called one); local (a definition); result (symbol: a type that the value in `name`
#: may have); definition (name: its short name, rank: 1 for a type). of: the ref whose member a name is; name: that name in symbols.
#: A name in use has a rank and a symbol only where a candidate is a local.
CANDIDATES = f"path string, ref int, kind string, rank int, symbol string, of int, name string, {schemas.RANGE}, uses array<bigint>"
LOCAL = re.compile(r"local\d+(\+\d+)?$")
#: What a symbol ends in, by number; the last two stand for the `apply` of an object and the constructor of a type.
SHAPES = ("", "#", ".", "().", ".apply().", "#`<init>`().")
# What build files see without an import, least of all.
BUILD_WILDCARDS = ("sbt/Keys.", "sbt/")
#: Shapes of symbols by what a name stands for, the likeliest first.
VALUE, TYPE, CALL = (".", "().", "#"), ("#", ".", "()."), ("().", ".", "#")


@dataclass
class Imports:
    """explicit: visible name -> (owner, name); wildcards: owners; hidden: names that an import takes away."""

    explicit: dict[str, list[str]] = field(default_factory=dict)
    wildcards: list[str] = field(default_factory=list)
    hidden: set[str] = field(default_factory=set)


def _owners(path: list[str]) -> list[str]:
    """What a dotted path may be as an owner: a package, an object or a type."""
    names = [escaped(p) for p in path]
    head = "/".join(names[:-1]) + "/" if len(names) > 1 else ""
    return ["/".join(names) + "/", f"{head}{names[-1]}.", f"{head}{names[-1]}#"]


def _shapes(owner: str, name: str, order: tuple[str, ...] = TYPE) -> list[str]:
    """Symbols of a name in an owner: a type, a term, a method."""
    return [f"{owner}{escaped(name)}{end}" for end in order]


def _ordered(symbols: list[str], order: tuple[str, ...]) -> list[str]:
    """Symbols by shape, in the order given; equal shapes as they come."""
    shape = lambda s: "()." if s.endswith(").") else s[-1:]
    return sorted(symbols, key=lambda s: order.index(shape(s)) if shape(s) in order else len(order))


def _dotted(t: Tokens, i: int, end: int) -> tuple[list[str], int]:
    names = []
    while i < end and t.is_name(i) and t.text(i) not in ("given", "_"):
        names.append(t.text(i))
        if t.text(i + 1) != ".":
            return names, i + 1
        i += 2
    return names, i


def scala_imports(t: Tokens, i: int, end: int, found: Imports, use=lambda i, symbols, package=None: None) -> int:
    """An import's clauses from token i on; the index after them. Names, renames, unimports, wildcards, givens.

    use: is told of each imported name's token and candidates, and of those of the segments before
    it, with the package that a segment may be.
    """
    while i < end:
        begin = i
        path, i = _dotted(t, i, end)
        if not path:
            return i + 1
        whole = list(path)
        selectors: list[tuple[str, str, int]] = []
        if t.text(i) == "{":
            for a, b in t.parts(i + 1, t.close[i]):
                words = [k for k in range(a, b) if t.text(k) not in ("=>", "as")]
                if len(words) > 1 and t.text(words[0]) == "given":  # a given by its type
                    words = words[1:2]
                if words:
                    selectors.append((t.text(words[0]), t.text(words[1] if len(words) > 1 else words[0]), words[0]))
            i = t.after(i)
        elif t.text(i) in ("_", "*", "given") or (i < end and t.tokens[i].kind == "operator" and t.text(i).startswith("*")):
            selectors.append((t.text(i), t.text(i), i))
            i += 1
        elif t.text(i) == "as" and t.is_name(i + 1):
            selectors.append((path.pop(), t.text(i + 1), i - 1))
            i += 2
        else:
            selectors.append((path[-1], path.pop(), i - 1))
        owners = _owners(path) if path else [""]
        for k in range(len(path)):
            held = _owners(whole[: k + 1])
            use(begin + 2 * k, held[1:], held[0])
        for name, seen, at in selectors:
            if name in ("_", "*", "given"):
                found.wildcards += owners
            elif seen == "_":
                found.hidden.add(bare(name))
            else:
                symbols = [s for o in owners for s in _shapes(o, name)]
                use(at, symbols)
                for visible in {bare(name), bare(seen)}:  # both names become visible
                    found.explicit.setdefault(visible, []).extend(symbols)
        if t.text(i) != ",":
            return i
        i += 1
    return i


def java_imports(t: Tokens, i: int, end: int, found: Imports, use=lambda i, symbols, last=True: None) -> int:
    """An import from token i on: a type, a package or type wildcard, or a static member.

    use: is told of each segment's token and candidates, and whether it is the imported name.
    """
    static = t.text(i) == "static"
    begin = i + static
    path, i = _dotted(t, begin, end)
    for k in range(1, len(path)):
        last = k == len(path) - 1 and t.text(i) != "*"
        owners = [o for o in _owners(path[:k]) if o.endswith(("#", "/"))]
        use(begin + 2 * k, [s for o in owners for s in _shapes(o, path[k]) if static and last or s.endswith("#")], last)
    wildcard = bool(path) and t.text(i) == "*"
    if wildcard:
        found.wildcards += [o for o in _owners(path) if o.endswith("#" if static else ("/", "#"))]
        i += 1
    elif path:
        *owner, name = path
        owners = [o for o in _owners(owner) if o.endswith("#" if static else ("/", "#"))] if owner else [""]
        found.explicit.setdefault(name, []).extend(s for o in owners for s in _shapes(o, name))
    while i < end and t.text(i) != ";":
        i += 1
    return i + 1


@lru_cache(2)
def _default_names(of_java: bool) -> dict[str, list[str]]:
    known: dict[str, list[str]] = {}
    for language, name, _, symbol in defaults.symbols():
        if (language == "java") == of_java:
            known.setdefault(name, []).append(symbol)
    return known


class Scan:
    """Candidates of one Java text, and what the scans of both languages share; for a Scala text, its scan."""

    def __new__(cls, text: str, file_name: str) -> "Scan":
        if cls is Scan and not file_name.endswith(".java"):
            from .scalauses import ScalaScan as cls  # it builds on this class
        return super().__new__(cls)

    def __init__(self, text: str, file_name: str):
        self.java = file_name.endswith(".java")
        self.t = Tokens(text, java=self.java)
        if self.java:
            found = java.definitions(text)
        else:
            self.shape = scala.Scala(text, file_name)
            found = self.shape.run()
        self.definitions = found.rows
        self.defined: dict[tuple, str] = {}
        for symbol, _, _, at in found.rows:  # of several at a place, the first: the type itself
            if not symbol.endswith((")", "]")):
                self.defined.setdefault(at[:2], symbol)
        self.parameters = {at[:2]: symbol for symbol, _, _, at in found.rows if symbol.endswith((")", "]"))}
        self.words = JAVA_WORDS if self.java else SCALA_WORDS
        self.known = _default_names(self.java)
        self.imports = Imports()
        build = file_name.endswith(".sbt")
        self.last_wildcards = BUILD_WILDCARDS if build else ()
        self.owners = [f"_empty_/{escaped(file_name.removesuffix('.sbt'))}."] if build else []
        #: (ref, kind, rank, symbol, of, name, range)
        self.rows: list[tuple[int, str, int, str, int | None, str | None, tuple]] = []
        self.bound: set[tuple] = set()  # places of names that patterns bind, and of named arguments
        self.types: dict[str, list[str]] = {}  # symbols of values with a declared type: its path
        self.packages = ["_empty_/"]  # visible ones, the innermost last
        self.locals = 0
        self.refs = 0

    def run(self) -> "Scan":
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(self.t) + 1000))  # brackets may nest as deep as a text is long
        for i, token in enumerate(self.t.tokens):
            symbol = self.defined.get(token.range[:2]) or self.parameters.get(token.range[:2])
            if symbol and token.kind == "name":
                self._typed(symbol, i)
        self._walk(0, len(self.t), self.owners, [{}])
        return self

    def _walk(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> None:
        """owners: enclosing types and objects, innermost last; scopes: local names to symbols, likewise."""
        t = self.t
        pending: str | None = None  # the owner whose body the next brace opens
        while i < end:
            token = t.tokens[i]
            if token.kind == "name" and token.text == "package" and t.is_name(i + 1):
                path, i = _dotted(t, i + 1, end)
                self.packages = ["".join(escaped(p) + "/" for p in path)]
                continue
            if token.kind == "name" and token.text == "import":
                i = java_imports(t, i + 1, end, self.imports, lambda k, symbols, last=True: self._emit(k, symbols, "name" if last else "segment"))
                continue
            if token.text == "{" and token.kind == "mark":
                inner = owners + [pending] if pending else owners
                self._walk(i + 1, min(t.close[i], end), inner, [*scopes, {}])
                pending = None
                i = t.after(i)
                continue
            if token.kind == "name" and token.text in ("this", "super") and t.text(i + 1) == "." and t.is_name(i + 2):
                i = self._chain(i, end, owners, scopes, owners[-1:] if token.text == "this" else [])
                continue
            if token.kind == "name" and token.text != "_" and token.text not in self.words:
                place = token.range[:2]
                if place in self.defined:
                    pending = self.defined[place] if t.text(i - 1) in OPENS else None
                    self._result(self.defined[place], owners, scopes)
                elif place in self.parameters:  # a parameter hides others from here on
                    scopes[-1][bare(token.text)] = self.parameters[place]
                    self._result(self.parameters[place], owners, scopes)
                elif place not in self.bound and not self._declares(i, owners, scopes):
                    i = self._use(i, end, owners, scopes)
                    continue
            elif token.text == ";":
                pending = None
            i += 1

    def _local(self, i: int, scopes: list[dict[str, str]]) -> str:
        symbol = f"local{self.locals}"
        scopes[-1][bare(self.t.text(i))] = symbol
        self.rows.append((-1, "local", 0, symbol, None, None, self.t.tokens[i].range))
        self.locals += 1
        self._typed(symbol, i)
        return symbol

    def _typed(self, symbol: str, i: int) -> None:
        """Remembers the declared type of the value or method that token i names, or what a `new` gives it."""
        t, path = self.t, []
        k = i - 1
        while t.text(k) == "]" or t.text(k) == "[":
            k -= 1
        depth = 0
        while k >= 0 and (t.text(k) == ">" or depth):
            depth += {">": 1, "<": -1}.get(t.text(k), 0)
            k -= 1
        if t.text(k) == "var" and t.text(i + 1) == "=" and t.text(i + 2) == "new":
            path = self._whole(i + 3, True)
        while t.is_name(k) and t.text(k) not in self.words:
            path.insert(0, t.text(k))
            if t.text(k - 1) != ".":
                break
            k -= 2
        if path:
            self.types[symbol] = path

    def _whole(self, at: int, made: bool) -> list[str]:
        """The dotted type from token `at` on; made: by a `new`, of which nothing may be selected."""
        t = self.t
        path, k = _dotted(t, at, len(t))
        while made and t.text(k) in ("[", "("):
            k = t.after(k)
        return [] if made and t.text(k) == "." else path

    def _result(self, symbol: str, owners: list[str], scopes: list[dict[str, str]]) -> None:
        """What the type of a value or of a method's result may be, for members that other names have."""
        if symbol in self.types and not symbol.endswith("#"):
            for rank, kind in enumerate(dict.fromkeys(self._type(symbol, owners, scopes))):
                if kind.endswith("#"):
                    self.rows.append((-1, "result", rank, kind, None, symbol, (0, 0, 0, 0)))

    def _type(self, symbol: str, owners: list[str], scopes: list[dict[str, str]]) -> list[str]:
        """Candidates of the declared type of a symbol."""
        head, *rest = self.types[symbol]
        kinds = self._named(bare(head), owners, scopes, TYPE)
        for k in kinds:
            if k in self.types and k.startswith("local"):  # a type parameter stands for its bound
                kinds = self._type(k, owners, scopes[:-1])
                break
        for part in rest:
            kinds = [x for o in kinds if o.endswith(("#", ".")) for x in _shapes(o, part)]
        return kinds

    def _declares(self, i: int, owners: list[str], scopes: list) -> bool:
        """A local value, parameter or class that no definition covers gets the next local symbol."""
        t, before = self.t, self.t.text(i - 1)
        typed = i > 0 and (t.is_name(i - 1) and before not in ("return", "new", "throw", "else", "instanceof", "case") or before in (">", "]"))
        local = typed and t.text(i + 1) in ("=", ";", ":", ",", ")") and len(scopes) > 1
        k = i + 1
        while before in ("(", ",") and t.text(k) == "," and t.is_name(k + 1):
            k += 2
        local = local or t.text(i + 1) == "->" or before in ("(", ",") and t.text(k) == ")" and t.text(k + 1) == "->"
        if local:
            self._result(self._local(i, scopes), owners, scopes)
        return local

    def _use(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]]) -> int:
        """A name and what is selected from it and from what its calls give; a candidate list for each. The index after all."""
        t, new = self.t, self.t.text(i - 1) == "new"
        if t.text(i - 1) == ".":  # a member of an expression that is no chain of names
            self._emit(i, [], self._kind(i, False))
            return i + 1
        before = self._named(bare(t.text(i)), owners, scopes, self._order(i, new))
        ref = self._emit(i, before, self._kind(i, new))
        return self._chain(i, end, owners, scopes, before, ref, new)

    def _chain(self, i: int, end: int, owners: list[str], scopes: list[dict[str, str]], before: list[str], ref: int | None = None, new: bool = False) -> int:
        """What is selected after token i, of which `before` are the candidates."""
        t = self.t
        path = [t.text(i)] if ref is not None and not any(bare(t.text(i)) in scope for scope in scopes) else []  # a value is no package
        k, kind = i, self._kind(i, new)
        while True:
            j, called = self._applied(k, end, owners, scopes, ref)
            if called:
                path = []
                # a call of an object makes one of its type, if it is no method or value
                before = [s if kind == "new" else f"{s[:-1]}#" if s.endswith(".") and not s.endswith(").") else s for s in before]
            if t.text(j) != "." or not t.is_name(j + 1) or j + 1 >= end or t.text(j + 1) in self.words:
                break
            member, k = t.text(j + 1), j + 1
            kind = self._kind(k, new and not called)
            before = self._members(before, path, member, self._order(k, new and not called), owners, scopes)
            ref = self._emit(k, before, kind, of=ref, name=escaped(member))
            path = path + [member] if path else []
            new = new and not called
        if self.java and t.text(j) == "::" and t.is_name(j + 1) and j + 1 < end:
            if t.text(j + 1) != "new":  # a method reference stands for the whole expression
                at = (*t.tokens[i].range[:2], *t.tokens[j + 1].range[2:])
                found = self._members(before, path, t.text(j + 1), CALL, owners, scopes)
                self._emit(j + 1, found, "name", at, ref, escaped(t.text(j + 1)))
            j += 2
        self.tail = j, ref, before
        return j

    def _applied(self, k: int, end: int, owners: list[str], scopes: list[dict[str, str]], ref: int | None) -> tuple[int, bool]:
        """Walks the arguments after token k; the index after them, and whether there are any."""
        t, j = self.t, k + 1
        if t.text(j) == "<":  # type arguments of a `new`, if they close before a call
            depth, m = 0, j
            while m < end and (t.text(m) in ("<", ">", ",", ".", "?", "[", "]", "&") or t.is_name(m)):
                depth += {"<": 1, ">": -1}.get(t.text(m), 0)
                m += 1
                if not depth:
                    break
            if not depth and t.text(m) == "(":
                self._walk(j, m, owners, scopes)
                j = m
        called = False
        while t.text(j) == "(" and j < end:
            self._walk(j + 1, min(t.close[j], end), owners, scopes)
            j, called = t.after(j), True
        return j, called

    def _kind(self, i: int, new: bool) -> str:
        after = self.t.after(i + 1) if self.t.text(i + 1) == "[" else i + 1
        if new and self.t.text(i + 1) != ".":
            return "new"
        return "call" if self.t.text(after) == "(" else "name"

    def _order(self, i: int, new: bool) -> tuple[str, ...]:
        return CALL if self._kind(i, new) == "call" else TYPE

    def _members(self, before: list[str], path: list[str], name: str, order: tuple[str, ...], owners: list[str], scopes: list[dict[str, str]]) -> list[str]:
        """Candidates of a member of what `before` may be: of its declared type, of it as an owner, of the path as a package."""
        found: list[str] = []
        for s in before:
            if s in self.types and self.types[s] != path:
                found += [x for o in self._type(s, owners, scopes) if o.endswith("#") for x in _shapes(o, name, order)]
        found += [x for o in before if o.endswith(("#", ".")) and not o.endswith(").") for x in _shapes(o, name, order)]
        found += [x for o in (_owners(path) if path else ()) for x in _shapes(o, name, order)]
        return found

    def _named(self, name: str, owners: list[str], scopes: list[dict[str, str]], order: tuple[str, ...]) -> list[str]:
        for scope in reversed(scopes):
            if name in scope:
                return [scope[name]]
        found: list[str] = []
        for owner in reversed(owners):
            found += _shapes(owner, name, order)
            if owner.endswith("#"):
                found += _shapes(owner[:-1] + ".", name, order)
        hidden = name in self.imports.hidden
        if not hidden:
            found += _ordered(self.imports.explicit.get(name, []), order)
        for package in reversed(self.packages):
            found += _shapes(package, name, order)
        if not hidden:
            found += [s for o in (*self.imports.wildcards, *self.last_wildcards) for s in _shapes(o, name, order)]
        found += _ordered(self.known.get(name, []), order)
        if "_empty_/" not in self.packages:
            found += _shapes("_empty_/", name, order)
        return found

    def _emit(self, i: int, symbols: list[str], kind: str, at: tuple | None = None, of: int | None = None, name: str | None = None) -> int:
        """Rows of a name in use; without a candidate, one with the name itself, which is no symbol."""
        for rank, symbol in enumerate(dict.fromkeys(symbols or [escaped(self.t.text(i))])):
            self.rows.append((self.refs, kind, rank, symbol, of, name, at or self.t.tokens[i].range))
        self.refs += 1
        return self.refs - 1


def scan(sources: DataFrame) -> DataFrame:
    """All that sources (path, content) define and use, as tagged rows of one scan, written once."""
    names = [c.split()[0] for c in CANDIDATES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                if content is not None:
                    found = Scan(content, path.rpartition("/")[2]).run()
                    rows += [(path, *row) for row in _grouped(found.rows)]
                    rows += [(path, -1, "definition", int(is_type), symbol, None, name, *at, None) for symbol, name, is_type, at in found.definitions]
                if len(rows) >= ROWS:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)

    return written(sources.select("path", "content").mapInPandas(run, CANDIDATES), "uses")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int32" for c in ("ref", "rank", "of", *schemas.RANGE_COLUMNS)})  # all may be null


@lru_cache(1)
def _standing() -> frozenset[str]:
    return frozenset(s for _, _, _, s in defaults.symbols())


def _use(ref: int, rank: int, shape: int) -> int:
    return ref << 32 | rank << 3 | shape


def _grouped(rows: list[tuple]) -> Iterator[tuple]:
    """Rows of a scan with those of names in use as one each, and one for each beginning that their candidates have.

    What follows a local or a name that stands by default is never reached, so it is left out.
    """
    names: dict[int, list] = {}
    asked: dict[str, list[int]] = {}
    closed: set[int] = set()
    for ref, kind, rank, symbol, of, name, at in rows:
        if kind in ("local", "result", "argument"):
            yield (ref, kind, rank, symbol, of, name, *at, None)
            continue
        row = names.setdefault(ref, [ref, kind, None, None, of, name, *at, None])
        if ref in closed:
            continue
        if LOCAL.match(symbol):
            row[2:4] = rank, symbol
            closed.add(ref)
            continue
        shape = 3 if symbol.endswith("().") else 2 if symbol.endswith(".") else 1 if symbol.endswith("#") else 0
        uses = asked.setdefault(symbol[: len(symbol) - len(SHAPES[shape])], [])
        uses.append(_use(ref, rank, shape))
        if kind == "call" and shape == 2 and not symbol.endswith(")."):
            uses.append(_use(ref, rank, 4))
        elif kind == "new" and shape == 1:
            uses.append(_use(ref, rank, 5))
        if symbol in _standing():
            closed.add(ref)
    yield from map(tuple, names.values())
    for base, uses in asked.items():
        yield (None, "asked", None, base, None, None, None, None, None, None, uses)


def candidates(sources: DataFrame) -> DataFrame:
    """Ranked candidates of all names in use in sources (path, content), their named arguments and local definitions."""
    return scan(sources).filter("kind <> 'definition'")


def definitions(scanned: DataFrame) -> DataFrame:
    """The definitions among scanned rows."""
    return scanned.filter("kind = 'definition'").select("symbol", F.col("name").alias("short_name"), (F.col("rank") == 1).alias("is_type"), *schemas.RANGE_COLUMNS, "path")


def local_definitions(found: DataFrame) -> DataFrame:
    """The local definitions among the candidates, as rows of locals."""
    return found.filter("kind = 'local'").select("path", "symbol", F.col("symbol").alias("short_name"), F.lit(False).alias("is_type"), *schemas.RANGE_COLUMNS)


def known_names(definitions: DataFrame) -> DataFrame:
    """key, symbol: what a candidate means. Methods go by their first overload; members of a file's wrapper also by their package."""
    held = lookup.with_overload_columns(definitions.select("symbol").distinct()).filter(f"owner_name is null or index <= {lookup.OVERLOADS}")
    own = F.coalesce(F.concat("owner_name", F.lit(").")), "symbol")
    keys = [F.struct(own.alias("key"), F.lit(0).alias("tier"))]
    keys.append(F.struct(F.when(own.rlike(r"\$package\.[^.#]+"), F.regexp_replace(own, r"[^/.#]*\$package\.", "")).alias("key"), F.lit(1).alias("tier")))
    named = held.select("symbol", F.coalesce("index", F.lit(0)).alias("index"), F.inline(F.array(*keys))).filter("key is not null")
    standing = held.sparkSession.createDataFrame([(s, 0, s, 2) for s in sorted({s for _, _, _, s in defaults.symbols()})], "symbol string, index int, key string, tier int")
    return named.union(standing).groupBy("key").agg(F.min_by("symbol", F.struct("tier", "index", "symbol")).alias("symbol"))


def occurrences(found: DataFrame, definitions: DataFrame, packages: bool = False) -> DataFrame:
    """Each name in use with the first candidate that is a local, a default or defined; null where none is.

    A call of an object also means its `apply`, a `new` also the constructor, at the same place; a
    named argument means the parameter of the method that is called, where that is defined. Members
    of what calls and values give are found by the types of results, round by round, until no more
    are. packages: segments of Scala's imports that are nothing else are their packages.
    """
    names = written(known_names(definitions), "names")
    refs = written(_first_known(found, names), "refs")
    refs = _with_members(refs, found, names)
    wanted = "symbol is not null or kind not in ('segment', 'infix')"
    if packages:
        refs = refs.withColumn("symbol", F.coalesce("symbol", F.when(F.col("kind") == "segment", F.col("name"))))
    refs = refs.filter(wanted)
    method = F.coalesce("implied", F.when(F.col("symbol").endswith(")."), F.col("symbol")))
    own = F.array_compact(F.array(F.struct("symbol"), F.when(F.col("implied").isNotNull(), F.struct(F.col("implied").alias("symbol")))))
    rows = refs.select("path", F.inline(own), *schemas.RANGE_COLUMNS)
    arguments = found.filter("kind = 'argument'").select("path", "ref", F.col("symbol").alias("argument"), *[F.col(c).alias(f"own_{c}") for c in schemas.RANGE_COLUMNS])
    arguments = arguments.join(refs.select("path", "ref", method.alias("method")).filter("method is not null"), ["path", "ref"])
    arguments = arguments.withColumn("key", F.concat("method", F.lit("("), "argument", F.lit(")"))).join(names.select("key"), "key")
    return rows.union(arguments.select("path", "key", *[f"own_{c}" for c in schemas.RANGE_COLUMNS]))


def _first_known(found: DataFrame, names: DataFrame) -> DataFrame:
    """path, ref, kind, of, name, range, symbol: the first candidate that is known; implied: the `apply` or constructor that it brings.

    Each text asks once for a beginning of symbols, and only what is known of it goes back to the names in use.
    """
    ends = [F.struct(F.expr(f"left(key, length(key) - {len(end)})").alias("base"), F.lit(k).alias("shape")) for k, end in enumerate(SHAPES)]
    key = F.col("key")
    own = F.when(key.endswith(SHAPES[3]), ends[3]).when(key.endswith(SHAPES[2]), ends[2]).when(key.endswith(SHAPES[1]), ends[1]).otherwise(ends[0])
    brought = [F.when(key.endswith(SHAPES[k]), ends[k]) for k in (4, 5)]
    shaped = names.select(F.col("symbol").alias("known"), F.inline(F.array_compact(F.array(own, *brought))))
    asked = found.filter("kind = 'asked'").select("path", F.col("symbol").alias("base"), "uses")
    alike = F.filter("uses", lambda use: use.bitwiseAND(7) == F.col("shape"))
    hits = asked.join(lookup.shuffled(shaped), "base").select("path", F.explode(alike).alias("use"), "shape", "known")
    place = ("kind", "of", "name", *schemas.RANGE_COLUMNS)
    given = found.filter("kind not in ('asked', 'local', 'result', 'argument', 'definition')").select("path", "ref", "rank", F.col("symbol").alias("known"), F.lit(False).alias("more"), F.struct(*place).alias("at"))
    hits = hits.select("path", F.shiftright("use", 32).cast("int").alias("ref"), F.shiftright("use", 3).bitwiseAND((1 << 29) - 1).cast("int").alias("rank"), "known", (F.col("shape") > 3).alias("more"), F.lit(None).cast(given.schema["at"].dataType).alias("at"))
    hit = F.struct("rank", F.col("known").alias("symbol"))
    best = given.union(hits).groupBy("path", "ref").agg(
        F.max("at").alias("at"),
        F.min(F.when(~F.col("more") & F.col("known").isNotNull(), hit)).alias("best"),
        F.collect_list(F.when(F.col("more"), hit)).alias("brought"),  # at most one a candidate
    )
    implied = F.get(F.filter("brought", lambda x: x["rank"] == F.col("best.rank")), F.lit(0))["symbol"]
    return best.select("path", "ref", "at.*", F.col("best.symbol").alias("symbol"), implied.alias("implied"))


def _with_members(refs: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """refs, with members that only the types of results tell: each round finds those of names that the round before found."""
    pending = refs.filter("symbol is null and of is not null").select("path", "ref", "of", "kind", "name")
    if pending.isEmpty():
        return refs
    local = lambda symbol: F.when(S.is_local(symbol), F.concat("path", F.lit("\0"), symbol)).otherwise(F.col(symbol))
    held = found.filter("kind = 'result'").withColumn("value", local("name")).select("value", "rank", F.col("symbol").alias("key")).join(names, "key")
    results = written(held.groupBy("value").agg(F.min(F.struct("rank", F.col("symbol").alias("type")))["type"].alias("type")), "results")
    fresh, rounds = refs.filter("symbol is not null"), []
    while True:
        source = fresh.select("path", F.col("ref").alias("of"), F.col("kind").alias("given"), F.col("symbol").alias("source"), "implied")
        steps = pending.join(source, ["path", "of"])
        # a `new` has its type; a call has what its method gives, and of an object else the object's class
        value = F.when((F.col("given") == "call") & F.col("implied").isNotNull(), F.col("implied")).otherwise(F.col("source"))
        own = F.when((F.col("given") == "new") & F.col("source").endswith("#"), F.col("source")).when((F.col("given") == "call") & F.col("source").endswith(".") & ~F.col("source").endswith(")."), F.concat(F.expr("left(source, length(source) - 1)"), F.lit("#")))
        steps = steps.withColumn("value", value).withColumn("value", local("value")).withColumn("own", own).join(results, "value", "left").withColumn("type", F.coalesce("type", "own")).filter("type like '%#'")
        shapes = F.when(F.col("kind").isin("call", "infix"), F.array(*map(F.lit, CALL))).otherwise(F.array(*map(F.lit, VALUE)))
        keyed = steps.select("path", "ref", "kind", F.posexplode(F.transform(shapes, lambda end: F.concat("type", "name", end))).alias("rank", "key"))
        hits = keyed.join(names, "key").groupBy("path", "ref").agg(F.min(F.struct("rank", "symbol", "kind")).alias("hit"))
        fresh = written(hits.select("path", "ref", "hit.kind", "hit.symbol", F.lit(None).cast("string").alias("implied")), "members")
        if fresh.isEmpty():
            break
        rounds.append(fresh)
        pending = pending.join(fresh.select("path", "ref"), ["path", "ref"], "left_anti")
    if not rounds:
        return refs
    more = rounds[0]
    for other in rounds[1:]:
        more = more.union(other)
    more = more.select("path", "ref", F.col("symbol").alias("more"))
    return refs.join(more, ["path", "ref"], "left").withColumn("symbol", F.coalesce("symbol", "more")).drop("more")
