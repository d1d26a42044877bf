"""Layered ignore rules over a table of paths, without a join.

A rule list is configuration: the lines of some ignore files. Each pattern becomes a regular
expression once; the last matching rule decides. Short lists are one conditional expression; a long
one, which would make a plan of thousands of branches, is matched by an Arrow function that holds
the compiled patterns. A path is ignored, too, if a folder above it is: no rule re-includes below it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of folders that never hold sources. A tool's own state folders are a parameter where they are needed.
ALWAYS_SKIP = (".git", ".github", ".idea", ".vscode", ".metals", ".bsp", ".scala-build", "target", "out", "node_modules")
#: Rules up to which a verdict is an expression of the plan.
EXPRESSION = 32
SOURCE_SUFFIXES = ("scala", "java", "sbt")


@dataclass(frozen=True)
class Rule:
    """pattern: one line of an ignore file; base: the folder of that file, '' for the root."""

    pattern: str
    base: str = ""

    @property
    def negated(self) -> bool:
        return self.pattern.startswith("!")

    @property
    def folders_only(self) -> bool:
        return self.pattern.endswith("/")

    @property
    def regex(self) -> str:
        """Matches the path below base; folders have a slash at their end."""
        body = self.pattern.removeprefix("!").removesuffix("/")
        if "/" not in body:
            return f"^(?:.*/)?{_glob(body)}/?$"
        body = body.removeprefix("/")
        if "*" in body or "?" in body:
            return f"^{_glob(body)}/?$"
        return f"^{re.escape(body)}(?:/.*)?$"


def _glob(pattern: str) -> str:
    parts = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(meaning.get(p) or re.escape(p) for p in parts)


def parse(lines: list[str], base: str = "") -> list[Rule]:
    """The rules of an ignore file; blank lines and comments are none."""
    trimmed = (x.strip() for x in lines)
    return [Rule(x, base) for x in trimmed if x and not x.startswith("#")]


def decided(path: Column, is_folder, rules: Sequence[Rule]) -> Column:
    """What the last matching rule says of the path itself: ignored or not."""
    is_folder = F.lit(is_folder) if isinstance(is_folder, bool) else is_folder
    if len(rules) > EXPRESSION:
        return _by_patterns(path, is_folder, rules, (), above=False)
    verdict = None
    for rule in reversed(rules):  # the first branch that holds is the last rule that matches
        below = path if not rule.base else F.substring(path, len(rule.base) + 2, 1 << 30)
        hit = F.concat(below, F.when(is_folder, "/").otherwise("")).rlike(rule.regex)
        if rule.base:
            hit = hit & path.startswith(rule.base + "/")
        if rule.folders_only:
            hit = hit & is_folder
        verdict = (F if verdict is None else verdict).when(hit, not rule.negated)
    return F.lit(False) if verdict is None else verdict.otherwise(False)


class Patterns:
    """A rule list as alternations, last rule first, of bounded size: the first alternative that matches decides."""

    def __init__(self, rules: Sequence[Rule], exempt: tuple[str, ...], size: int = 200):
        self.exempt = frozenset(exempt)
        last_first = rules[::-1]
        self.negated = [[r.negated for r in last_first[k : k + size]] for k in range(0, len(rules), size)]
        self.compiled = [re.compile("|".join(f"({self._pattern(r)})" for r in last_first[k : k + size]), re.S) for k in range(0, len(rules), size)]
        self.of_folder = lru_cache(1 << 16)(self._of_folder)  # folders come again for each of their files

    @staticmethod
    def _pattern(rule: Rule) -> str:
        """The rule over a whole path, a slash after folders; groups inside do not capture."""
        body = rule.regex.removeprefix("^").removesuffix("$")
        below = f"{re.escape(rule.base)}/" if rule.base else ""
        return f"{below}{body}(?<=/)" if rule.folders_only else f"{below}{body}"

    def decided(self, path: str, is_folder: bool) -> bool:
        whole = path + "/" if is_folder else path
        for negated, compiled in zip(self.negated, self.compiled):
            found = compiled.fullmatch(whole)
            if found:
                return not negated[found.lastindex - 1]
        return False

    def _of_folder(self, path: str) -> bool:
        """Whether a folder or one above it is ignored."""
        above, _, name = path.rpartition("/")
        return name not in self.exempt and self.decided(path, True) or bool(above) and self.of_folder(above)

    def ignored(self, path: str, is_folder: bool) -> bool:
        above, _, name = path.rpartition("/")
        return name not in self.exempt and (self.decided(path, is_folder) or bool(above) and self.of_folder(above))


@lru_cache(8)
def _patterns(rules: tuple[Rule, ...], exempt: tuple[str, ...]) -> Patterns:
    return Patterns(list(rules), exempt)


def _by_patterns(path: Column, is_folder: Column, rules: Sequence[Rule], exempt: tuple[str, ...], above: bool) -> Column:
    held = tuple(rules)

    @F.pandas_udf("boolean")
    def verdict(paths: pd.Series, folders: pd.Series) -> pd.Series:
        patterns = _patterns(held, exempt)
        decide = patterns.ignored if above else patterns.decided
        none = None if above else False  # as the expressions have it
        return pd.Series([none if p is None else decide(p, bool(f)) for p, f in zip(paths, folders)], dtype=object)

    return verdict(path, is_folder)


def ancestors(path: Column) -> Column:
    """All folders above a relative path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored(path: Column, is_folder, rules: Sequence[Rule], exempt: tuple[str, ...] = ()) -> Column:
    """The verdict on a path relative to the root; one that leaves the root is ignored."""
    outside = path.startswith("../") | path.startswith("/")
    if len(rules) > EXPRESSION:
        return _by_patterns(path, F.lit(is_folder) if isinstance(is_folder, bool) else is_folder, rules, exempt, above=True) | outside
    name = lambda p: F.regexp_extract(p, "[^/]*$", 0)
    above = F.exists(ancestors(path), lambda d: ~name(d).isin(*exempt) & decided(d, True, rules) if exempt else decided(d, True, rules))
    verdict = above | decided(path, is_folder, rules)
    if exempt:
        verdict = ~name(path).isin(*exempt) & verdict
    return verdict | outside


def without_nested_repositories(paths: DataFrame, repositories: DataFrame) -> DataFrame:
    """paths (column path) that are neither one of the repository folders (column root) nor below one."""
    keyed = paths.withColumn("_row", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))))
    inside = keyed.join(repositories.select(F.col("root").alias("_row")), "_row", "left_semi").select("path").distinct()
    return paths.join(inside, "path", "left_anti")


def always_skipped(path: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether a part of the path is a folder that never holds sources. own: names of the calling tool's state folders."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, (*ALWAYS_SKIP, *own))))


def is_source(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(SOURCE_SUFFIXES)})$")


def watched(path: Column, rules: Sequence[Rule], state_folder: str | None = None) -> Column:
    """Whether a changed path matters: inside the root, no repository data, no logs of the tool's state folder, not ignored."""
    unwanted = ignored(path, False, rules) | F.array_contains(F.split(path, "/"), ".git")
    if state_folder:
        unwanted = unwanted | F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{state_folder}/logs/")
    return ~unwanted
