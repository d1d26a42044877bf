"""Source trees listed by executors, round by round, without what is ignored.

A round lists the folders that the round before found, over all cores; a folder that a rule or its
name excludes is never listed, however large it is. Ignore files on the way add their rules for
what lies below them: later lines and deeper files win. Files are read where they are listed from,
through Arrow's file systems, so nothing passes the driver but the number of folders left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ignore
from ..tables import written

IGNORE_FILE = ".gitignore"
_LISTED = "path string, relative string, is_folder boolean, rules string"


@lru_cache(64)
def _patterns(rules: str, exempt: tuple[str, ...]) -> ignore.Patterns:
    return ignore.Patterns([ignore.Rule(*r) for r in json.loads(rules)], exempt)


def _listed(skip: frozenset[str], exempt: tuple[str, ...], suffixes: tuple[str, ...]):
    """Entries of folders (path, relative, rules) that no rule ignores, folders with the rules that hold below them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, relative, rules in zip(batch["path"], batch["relative"], batch["rules"]):
                system, inside = fs.FileSystem.from_uri(path)
                entries = sorted(system.get_file_info(fs.FileSelector(inside)), key=lambda e: e.base_name)
                own = next((e for e in entries if e.base_name == IGNORE_FILE and e.type == fs.FileType.File), None)
                if own is not None:
                    lines = system.open_input_stream(own.path).read().decode("utf-8", "replace").splitlines()
                    rules = json.dumps(json.loads(rules) + [[r.pattern, r.base] for r in ignore.parse(lines, relative)])
                decide = _patterns(rules, exempt)
                nested = bool(relative) and any(e.base_name == ".git" for e in entries)
                for e in () if nested else entries:  # a repository of its own is none of this one's
                    folder = e.type == fs.FileType.Directory
                    name = f"{relative}/{e.base_name}".lstrip("/")
                    if folder and e.base_name in skip or not folder and not e.base_name.lower().endswith(suffixes):
                        continue
                    if e.base_name in exempt or not decide.decided(name, folder):
                        rows.append((f"{path.rstrip('/')}/{e.base_name}", name, folder, rules if folder else None))
            yield pd.DataFrame(rows, columns=["path", "relative", "is_folder", "rules"])

    return run


def walk(spark: SparkSession, root: str, rules: Sequence[ignore.Rule] = (), own: tuple[str, ...] = (), exempt: tuple[str, ...] = (), suffixes: tuple[str, ...] = ignore.SOURCE_SUFFIXES) -> DataFrame:
    """path, relative, is_folder of all folders and source files below root (a URI) that are not ignored.

    rules: hold before those of ignore files; own: names of the calling tool's state folders;
    exempt: names that no rule ignores.
    """
    step = _listed(frozenset((*ignore.ALWAYS_SKIP, *own)) - set(exempt), exempt, tuple("." + s for s in suffixes))
    level = spark.createDataFrame([(root if "://" in root else f"file://{root}", "", json.dumps([[r.pattern, r.base] for r in rules]))], "path string, relative string, rules string")
    found = None
    while not level.isEmpty():
        spread = level.repartition(spark.sparkContext.defaultParallelism, "path")
        listed = written(spread.mapInPandas(step, _LISTED), "walk")
        found = listed if found is None else found.union(listed)
        level = listed.filter("is_folder").select("path", "relative", "rules")
    return found.select("path", "relative", "is_folder")


def texts(files: DataFrame) -> DataFrame:
    """path, content of the files among walked entries; a file that can't be read any more has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, inside = fs.FileSystem.from_uri(path)
                try:
                    content = system.open_input_stream(inside).read().decode("utf-8", "replace")
                except OSError:
                    content = None
                yield pd.DataFrame([(path, content)], columns=["path", "content"])

    return files.filter("not is_folder").select("path").mapInPandas(run, "path string, content string")
