"""Source trees, archives and configuration files as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import ignore, lookup
from ..operators.ignore import SOURCE_SUFFIXES
from . import java, scala
from .lexer import Tokens

#: Definitions that a worker gathers before it hands them on.
ROWS = 4096
#: Bytes of an archive that one task may unpack; entries stream, so this bounds the archive alone.
ENTRY = "archive string, entry string, content string, error string"


def source_files(spark: SparkSession, root: str, rules: Sequence[ignore.Rule] = (), own: tuple[str, ...] = ()) -> DataFrame:
    """path, content of the source files below root that no rule ignores and that stand in no folder that never holds sources.

    Names decide while files are listed, so ignored contents are never read. own: names of the
    calling tool's state folders; a rule list of over `ignore.EXPRESSION` rules decides after reading.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SOURCE_SUFFIXES) + "}").load(root)
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    relative = F.substring(F.regexp_replace(name, r"^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), len(base) + 2, 1 << 30)
    wanted = ~(ignore.always_skipped(relative, own) | ignore.ignored(relative, False, rules))
    return files.filter(wanted).select("path", F.decode("content", "UTF-8").alias("content"))


def extract_definitions(sources: DataFrame) -> DataFrame:
    """Definitions of all sources (path, content); texts that are null define nothing."""
    return sources.select("path", "content").mapInPandas(definition_frames, schemas.DEFINITIONS)


def definition_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Definitions of the texts, in frames of about ROWS: a batch may hold many thousand texts."""
    names = [c.split()[0] for c in schemas.DEFINITIONS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch["path"], batch["content"]):
            file_name = path.rpartition("/")[2]
            if content is None:
                continue
            found = java.definitions(content) if file_name.endswith(".java") else scala.definitions(content, file_name)
            rows += [(symbol, name, is_type, *at, path) for symbol, name, is_type, at in found.rows]
            if len(rows) >= ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def extraction_errors(sources: DataFrame) -> DataFrame:
    """path, error of texts that the extractors see only in part: brackets stay open, or a scan fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    left_open = Tokens(content, java=path.endswith(".java")).open_brackets if content is not None else 0
                    if left_open:
                        rows.append((path, f"{left_open} brackets stay open"))
                except Exception as e:
                    rows.append((path, str(e)))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return sources.select("path", "content").mapInPandas(run, "path string, error string")


def archive_entries(archives: DataFrame, suffixes: tuple[str, ...] = SOURCE_SUFFIXES, contents: bool = True) -> DataFrame:
    """archive, entry, content, error of the entries with the suffixes in zip archives (path, content as bytes).

    An entry that cannot be read has an error and no content; an archive that cannot be opened is
    one row with an error alone, for the caller to fail on.
    """
    ends = tuple(f".{s}" for s in suffixes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if not name.endswith(ends):
                                continue
                            try:
                                rows.append((path, name, z.read(name).decode() if contents else None, None))
                            except Exception as e:
                                rows.append((path, name, None, str(e)))
                            if len(rows) >= 500:
                                yield pd.DataFrame(rows, columns=["archive", "entry", "content", "error"])
                                rows = []
                except Exception as e:
                    rows = [(path, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "entry", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, ENTRY)


def _folder(entry: str) -> Column:
    return F.regexp_replace(F.regexp_extract(entry, "^(.*)/[^/]*$", 1), "/", ".")


def class_packages(entries: DataFrame) -> DataFrame:
    """archive, packages of compiled classes, without the root and META-INF."""
    rows = entries.filter(F.col("entry").endswith(".class")).withColumn("package", _folder("entry")).filter("package <> '' and not package like 'META-INF%'")
    return rows.groupBy("archive").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def source_packages(entries: DataFrame) -> DataFrame:
    """archive, packages of sources; in archives with a module declaration one folder down, the module folder goes."""
    modular = entries.groupBy("archive").agg(F.bool_or(F.col("entry").rlike("^[^/]+/module-info\\.java$")).alias("modular"))
    rows = entries.filter(F.col("entry").rlike(r"\.(java|scala)$")).join(modular, "archive")
    rows = rows.withColumn("entry", F.when(F.col("modular"), F.regexp_replace("entry", "^[^/]+/", "")).otherwise(F.col("entry")))
    rows = rows.withColumn("package", _folder("entry")).filter("package <> '' and not package like 'META-INF%'")
    return rows.groupBy("archive").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def archive_packages(source_archives: DataFrame, classes: DataFrame, sources: DataFrame) -> DataFrame:
    """archive, packages: those of the sibling with the classes, else those of the sources."""
    sibling = F.regexp_replace("archive", r"-sources\.jar$", ".jar")
    own = source_archives.select("archive", sibling.alias("_sibling"))
    near = classes.select(F.col("archive").alias("_sibling"), F.col("packages").alias("_classes"))
    return own.join(near, "_sibling", "left").join(sources, "archive", "left").select("archive", F.coalesce("_classes", "packages").alias("packages"))


def pom_groups(poms: DataFrame) -> DataFrame:
    """path, group of project files (path, content as text): the project's own group; null if only its parent has one."""
    own = F.try_element_at(F.xpath("content", F.lit("/*[local-name()='project']/*[local-name()='groupId']/text()")), F.lit(1))
    return poms.select("path", F.nullif(F.trim(own), F.lit("")).alias("group"))


def json_rows(files: DataFrame, schema: str) -> DataFrame:
    """path and the fields of JSON texts (path, content); missing and damaged files give no row."""
    parsed = files.select("path", F.from_json("content", f"{schema}, _damage string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damage"}).alias("j"))
    return parsed.filter("j is not null and j._damage is null").select("path", "j.*").drop("_damage")


def connection_files(paths: DataFrame, rules: Sequence[ignore.Rule] = (), most: int = 10) -> DataFrame:
    """path of `.bsp/*.json` files at most `most` folders down and in no ignored folder but `.bsp`, in order."""
    depth = F.size(F.split("path", "/")) - 1
    above = F.regexp_replace("path", r"(^|/)\.bsp/[^/]+$", "")
    open_folder = (above == "") | ~(ignore.ignored(above, True, rules, exempt=(".bsp",)) | ignore.always_skipped(above))
    return paths.filter(F.col("path").rlike(r"(^|/)\.bsp/[^/]+\.json$") & (depth <= most) & open_folder).orderBy("path")


def pair_by_convention(sources: DataFrame, facts: DataFrame, source_root: str, facts_root: str, stop: str) -> DataFrame:
    """path, facts_path: sources whose facts stand at the same place below the facts' root and speak of them.

    facts: facts_path, uri; a facts file whose uri names another source, or none, is not paired.
    """
    relative = F.substring(F.col("path"), len(source_root) + 2, 1 << 30)
    wanted = sources.filter(F.col("path").startswith(source_root + "/")).select("path", F.concat(F.lit(f"{facts_root}/META-INF/semanticdb/"), relative, F.lit(".semanticdb")).alias("facts_path"))
    named = lookup.resolve_uris(facts, sources, source_root, stop).select("facts_path", F.col("path").alias("_named"))
    return wanted.join(lookup.shuffled(named), "facts_path").filter("path = _named").select("path", "facts_path")


def last_pairing(pairs: DataFrame) -> DataFrame:
    """One facts file a source: of several, the one paired last (greatest seq)."""
    return pairs.groupBy("path").agg(F.max_by("facts_path", F.struct("seq", "facts_path")).alias("facts_path"))


def dump_pairs(pairs: DataFrame, root: str) -> DataFrame:
    """Pairs in the order of a dump: inside the root first, by path, then the rest."""
    return pairs.withColumn("outside", ~F.col("path").startswith(root + "/")).orderBy("outside", "path")


def dump_symbols(definitions: DataFrame) -> DataFrame:
    """line: the symbol, place and path of every definition, in the order of a dump."""
    place = F.format_string("%d:%d-%d:%d", *schemas.RANGE_COLUMNS)
    return definitions.orderBy("symbol", "path").select(F.concat_ws(" ", "symbol", place, "path").alias("line"))


def save_index(definitions: DataFrame, path: str) -> None:
    """Definitions by archive fingerprint, sorted by symbol for point and prefix lookups; locals are not stored.

    Files of a fingerprint are written aside and committed together, so readers see whole indexes.
    """
    kept = definitions.filter(~F.col("symbol").rlike(r"^local\d+(\+\d+)?$"))
    kept.repartitionByRange("fingerprint", "symbol").sortWithinPartitions("fingerprint", "symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(path)


def numbered_locals(rows: DataFrame) -> DataFrame:
    """rows (path, start_line, start_char, ...) with the symbol local<N>, numbered in file order."""
    order = Window.partitionBy("path").orderBy("start_line", "start_char")
    return rows.withColumn("symbol", F.concat(F.lit("local"), (F.row_number().over(order) - 1).cast("string")))
