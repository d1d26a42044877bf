"""Comments, messages, options and ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import _col

# Severities of build diagnostics, and what others count as.
SEVERITIES = {"1": "Error", "2": "Warning", "3": "Information", "4": "Hint"}
DEFAULT_SEVERITY = "Error"
#: Lines that a declaration may span, and characters of a signature.
DECLARATION_LINES, SIGNATURE = 10, 120


def strip_html(text) -> Column:
    return F.regexp_replace(_col(text), "<[^>]+>", "")


def collapse_blank_lines(text) -> Column:
    return F.regexp_replace(_col(text), r"\n{3,}", "\n\n")


def unwrap_links(text) -> Column:
    """{@code x} and {@literal x} to x; {@link A#b label} and {@value ...} to the label or the last name."""
    text = F.regexp_replace(_col(text), r"\{@(?:code|literal)\s+([^}]*)\}", "$1")
    text = F.regexp_replace(text, r"\{@(?:link|value)\s+[^\s}]+\s+([^}\s](?:[^}]*[^}\s])?)\s*\}", "$1")
    return F.regexp_replace(text, r"\{@(?:link|value)\s+(?:[^\s}]*[#.])?([^\s}#.]+)\s*\}", "$1")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _bare_doc(raw) -> Column:
    """A doc comment without its fences and leading stars."""
    body = _trim(F.regexp_replace(F.regexp_replace(_trim(_col(raw)), r"^/\*\*", ""), r"\*/$", ""))
    return F.regexp_replace(body, r"(?m)^[\x00-\x09\x0B-\x20]*\* ?(.*)$", "$1")


def javadoc(raw) -> Column:
    """A Java doc comment: the description as it stands, then a paragraph with a line for each block tag."""
    body = _bare_doc(raw)
    description = _trim(F.regexp_extract(body, r"(?sm)\A(.*?)(?:^[ \t]*@\w|\z)", 1))
    tags = _trim(F.regexp_extract(body, r"(?sm)\A.*?(^[ \t]*@\w.*)\z", 1))
    tags = F.regexp_replace(F.regexp_replace(tags, r"\s*\n\s*(?=@\w)", "\n"), r"(?m)^(@\w+)[ \t]+(\S+)[ \t]*", "$1 $2 ")
    tags = F.regexp_replace(tags, r"(?m)[ \t]+$", "")
    return F.concat_ws("\n\n", F.nullif(description, F.lit("")), F.nullif(tags, F.lit("")))


def clean_doc(raw) -> Column:
    """A doc comment as plain text: no fences, no leading stars, no inline tags or HTML."""
    body = _bare_doc(raw)
    body = collapse_blank_lines(strip_html(unwrap_links(body)))
    return _trim(F.regexp_replace(body, r"(?m)[ \t\r\f]+$", ""))


def strip_ansi(text) -> Column:
    return F.regexp_replace(_col(text), "\x1b\\[[0-9;]*[A-Za-z]", "")


def severity(code) -> Column:
    pairs = [F.lit(x) for kv in SEVERITIES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[_col(code).cast("string")], F.lit(DEFAULT_SEVERITY))


def normalize_uri(uri) -> Column:
    """file:/x and file:///x are one; jar: and what follows !/ go."""
    uri = F.regexp_replace(F.regexp_replace(_col(uri), "^jar:", ""), "!/.*$", "")
    return F.regexp_replace(uri, "^file:/+", "file:///")


def uri_path(uri) -> Column:
    return F.try_url_decode(F.replace(F.regexp_replace(normalize_uri(uri), "^file://", ""), F.lit("+"), F.lit("%2B")))


def signature_text(text) -> Column:
    return F.when(F.length(_col(text)) > SIGNATURE, F.concat(F.left(_col(text), F.lit(SIGNATURE - 3)), F.lit("..."))).otherwise(_col(text))


def exclusive_range(begin_line, begin_column, end_line, end_column) -> list[Column]:
    """1-based inclusive positions as 0-based, end-exclusive ones."""
    parts = (_col(begin_line) - 1, _col(begin_column) - 1, _col(end_line) - 1, _col(end_column))
    return [p.cast("int").alias(n) for p, n in zip(parts, ("start_line", "start_char", "end_line", "end_char"))]


def option_value(options, flag: str, legacy: str) -> Column:
    """First value of `flag v` (v no flag), else of `flag:v`, else of `legacy:v`, in an array of options."""
    options = _col(options)
    spaced = F.transform(options, lambda o, i: F.when(o == flag, F.try_element_at(options, i + 2)))
    values = [F.filter(spaced, lambda v: v.isNotNull() & ~v.startswith("-"))]
    for prefix in (f"{flag}:", f"{legacy}:"):
        values.append(F.transform(_starting(options, prefix), _dropper(len(prefix))))
    return F.try_element_at(F.concat(*values), F.lit(1))


def _starting(options: Column, prefix: str) -> Column:
    return F.filter(options, lambda o: o.startswith(prefix))


def _dropper(n: int):
    return lambda o: F.substring(o, n + 1, 1 << 30)


def declaration(lines, start) -> Column:
    """From line `start` on, up to the first line where all brackets are closed, in at most ten lines."""
    part = F.slice(_col(lines), _col(start) + 1, DECLARATION_LINES)

    def step(state: Column, line: Column) -> Column:
        depth = state["depth"] + _count(line, "([{") - _count(line, ")]}")
        return F.when(state["closed"], state).otherwise(
            F.struct(F.concat(state["text"], F.when(state["text"] == "", "").otherwise("\n"), line).alias("text"), depth.alias("depth"), (depth <= 0).alias("closed"))
        )

    first = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("closed"))
    return F.aggregate(part, first, step)["text"]


def _count(line: Column, members: str) -> Column:
    return F.length(line) - F.length(F.translate(line, members, ""))


def markdown(signature, doc) -> Column:
    code = F.concat(F.lit("```\n"), _col(signature), F.lit("\n```"))
    return F.when(F.coalesce(_col(doc), F.lit("")) == "", code).otherwise(F.concat(code, F.lit("\n\n"), _col(doc)))


def percent(done, total) -> Column:
    return F.when(_col(total) > 0, F.floor(_col(done) * 100 / _col(total)).cast("int")).otherwise(F.lit(0))


def first_hex(text, n: int = 8, algorithm: str = "sha1") -> Column:
    digest = F.sha1(_col(text)) if algorithm == "sha1" else F.sha2(_col(text), 256)
    return F.substring(digest, 1, n)


def maven_parts(name) -> list[Column]:
    """artifact and version of `<artifact>-<version>`, the version from the last dash before a digit."""
    return [F.regexp_extract(_col(name), r"^(.+)-(\d.*)$", k).alias(c) for k, c in ((1, "artifact"), (2, "version"))]


def fingerprint(jar_path, group=None) -> Column:
    """Cache folder of an archive: `[group/]artifact_version_hash`."""
    path = _col(jar_path)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"-sources\.jar$", ""), r"\.jar$", "")
    name = F.concat(F.regexp_replace(bare, r"^(.+)-(\d.*)$", "$1_$2"), F.lit("_"), first_hex(path))
    if group is None:
        return name
    return F.when(F.coalesce(_col(group), F.lit("")) == "", name).otherwise(F.concat(F.replace(_col(group), F.lit("."), F.lit("_")), F.lit("/"), name))
