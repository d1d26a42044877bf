"""Column layouts of the fact tables. Positions are 0-based, ends exclusive."""

RANGE = "start_line int, start_char int, end_line int, end_char int"
DEFINITIONS = f"symbol string, short_name string, is_type boolean, {RANGE}, path string"
OCCURRENCES = f"path string, symbol string, {RANGE}"  # a null symbol is unresolved
LOCALS = f"path string, symbol string, short_name string, is_type boolean, {RANGE}"
FACTS = f"facts_path string, doc_idx int, uri string, occ_idx int, symbol string, role string, {RANGE}"
ARCHIVES = "fingerprint string, source_path string, size bigint, mtime bigint, packages array<string>, indexed boolean, format_version int"
TARGET_ARCHIVES = "target_id string, ord int, source_path string, fingerprint string"
CURSORS = "query_id bigint, path string, line int, ch int"
EVENTS = "ts timestamp, kind string, path string, target_id string"
DIAGNOSTICS = f"uri string, target_id string, conn_id string, seq bigint, reset boolean, severity string, message string, source string, {RANGE}"
SOURCES = "path string, content string"
RANGE_COLUMNS = ("start_line", "start_char", "end_line", "end_char")
