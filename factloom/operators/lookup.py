"""Lookups as joins: positions, keys, prefixes, candidates, ancestors, fallbacks.

Every operator takes batches of questions. Equality keys come first, so that joins shuffle on
them; range conditions are residuals. First-hit rules are explicit order columns. Definitions may
carry the columns owner_name and index (`with_overload_columns`), which are else derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols as S


#: The greatest overload index that a name alone is looked up with.
OVERLOADS = 9
#: Lines of a position's cells, by level; beyond the last, a whole file is a cell.
CELLS = (64, 8192)
#: Rows of a bridge, about, whose pairs a task makes.
PART = 1 << 18
#: Archives of a classpath, at most, that travel as one row.
CARRIED = 32


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that moves both sides by key.

    Spark guesses the size of composed columns by that of the file they come from, which is far too
    small: a table as long as the input would be broadcast through the driver.
    """
    return df.hint("merge")


def contains(line, ch) -> Column:
    """Whether (line, ch) lies in the row's half-open range."""
    after = (F.col("start_line") < line) | ((F.col("start_line") == line) & (F.col("start_char") <= ch))
    before = (F.col("end_line") > line) | ((F.col("end_line") == line) & (F.col("end_char") > ch))
    return after & before


def range_length() -> Column:
    lines = (F.col("end_line") - F.col("start_line")).cast("long")
    return lines * 100_000 + (F.col("end_char") - F.col("start_char"))


def is_zero_range() -> Column:
    return (F.col("start_line") == 0) & (F.col("start_char") == 0) & (F.col("end_line") == 0) & (F.col("end_char") == 0)


def stab(cursors: DataFrame, ranges: DataFrame) -> DataFrame:
    """All ranges of the cursor's path that hold its position. cursors: query_id, path, line, ch.

    A range is a row of the smallest cell of lines that holds it whole, a cursor one of each cell
    that it lies in. So a path with very many cursors and ranges is spread over its cells.
    """
    levels = len(CELLS)
    whole = F.struct(F.lit(levels).alias("_level"), F.lit(0).cast("long").alias("_cell"))
    cell = lambda k, line: F.struct(F.lit(k).alias("_level"), F.floor(line / CELLS[k]).cast("long").alias("_cell"))
    home = whole
    for k in reversed(range(levels)):
        home = F.when(F.floor(F.col("start_line") / CELLS[k]) == F.floor(F.col("end_line") / CELLS[k]), cell(k, F.col("start_line"))).otherwise(home)
    held = ranges.withColumn("_home", home).select(*ranges.columns, "_home._level", "_home._cell")
    asked = cursors.select(*cursors.columns, F.inline(F.array(*[cell(k, F.col("line")) for k in range(levels)], whole)))
    return asked.join(held, ["path", "_level", "_cell"]).filter(contains(F.col("line"), F.col("ch"))).drop("_level", "_cell")


def narrowest(stabbed: DataFrame) -> DataFrame:
    """The narrowest ranges of each query, ties included."""
    best = Window.partitionBy("query_id").orderBy("_length")
    return stabbed.withColumn("_length", range_length()).withColumn("_rank", F.rank().over(best)).filter("_rank = 1").drop("_length", "_rank")


def local_then_global(wanted: DataFrame, local: DataFrame, everywhere: DataFrame) -> DataFrame:
    """query_id, found: local definitions of (path, symbol); if a query has any, no global ones of symbol.

    wanted: query_id, path, symbol; local: path, symbol, found; everywhere: symbol, found.
    """
    near = wanted.join(local, ["path", "symbol"]).select("query_id", "found", F.lit(0).alias("tier"))
    far = wanted.join(everywhere, "symbol").select("query_id", "found", F.lit(1).alias("tier"))
    tier = F.min("tier").over(Window.partitionBy("query_id"))
    return near.union(far).withColumn("_best", tier).filter("tier = _best").select("query_id", "found").distinct()


def goto(cursors: DataFrame, occurrences: DataFrame, local: DataFrame, definitions: DataFrame) -> DataFrame:
    """query_id and the definitions (path and range) that the references at its cursor mean.

    Local definitions of the path come before all others. Left out are definitions without a place
    (all zero) and those that the cursor stands in, so a definition does not lead to itself.
    """
    place = ["start_line", "start_char", "end_line", "end_char"]
    wanted = stab(cursors, occurrences.filter("symbol is not null")).select("query_id", "path", "symbol")
    found = F.struct("path", *place).alias("found")
    hits = local_then_global(wanted, local.select("path", "symbol", found), definitions.select("symbol", found))
    out = hits.select("query_id", "found.*").filter(~is_zero_range())
    asked = cursors.select("query_id", F.col("path").alias("_path"), "line", "ch")
    own = (F.col("path") == F.col("_path")) & contains(F.col("line"), F.col("ch"))
    return out.join(asked, "query_id").filter(~own).select("query_id", "path", *place)


def first_of(wanted: DataFrame, *tiers: DataFrame, key: str = "symbol") -> DataFrame:
    """wanted with found: from the first tier (key, found) that knows the key."""
    out = wanted
    for k, tier in enumerate(tiers):
        out = out.join(tier.select(key, F.col("found").alias(f"_found{k}")), key, "left")
    found = [f"_found{k}" for k in range(len(tiers))]
    return out.withColumn("found", F.coalesce(*found)).drop(*found)


def parts_of(*tables: DataFrame) -> int:
    """Into how many parts tables are dealt, so that what a task sorts of them is bounded."""
    spark = tables[0].sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, *[-(-t.count() // PART) for t in tables])


def first_candidate(wanted: DataFrame, bridge: DataFrame, definitions: DataFrame, key: tuple[str, ...] = ("query_id",), parts: int | None = None) -> DataFrame:
    """The hit in the first archive, in bridge order, of the query's target that defines the symbol.

    wanted: target_id, symbol, package and the columns of `key`, which tell queries apart; bridge:
    target_id, ord, fingerprint, packages (null: unknown, so never skipped); definitions: fingerprint,
    symbol, path, dealt by symbol into `parts`, if given.

    Questions go to their target, and a short classpath travels with them to their symbol, as one row.
    There they stay: pairs and definitions meet by a sort in each part, and are moved no more.
    """
    n = parts or parts_of(wanted, bridge)
    named = list(dict.fromkeys([*key, "symbol"]))
    held = definitions.select("symbol", "fingerprint", "path").filter("symbol is not null and fingerprint is not null")
    held = held if parts else held.repartition(n, "symbol")
    asked = wanted.select(*dict.fromkeys([*named, "target_id", "package"])).filter("target_id is not null and symbol is not null").repartition(n, "target_id")
    listed = bridge.select("target_id", "ord", "fingerprint", "packages").filter("target_id is not null and fingerprint is not null").repartition(n, "target_id")
    open_to = lambda packages: packages.isNull() | F.array_contains(packages, F.col("package"))

    counted = listed.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy("target_id")))
    short = counted.filter(F.col("_length") <= CARRIED).groupBy("target_id").agg(F.collect_list(F.struct("ord", "fingerprint", "packages")).alias("_classpath"))
    members = F.transform(F.filter("_classpath", lambda m: open_to(m["packages"])), lambda m: F.struct(m["ord"].alias("ord"), m["fingerprint"].alias("fingerprint")))
    carried = asked.join(short.hint("shuffle_hash"), "target_id").select(*named, members.alias("_open")).repartition(n, "symbol")
    pairs = carried.select(*named, F.inline("_open"))

    # of the rest, a symbol may be defined in many archives, a classpath may have many: each question takes the shorter list
    long = bridge.filter("fingerprint is not null").groupBy("target_id").agg(F.count(F.lit(1)).alias("_length")).filter(F.col("_length") > CARRIED).repartition(n, "target_id")
    sized = asked.join(shuffled(long), "target_id").repartition(n, "symbol").join(shuffled(held.groupBy("symbol").agg(F.count(F.lit(1)).alias("_archives"))), "symbol")
    listed = listed.join(shuffled(long.select("target_id")), "target_id")
    rare = sized.filter("_archives <= _length").join(shuffled(held), "symbol").join(listed, ["target_id", "fingerprint"]).filter(open_to(F.col("packages")))
    common = sized.filter("_archives > _length").join(listed, "target_id").filter(open_to(F.col("packages")))

    hit = F.struct("ord", "fingerprint", "path").alias("_hit")
    met = pairs.union(common.select(pairs.columns).repartition(n, "symbol")).withColumn("_asked", F.lit(True))
    met = met.unionByName(held.select("symbol", "fingerprint", F.struct("path").alias("_held")), allowMissingColumns=True)
    met = met.withColumn("_held", F.min("_held").over(Window.partitionBy("symbol", "fingerprint"))).filter("_asked and _held is not null")
    hits = met.select(*named, "ord", "fingerprint", "_held.path").select(*named, hit).union(rare.select(*named, hit).repartition(n, "symbol"))
    return hits.groupBy(*key).agg(F.min("_hit").alias("hit")).select(*key, "hit.ord", "hit.fingerprint", "hit.path")


def prefix_scan(definitions: DataFrame, prefix: str, most: int = 32) -> DataFrame:
    """The first `most` symbols with the prefix, in byte order."""
    return definitions.filter(F.col("symbol").startswith(prefix)).orderBy("symbol").limit(most)


def prefix_scans(prefixes: DataFrame, definitions: DataFrame, length: int, most: int = 32) -> DataFrame:
    """prefix_scan for many prefixes, joined on their first `length` characters, or on all that they have."""
    cut = F.least(F.length("prefix"), F.lit(length))
    lengths = [r.k for r in prefixes.select(cut.alias("k")).filter("k is not null").distinct().collect()]  # at most `length` + 1 numbers
    keys = F.array(*[F.struct(F.lit(k).alias("_k"), F.left("symbol", F.lit(k)).alias("_key")) for k in sorted(lengths)]) if lengths else F.expr("array_repeat(named_struct('_k', 0, '_key', ''), 0)")
    keyed = definitions.select(*definitions.columns, F.inline(keys))
    asked = prefixes.withColumn("_k", cut).withColumn("_key", F.left("prefix", F.col("_k")))
    hits = asked.join(keyed, ["_k", "_key"]).filter(F.col("symbol").startswith(F.col("prefix")))
    order = Window.partitionBy("query_id").orderBy("symbol")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("_k", "_key")


def with_overload_columns(definitions: DataFrame) -> DataFrame:
    """definitions with owner_name (what all overloads of a method share; null for others) and index."""
    if {"owner_name", "index"} <= set(definitions.columns):
        return definitions
    return definitions.withColumns({"owner_name": F.nullif(S.method_base("symbol"), F.lit("")), "index": S.overload_index("symbol")})


def with_overload_fallback(wanted: DataFrame, definitions: DataFrame, documented: bool = False) -> DataFrame:
    """query_id, symbol, found: the exact definition, else for methods the first of their name.

    Both sides meet on what all overloads of a method share, or else on the symbol itself, so one
    pass over the definitions answers both questions.
    """
    held = with_overload_columns(definitions).groupBy(F.coalesce("owner_name", "symbol").alias("_key"), F.col("owner_name").isNull().alias("_exact"))
    held = held.agg(F.collect_set("symbol").alias("_all"), F.min("symbol").alias("_first"))  # a method's overloads
    base = F.nullif(S.method_base("symbol"), F.lit(""))
    asked = wanted.select("query_id", "symbol", F.coalesce(base, "symbol").alias("_key"), base.isNull().alias("_exact"))
    found = F.when(F.array_contains("_all", F.col("symbol")), F.col("symbol")).when(S.is_method("symbol", documented), F.col("_first"))
    return asked.join(held, ["_key", "_exact"], "left").select("query_id", "symbol", found.alias("found"))


def first_overload(definitions: DataFrame, most: int = OVERLOADS) -> DataFrame:
    """owner_name, index, symbol: the smallest overload index of each method, of those up to `most`."""
    keyed = with_overload_columns(definitions).filter((F.col("index") <= most) & F.col("owner_name").isNotNull())
    return keyed.groupBy("owner_name").agg(F.min(F.struct("index", "symbol")).alias("m")).select("owner_name", "m.*")


def by_owner_and_name(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """wanted (query_id, owner, short_name) with the symbols of that owner and name."""
    keyed = definitions.select(S.owner_prefix("symbol").alias("owner"), "short_name", "symbol")
    return wanted.join(shuffled(keyed), ["owner", "short_name"])


def wrapped_member(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """As by_owner_and_name, but only members of a file wrapper; the smallest symbol of each query."""
    hits = by_owner_and_name(wanted, definitions).filter(F.col("symbol").rlike(r"\$package\."))
    return hits.groupBy("query_id").agg(F.min("symbol").alias("symbol"))


def references(wanted: DataFrame, occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """query_id and places of the wanted symbols: occurrences, and declarations where asked for.

    wanted: query_id, symbol, include_decl. Null symbols match nothing. Locals match in their own
    path only: give wanted the path, null for globals.
    """
    place = ["path", "start_line", "start_char", "end_line", "end_char"]
    named = wanted.withColumnRenamed("path", "_path") if "path" in wanted.columns else wanted.withColumn("_path", F.lit(None).cast("string"))
    own = ~S.is_local("symbol") | F.col("_path").eqNullSafe(F.col("path"))
    uses = named.join(occurrences.select("symbol", *place), "symbol").filter(own).select("query_id", *place)
    declared = named.filter("include_decl").join(definitions.select("symbol", *place), "symbol").filter(own).select("query_id", *place)
    return uses.union(declared).distinct()


def gap_merge(authoritative: DataFrame, fallback: DataFrame, keys: tuple[str, ...] = ("path", "start_line", "start_char")) -> DataFrame:
    """All authoritative rows, and fallback rows where those have none at the same start."""
    return authoritative.unionByName(fallback.join(authoritative.select(*keys).distinct(), list(keys), "left_anti"))


def unshadowed(candidates: DataFrame, bindings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Candidates whose name no binding takes."""
    return candidates.join(bindings.select(*keys).distinct(), list(keys), "left_anti")


def resolve_scopes(candidates: DataFrame, definitions: DataFrame) -> DataFrame:
    """query_id, symbol: of ranked candidate symbols, the first that is defined (ties: the smaller)."""
    known = candidates.join(definitions.select("symbol").distinct(), "symbol", "left_semi")
    return known.groupBy("query_id").agg(F.min(F.struct("rank", "symbol")).alias("m")).select("query_id", "m.symbol")


def path_ancestors(path: Column) -> Column:
    """(depth, prefix) of a path's own and every higher folder; depth 1 is the topmost."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")))


def nearest_ancestor(paths: DataFrame, folders: DataFrame, path: str = "path", tie: str = "id") -> DataFrame:
    """path with the deepest folder (prefix, id) at or above it; of equal ones, the smallest id."""
    steps = paths.select(path).distinct().select(path, F.inline(path_ancestors(F.col(path))))
    hits = steps.join(folders, "prefix").groupBy(path).agg(F.min(F.struct((-F.col("depth")).alias("up"), F.col(tie).alias(tie), "prefix")).alias("m"))
    return hits.select(path, f"m.{tie}", "m.prefix")


def all_ancestors(paths: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """path with every folder (prefix, ...) at or above it."""
    return paths.select(path).distinct().select(path, F.inline(path_ancestors(F.col(path)))).join(folders, "prefix")


def archive_classpath(archives: DataFrame, bridge: DataFrame) -> DataFrame:
    """For each archive, itself and all archives of its targets: owning first, then by (target, ord), each once.

    archives: fingerprint; bridge: target_id, ord, fingerprint. Result: fingerprint, pos, member.
    A target's archives are gathered once, with their first places, so the bridge is shuffled once, in
    parts so small that the pairs of each are united in memory. Rows without a target belong to none.
    """
    own = archives.select("fingerprint").distinct().withColumn("own", F.lit(True))
    parts = max(bridge.sparkSession.sparkContext.defaultParallelism, -(-bridge.count() // PART))
    held = bridge.filter("target_id is not null").select("target_id", "ord", "fingerprint").join(own, "fingerprint", "left").repartition(parts, "target_id")
    first = held.groupBy("target_id", "fingerprint").agg(F.min("ord").alias("ord"), F.max("own").alias("own"))
    per_target = first.groupBy("target_id").agg(F.collect_list(F.struct("fingerprint", "ord", "own")).alias("members"))  # as long as a classpath
    owners = per_target.select("target_id", "members", F.explode(F.filter("members", lambda m: m["own"])["fingerprint"]).alias("fingerprint"))
    pairs = owners.select("fingerprint", "target_id", F.explode("members").alias("m")).select("fingerprint", F.col("m.fingerprint").alias("member"), "target_id", "m.ord")
    # numbers, no struct: so the least place is kept in a table of hashes, and nothing is sorted for it
    first = pairs.groupBy("fingerprint", "member").agg(F.min("target_id").alias("target_id"), F.min_by("ord", "target_id").alias("ord"))
    order = Window.partitionBy("fingerprint").orderBy((F.col("member") != F.col("fingerprint")).cast("int"), "target_id", "ord", "member")
    return first.withColumn("pos", F.row_number().over(order)).select("fingerprint", "pos", "member")


def resolve_uris(facts: DataFrame, files: DataFrame, root: str, stop: str) -> DataFrame:
    """facts_path, path: the source that a facts file's uri names, of those that are there.

    facts: facts_path, uri; files: path. `root` comes first, then the folders above the facts file
    from the nearest up to `stop`.
    """
    folders = F.filter(path_ancestors(F.regexp_replace("facts_path", "/[^/]*$", "")), lambda a: (a["prefix"] == stop) | a["prefix"].startswith(stop + "/"))
    climb = F.transform(folders, lambda a: F.struct((-a["depth"]).alias("rank"), a["prefix"].alias("folder")))
    nowhere = F.struct(F.lit(-1_000_000).alias("rank"), F.lit(root).alias("folder"))
    tried = facts.filter("uri <> ''").select("facts_path", F.regexp_replace("uri", "^/", "").alias("_uri"), F.inline(F.array_append(climb, nowhere)))
    hits = tried.select("facts_path", "rank", F.concat_ws("/", "folder", "_uri").alias("path")).join(shuffled(files.select("path")), "path", "left_semi")
    return hits.groupBy("facts_path").agg(F.min_by("path", "rank").alias("path"))


def parameter_of(arguments: DataFrame, definitions: DataFrame) -> DataFrame:
    """Named arguments (query_id, method, name) with the parameter symbols that are defined."""
    keyed = arguments.withColumn("symbol", S.parameter_symbol(F.col("method"), F.col("name")))
    return keyed.join(definitions.select("symbol"), "symbol", "left_semi").select("query_id", "symbol")


def first_success(ordered: DataFrame, value: str, group: str = "query_id", order: str = "ord") -> DataFrame:
    """group, value: the value of the first row, by order, where it is not null."""
    return ordered.filter(F.col(value).isNotNull()).groupBy(group).agg(F.min_by(value, order).alias(value))


def bounded_asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, end: str, within: int, value: str) -> DataFrame:
    """left with the value of the greatest right `end` in [at - within, at], on equal keys; null without one.

    Both sides are bucketed by `within`, so each row meets two buckets and not all of its key.
    """
    w = F.lit(within)
    asked = left.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col(at) / w), F.floor((F.col(at) - w) / w)))))
    held = right.select(*keys, F.col(end).alias("_end"), F.col(value).alias("_value"), F.floor(F.col(end) / w).alias("_b"))
    hits = asked.join(held, [*keys, "_b"]).filter((F.col("_end") <= F.col(at)) & (F.col("_end") >= F.col(at) - w))
    best = hits.groupBy(*left.columns).agg(F.max(F.struct("_end", "_value")).alias("_m"))
    best = best.select(*[F.col(c).alias(f"_k_{c}") for c in left.columns], F.col("_m._value").alias(value))
    same = F.lit(True)
    for c in left.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return left.join(best, same, "left").select(*left.columns, value)


def tiered(groups: DataFrame, tiers: list[DataFrame], key: str, value: str) -> DataFrame:
    """key with the values (array) of the first tier that has any for it."""
    out = groups
    for k, tier in enumerate(tiers):
        out = out.join(tier.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(f"_t{k}")), key, "left")
    return out.withColumn(value + "s", F.coalesce(*[f"_t{k}" for k in range(len(tiers))])).drop(*[f"_t{k}" for k in range(len(tiers))])


def overridden(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with non-null override values; rows whose override is disabled go."""
    renamed = overrides.select(key, F.col("disabled").alias("_off"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(renamed, key, "left").filter(~F.coalesce("_off", F.lit(False)))
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_off", *[f"_{c}" for c in columns])


def declaration_at(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """query_id, symbol: of the declarations on the wanted line, the one of the name, else the one at the column.

    wanted: query_id, path, line, ch, name; declared: path, symbol, short_name and ranges.
    """
    same = wanted.join(declared, (wanted["path"] == declared["path"]) & (wanted["line"] == declared["start_line"]))
    inside = (F.col("start_char") <= F.col("ch")) & ((F.col("end_line") > F.col("start_line")) | (F.col("ch") < F.col("end_char")))
    tier = F.when(F.col("short_name") == F.col("name"), 0).when(inside, 1)
    hits = same.withColumn("tier", tier).filter("tier is not null")
    return hits.groupBy("query_id").agg(F.min(F.struct("tier", "start_char", "symbol")).alias("m")).select("query_id", "m.symbol")
