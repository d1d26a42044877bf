import re

from factloom import schemas
from factloom.operators import lookup, merge


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_a_cursor_finds_its_definition(spark):
    """Two files: an object with a documented method, and a call of it."""
    definitions = spark.createDataFrame(
        [("sea/Tide.", "Tide", False, 0, 7, 0, 12, "Tide.scala"), ("sea/Tide.level().", "level", False, 1, 6, 1, 12, "Tide.scala"), ("sea/tides$package.", "tides$package", False, 0, 0, 0, 0, "Tide.scala")], schemas.DEFINITIONS
    )
    occurrences = spark.createDataFrame([("Boat.scala", "sea/Tide.", 2, 12, 2, 15), ("Boat.scala", "sea/Tide.level().", 2, 16, 2, 22), ("Boat.scala", None, 3, 0, 3, 5)], schemas.OCCURRENCES)
    cursors = spark.createDataFrame([(1, "Boat.scala", 2, 16), (2, "Boat.scala", 2, 15), (3, "Boat.scala", 2, 14), (4, "Boat.scala", 3, 1), (5, "Dock.scala", 2, 16)], schemas.CURSORS)
    hits = lookup.stab(cursors, occurrences).select("query_id", "symbol")
    found = hits.join(definitions.filter(~lookup.is_zero_range()), "symbol").select("query_id", "path", "start_line")
    assert rows(found) == [(1, "Tide.scala", 1), (3, "Tide.scala", 0)]


def test_ranges_are_half_open_over_lines(spark):
    ranges = spark.createDataFrame([("f", "a", 1, 5, 3, 2), ("f", "b", 2, 0, 2, 9), ("f", "c", 2, 0, 2, 9)], schemas.OCCURRENCES)
    cursors = spark.createDataFrame([(i, "f", line, ch) for i, (line, ch) in enumerate([(1, 4), (1, 5), (2, 4), (3, 1), (3, 2)])], schemas.CURSORS)
    assert rows(lookup.stab(cursors, ranges).select("query_id", "symbol")) == [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "a")]
    assert rows(lookup.narrowest(lookup.stab(cursors, ranges)).filter("query_id = 2").select("symbol")) == [("b",), ("c",)]


def test_local_hits_suppress_global_ones(spark):
    wanted = spark.createDataFrame([(1, "f", "s"), (1, "f", "g"), (2, "h", "s")], "query_id long, path string, symbol string")
    local = spark.createDataFrame([("f", "s", "here")], "path string, symbol string, found string")
    everywhere = spark.createDataFrame([("s", "there"), ("g", "global")], "symbol string, found string")
    assert rows(lookup.local_then_global(wanted, local, everywhere)) == [(1, "here"), (2, "there")]


def test_candidates_in_order_and_by_package(spark):
    bridge = spark.createDataFrame([("t", 0, "A", ["p"]), ("t", 1, "B", ["q", "p"]), ("t", 2, "C", None)], "target_id string, ord int, fingerprint string, packages array<string>")
    definitions = spark.createDataFrame([("B", "p/X#", "b"), ("C", "p/X#", "c"), ("A", "q/Y#", "hidden by its package list"), ("C", "q/Y#", "y")], "fingerprint string, symbol string, path string")
    wanted = spark.createDataFrame([(1, "t", "p/X#", "p"), (2, "t", "q/Y#", "q"), (3, "other", "p/X#", "p")], "query_id long, target_id string, symbol string, package string")
    assert rows(lookup.first_candidate(wanted, bridge, definitions)) == [(1, 1, "B", "b"), (2, 2, "C", "y")]


def test_prefixes_and_overloads(spark):
    definitions = spark.createDataFrame([("pkg/Foo.pure().",), ("pkg/Foo.pure(+1).",), ("pkg/Foo.pureEffect().",), ("pkg/Foo.f(+9).",), ("pkg/Foo.g(+10).",)], "symbol string")
    assert {r.symbol for r in lookup.prefix_scan(definitions, "pkg/Foo.pure(").collect()} == {"pkg/Foo.pure().", "pkg/Foo.pure(+1)."}
    assert rows(lookup.first_overload(definitions)) == [("pkg/Foo.f(", 9, "pkg/Foo.f(+9)."), ("pkg/Foo.pure(", 0, "pkg/Foo.pure()."), ("pkg/Foo.pureEffect(", 0, "pkg/Foo.pureEffect().")]
    wanted = spark.createDataFrame([(1, "pkg/Foo.pure(+7)."), (2, "pkg/Foo.f()."), (3, "pkg/Foo.pure().")], "query_id long, symbol string")
    assert rows(lookup.with_overload_fallback(wanted, definitions).select("query_id", "found")) == [(1, "pkg/Foo.pure()."), (2, None), (3, "pkg/Foo.pure().")]
    assert rows(lookup.with_overload_fallback(wanted, definitions, documented=True).select("query_id", "found"))[1] == (2, "pkg/Foo.f(+9).")


def test_locals_and_nulls_in_references(spark):
    uses = spark.createDataFrame([("a", "local0", 1, 0, 1, 2), ("b", "local0", 1, 0, 1, 2), ("a", None, 5, 0, 5, 1), ("b", "p/X#", 2, 0, 2, 1)], schemas.OCCURRENCES)
    declared = spark.createDataFrame([("p/X#", "X", True, 0, 0, 0, 1, "c"), ("local0", "l", False, 0, 3, 0, 4, "a")], schemas.DEFINITIONS)
    wanted = spark.createDataFrame([(1, "local0", "a", True), (2, None, "a", True), (3, "p/X#", None, False), (4, "p/X#", None, True)], "query_id long, symbol string, path string, include_decl boolean")
    assert rows(lookup.references(wanted, uses, declared).select("query_id", "path", "start_line")) == [(1, "a", 0), (1, "a", 1), (3, "b", 2), (4, "b", 2), (4, "c", 0)]


def test_bounded_asof_takes_the_nearest_before(spark):
    left = spark.createDataFrame([(1, "f", 10), (2, "f", 7), (3, "g", 10), (4, None, 10)], "q long, path string, line long")
    right = spark.createDataFrame([("f", 8, "near"), ("f", 9, "nearer"), ("f", 4, "far"), ("f", 11, "after")], "path string, end long, doc string")
    assert rows(lookup.bounded_asof(left, right, ["path"], "line", "end", 2, "doc")) == [(1, "f", 10, "nearer"), (2, "f", 7, None), (3, "g", 10, None), (4, None, 10, None)]


def test_tiers_overrides_and_parameters(spark):
    groups = spark.createDataFrame([("u",), ("v",), ("w",)], "uri string")
    first = spark.createDataFrame([("u", "t2"), ("u", "t1")], "uri string, target string")
    second = spark.createDataFrame([("u", "x"), ("v", "t3")], "uri string, target string")
    assert rows(lookup.tiered(groups, [first, second], "uri", "target")) == [("u", ["t1", "t2"]), ("v", ["t3"]), ("w", None)]
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "id string, command string, n int")
    over = spark.createDataFrame([("a", False, None, 9), ("b", True, None, None)], "id string, disabled boolean, command string, n int")
    assert rows(lookup.overridden(base, over, "id", ["command", "n"])) == [("a", "x", 9), ("c", "z", 3)]
    arguments = spark.createDataFrame([(1, "p/F.f().", "x"), (2, "p/F.f().", "no")], "query_id long, method string, name string")
    assert rows(lookup.parameter_of(arguments, spark.createDataFrame([("p/F.f().(x)",)], "symbol string"))) == [(1, "p/F.f().(x)")]


def test_scopes_by_rank(spark):
    candidates = spark.createDataFrame([(1, 2, "a/X#"), (1, 1, "b/X#"), (1, 0, "c/X#"), (2, 0, "c/X#")], "query_id long, rank int, symbol string")
    definitions = spark.createDataFrame([("a/X#",), ("b/X#",)], "symbol string")
    assert rows(lookup.resolve_scopes(candidates, definitions)) == [(1, "b/X#")]


def test_symbols_have_one_owner(spark):
    adds = spark.createDataFrame([("_empty_/X#", 1, "A"), ("_empty_/X#", 2, "B")], "symbol string, seq long, path string")
    table = merge.last_write(adds, ["symbol"], ["seq"], ["path"])
    assert rows(table) == [("_empty_/X#", "B")]
    assert rows(merge.drop_path(table, "B")) == [] and rows(merge.drop_path(table, "A")) == [("_empty_/X#", "B")]


def test_nested_folders_and_changes(spark):
    folders = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",)], "prefix string")
    assert rows(merge.top_level_only(folders)) == [("a",), ("ab",), ("c/d",)]
    old = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "path string, stamp int")
    new = spark.createDataFrame([("y", 2), ("w", 1), ("z", None)], "path string, stamp int")
    assert rows(merge.classify_changes(old, new, "path", "stamp")) == [("w", "new"), ("x", "deleted"), ("y", "modified")]
    assert rows(merge.stale(old, new, ["path"], ["stamp"]).select("path")) == [("w",), ("y",)]


def test_declarations_by_name_then_column(spark):
    declared = spark.createDataFrame([("p/A#", "A", True, 1, 6, 1, 7, "f"), ("p/A#b.", "b", False, 1, 10, 1, 11, "f"), ("p/C#", "C", True, 2, 0, 2, 1, "f")], schemas.DEFINITIONS)
    wanted = spark.createDataFrame([(1, "f", 1, 6, "b"), (2, "f", 1, 6, "x"), (3, "f", 1, 8, "x"), (4, "g", 1, 6, "A")], "query_id long, path string, line int, ch int, name string")
    assert rows(lookup.declaration_at(wanted, declared)) == [(1, "p/A#b."), (2, "p/A#")]


def test_positions_over_cells(spark):
    spans = [("f", "short", 63, 0, 64, 5), ("f", "line", 64, 0, 64, 9), ("f", "far", 0, 0, 9000, 0), ("f", "block", 100, 0, 400, 0), ("g", "line", 64, 0, 64, 9)]
    ranges = spark.createDataFrame(spans, schemas.OCCURRENCES)
    cursors = spark.createDataFrame([(i, "f", line, 3) for i, line in enumerate((63, 64, 399, 8999, 9000))], schemas.CURSORS)
    assert rows(lookup.stab(cursors, ranges).select("query_id", "symbol")) == [(0, "far"), (0, "short"), (1, "far"), (1, "line"), (1, "short"), (2, "block"), (2, "far"), (3, "far")]


def test_goto_leaves_out_itself_and_what_has_no_place(spark):
    definitions = spark.createDataFrame([("p/A#", "A", True, 0, 6, 0, 7, "a"), ("p/w$package.", "w", False, 0, 0, 0, 0, "a"), ("p/rec().", "rec", False, 3, 4, 3, 7, "b"), ("local0", "l", False, 9, 9, 9, 10, "z")], schemas.DEFINITIONS)
    local = spark.createDataFrame([("b", "local0", "l", False, 5, 4, 5, 5)], schemas.LOCALS)
    uses = spark.createDataFrame([("b", "p/A#", 1, 0, 1, 1), ("b", "p/w$package.", 1, 2, 1, 3), ("b", "p/rec().", 3, 4, 3, 7), ("b", "local0", 6, 0, 6, 1), ("b", "p/A#", 6, 0, 6, 1), ("b", None, 7, 0, 7, 1)], schemas.OCCURRENCES)
    cursors = spark.createDataFrame([(1, "b", 1, 0), (2, "b", 1, 2), (3, "b", 3, 5), (4, "b", 6, 0), (5, "b", 7, 0), (6, "a", 0, 6)], schemas.CURSORS)
    assert rows(lookup.goto(cursors, uses, local, definitions)) == [(1, "a", 0, 6, 0, 7), (4, "b", 5, 4, 5, 5)]


def test_prefixes_of_any_length(spark):
    definitions = spark.createDataFrame([(s,) for s in ("a/B#", "a/Bc#", "ab/C.", "b/D#", "")], "symbol string")
    prefixes = spark.createDataFrame([(1, "a/B"), (2, "a"), (3, ""), (4, "a/B#x"), (5, None), (6, "a/Bc#")], "query_id long, prefix string")
    got = rows(lookup.prefix_scans(prefixes, definitions, 3, most=3).select("query_id", "symbol"))
    assert got == [(1, "a/B#"), (1, "a/Bc#"), (2, "a/B#"), (2, "a/Bc#"), (2, "ab/C."), (3, ""), (3, "a/B#"), (3, "a/Bc#"), (6, "a/Bc#")]
    assert lookup.prefix_scans(prefixes.limit(0), definitions, 3).collect() == []


def test_fallback_keeps_other_shapes_apart(spark):
    definitions = spark.createDataFrame([("p/F.f(+1).",), ("p/F.f(",), ("p/F.",)], "symbol string")
    wanted = spark.createDataFrame([(1, "p/F.f(+2)."), (2, "p/F."), (3, "p/F.f("), (4, "p/G."), (5, None)], "query_id long, symbol string")
    assert rows(lookup.with_overload_fallback(wanted, definitions).select("query_id", "found")) == [(1, "p/F.f(+1)."), (2, "p/F."), (3, "p/F.f("), (4, None), (5, None)]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_climb_for_uris_broadcasts_nothing(spark):
    """Both sides are as long as the input, whatever its file's size lets Spark guess."""
    facts = spark.range(9).selectExpr("concat('/w/a/out/F', id, '.semanticdb') as facts_path", "concat('F', id) as uri")
    files = spark.range(9).selectExpr("concat('/w/a/F', id) as path").union(spark.createDataFrame([("/w/a/F3",)], "path string"))
    found = lookup.resolve_uris(facts, files, "/none", "/w")
    assert "Broadcast" not in plan(found)
    assert rows(found) == [(f"/w/a/out/F{k}.semanticdb", f"/w/a/F{k}") for k in range(9)]


def test_lookups_by_owner_and_name_broadcast_nothing(spark):
    definitions = spark.range(9).selectExpr("concat('a/F', id, '.') as symbol", "concat('F', id) as short_name")
    wanted = spark.range(9).selectExpr("id as query_id", "'a/' as owner", "concat('F', id) as short_name")
    found = lookup.by_owner_and_name(wanted, definitions)
    assert "Broadcast" not in plan(found)
    assert rows(found.select("query_id", "symbol")) == [(k, f"a/F{k}.") for k in range(9)]


def test_questions_of_many_candidates_meet_each_candidate_once(spark, tmp_path):
    """Parts of one brand and type are one question; what is grouped does not grow with the parts."""
    from factloom.plans import registry

    parts = spark.range(400).selectExpr("id as p_partkey", "concat('B', id % 4) as p_brand", "concat('T', id % 2) as p_type", "cast(id % 20 as int) as p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    found = registry.scope_resolution(spark, str(tmp_path))
    listed = plan(found)
    assert "HashAggregate(keys=[p_brand" in listed
    assert rows(found.select("query_id", "symbol")) == rows(parts.filter("p_size >= 0").selectExpr("p_partkey", "concat(p_brand, '/', p_type)"))


def test_the_first_candidate_takes_the_shorter_list(spark):
    """A symbol of very many archives is asked from short classpaths, and one of few from a long one."""
    held = spark.range(300).selectExpr("concat('f', id) as fingerprint", "'common' as symbol", "concat('p', id) as path").union(spark.createDataFrame([("f7", "rare", "r7"), ("f9", "rare", "r9")], "fingerprint string, symbol string, path string"))
    bridge = spark.range(300).selectExpr("'long' as target_id", "cast(300 - id as int) as ord", "concat('f', id) as fingerprint", "cast(null as array<string>) as packages")
    bridge = bridge.union(spark.createDataFrame([("short", 2, "f5", ["a"]), ("short", 1, "f6", ["b"])], bridge.schema))
    wanted = spark.createDataFrame([(1, "long", "rare", "a"), (2, "short", "common", "a"), (3, "short", "rare", "a"), (4, "short", "common", "c"), (5, "long", "common", "z")], "query_id long, target_id string, symbol string, package string")
    found = lookup.first_candidate(wanted, bridge, held)
    assert rows(found) == [(1, 291, "f9", "r9"), (2, 2, "f5", "p5"), (5, 1, "f299", "p299")]
    assert "_archives" in plan(found) and "_length" in plan(found)


def test_classpaths_of_any_length_give_the_same_first_candidates(spark, monkeypatch):
    """Short classpaths travel with questions, of long ones and a symbol's archives the shorter list is taken: against plain loops."""
    import random

    dice = random.Random(7)
    bridge = [(t, dice.choice([None, 0, 1, 2, 3]), dice.choice([None, "f1", "f2", "f3", "f4", ""]), dice.choice([None, [], ["a"], ["a", None, "b"]])) for t in ["t1", "t2", "t3", "t4", None] for _ in range(dice.randrange(1, 7))]
    held = [(dice.choice([None, "", "f1", "f2", "f3", "f4"]), dice.choice([None, "x", "y", "z"]), dice.choice([None, "p", "q"])) for _ in range(14)]
    wanted = [(q, dice.choice([None, "t1", "t2", "t3", "t4", "t5"]), dice.choice([None, "x", "y", "z", "w"]), dice.choice([None, "a", "b", "c"])) for q in range(60)] * 2
    least = lambda hit: tuple((v is not None, v if v is not None else 0) for v in hit)
    want = {}
    for q, target, symbol, package in wanted:
        for t, ord_, fingerprint, packages in bridge:
            for f, s, path in held:
                if None not in (target, symbol, fingerprint) and (t, f, s) == (target, fingerprint, symbol) and (packages is None or package is not None and package in packages):
                    want[q] = min(want.get(q, (ord_, fingerprint, path)), (ord_, fingerprint, path), key=least)
    tables = [spark.createDataFrame(wanted, "query_id long, target_id string, symbol string, package string"), spark.createDataFrame(bridge, "target_id string, ord int, fingerprint string, packages array<string>"), spark.createDataFrame(held, "fingerprint string, symbol string, path string")]
    for carried in (0, 2, 32):
        monkeypatch.setattr(lookup, "CARRIED", carried, raising=False)
        assert {r.query_id: tuple(r)[1:] for r in lookup.first_candidate(*tables).collect()} == want and len(want) > 9


def test_first_hits_move_neither_pairs_nor_hits(spark, tmp_path):
    """What is moved by key is a question or a definition, never each pair of a question and an archive."""
    from factloom.plans import registry

    spark.range(900).selectExpr("id div 5 as l_orderkey", "id * 7 % 40 as l_partkey", "id * 11 % 23 as l_suppkey", "cast(id % 4 as int) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).selectExpr("id as p_partkey", "concat('n', id) as p_name", "900d + id as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(23).selectExpr("id as s_suppkey", "800d + 10 * id as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = plan(registry.first_hit(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"Exchange hashpartitioning\(([^\n]*), \d+\)", listed)
    keys = {re.sub(r"#\d+L?", "", m) for m in moved}
    assert "symbol" in keys and "target_id" in keys
    assert not keys & {"symbol, fingerprint", "query_id", "target_id, symbol"}


def test_classpaths_keep_least_places_without_a_sort(spark):
    rows = [(None, 0, 1), (None, 1, 2), (1, 0, 2), (1, 1, 1), (1, 2, 3), (1, 3, 3), (2, 0, 3), (2, 1, 4), (3, 0, 5)]
    bridge = spark.createDataFrame(rows, "target_id long, ord int, fingerprint long")
    found = lookup.archive_classpath(spark.createDataFrame([(1,), (1,), (3,)], "fingerprint long"), bridge)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (3, 1, 3), (3, 2, 2), (3, 3, 1), (3, 4, 4)]
    found = lookup.archive_classpath(spark.createDataFrame([(6,)], "fingerprint long"), spark.createDataFrame([(None, 0, 6)], "target_id long, ord int, fingerprint long"))
    assert found.collect() == [] and "SortAggregate" not in found._jdf.queryExecution().toString()
