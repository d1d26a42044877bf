from factloom.sources import signatures

SOURCES = [
    ("w/U.scala", "package p\n\n/** Holds {@code things}. */\nobject Depot {\n  /** Gets <b>it</b>. */\n  def fetch(n: Int,\n    m: String): String = m\n  def next = 1\n}\n"),
    ("w/J.java", "package p;\n/** A class. */\n@Deprecated\npublic class J<T> extends Base {\n\n\n  int far;\n  /** Runs. */\n  public void run(int a) throws E { }\n}\n"),
]


def test_hovers(spark):
    sources = spark.createDataFrame(SOURCES, "path string, content string")
    declared, commented = signatures.declarations(sources), signatures.comments(sources)
    wanted = spark.createDataFrame([(1, 0, "none/X#"), (1, 1, "p/Depot.fetch()."), (2, 0, "p/Depot."), (3, 0, "p/J#"), (4, 0, "p/J#run()."), (5, 0, "p/J#far."), (6, 0, "p/Depot.next()."), (7, 0, "none/Y#")], "query_id long, ord int, symbol string")
    got = {r.query_id: r for r in signatures.hovers(wanted, declared, commented).collect()}
    assert got[1].markdown == "```\ndef fetch(n: Int, m: String): String\n```\n\nGets it."
    assert got[2].markdown == "```\nobject Depot\n```\n\nHolds things."
    assert got[3].markdown == "```\npublic class J<T> extends Base\n```\n\nA class."
    assert got[4].markdown == "```\npublic void run(int a) throws E\n```\n\nRuns."
    assert got[5].markdown == "```\nint far\n```" and got[6].markdown == "```\ndef next\n```" and 7 not in got


def test_a_comment_may_be_taken_from_the_declaration_before(spark):
    source = [("w/T.scala", "object A {\n  /** first */\n  val a = 1\n  val b = 2\n}")]
    sources = spark.createDataFrame(source, "path string, content string")
    wanted = spark.createDataFrame([(1, 0, "_empty_/A.a."), (2, 0, "_empty_/A.b.")], "query_id long, ord int, symbol string")
    declared, commented = signatures.declarations(sources), signatures.comments(sources)
    loose = {r.query_id: r.markdown for r in signatures.hovers(wanted, declared, commented).collect()}
    strict = {r.query_id: r.markdown for r in signatures.hovers(wanted, declared, commented, strict=True).collect()}
    assert loose[2].endswith("first") and loose[1] == strict[1] and strict[2] == "```\nval b\n```"
