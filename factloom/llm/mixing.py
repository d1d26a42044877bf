"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A source's words are laid out as shards: seeded, ordered streams of its documents. Targets say
how many equal-token blocks the mix takes in all; blocks go to sources, and within a source to
its shards (by way of bundles of them), by the highest quotients weight / (2k + 1). A shard takes its quota as whole passes
over its blocks plus a run of blocks from a seeded one on, so a document is taken at most `limit`
times, and all but a few documents are taken whole.

Defined results: null text counts as empty (size 0, taken 0); a null source is a source and
sorts last; a source without a word has target 0 and gets no block, and so have all sources of
a table without words; identical rows are separate documents, share a seat and share results as
a multiset; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .textarrays import set_aside

#: Shards of a source that share their quota out among themselves.
BUNDLE = 1024
#: Sources (about 50 bytes each) up to which their targets are broadcast; beyond, they are joined by shuffle.
SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def token_counts(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, size: the number of words of each whole text; _at: its seeded place, which texts of one id don't share."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), seeded(seed, F.col("doc_id"), size, F.col("text")).alias("_at"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """source, source_size, source_rows, target: the total shared by weight, no target over limit x its size.

    The shares at which sources reach their limits are found in closed form: in the order of
    limit / weight, running sums tell the common share per weight that is left after each.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighted = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = weighted.withColumn("cap", F.col("source_size") * limit).withColumn("share", share)
    # the first source, in filling order, that stays below its limit fixes the share of the rest
    free = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * free["share"])
    return filled.select("source", "source_size", "source_rows", target.alias("target"))


def apportion(parts: DataFrame, group: list[Column], weight: str, seats: Column, ties: list[Column]) -> DataFrame:
    """parts with `quota`: the seats of each group, given to its parts by highest quotients.

    A part's exact share is q = weight * seats / W. By Sainte-Laguë it gets at least
    q - (1 + n q / seats) / 2 of n parts, so that many are given at once and only the
    few quotients around the margin are ranked: about four a part.
    """
    whole = Window.partitionBy(*group)
    fraction = F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(whole)), F.lit(0.0))  # 0: no part has any weight
    slack = F.ceil(fraction * F.count(F.lit(1)).over(whole) / 2 + 1)
    sure = F.greatest(F.lit(0).cast("long"), F.floor(fraction * seats - slack).cast("long"))
    based = parts.withColumn("_seats", seats).withColumn("_sure", F.when(F.col(weight) > 0, sure).otherwise(F.lit(0).cast("long"))).withColumn("_slack", slack)
    based = based.withColumn("_left", F.col("_seats") - F.sum("_sure").over(whole)).withColumn("_part", F.struct(*ties))
    nth = based.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + F.col("_slack") * 2 + 2)))
    quotient = F.col(weight) / (2 * F.col("_k") + 1)
    ranked = nth.withColumn("_rank", F.row_number().over(whole.orderBy(quotient.desc(), *ties, "_k")))
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col(weight) > 0), 1).otherwise(0))
    keep = [F.first(c, ignorenulls=False).alias(c) for c in parts.columns]
    return ranked.groupBy(*[c.alias(f"_group{i}") for i, c in enumerate(group)], "_part").agg(*keep, (F.first("_sure") + won).alias("quota")).select(*parts.columns, "quota")


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2 ** 32 that only the seed and the parts decide."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block: int = 16, shard_words: int = 1 << 18, shard_rows: int = 1 << 16, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, pieces: what the mix takes of each document.

    passes: whole repeats; pieces: word ranges [from, to) taken once more. block: words in a
    block; shard_words and shard_rows: about how many words and rows a shard of a source has at
    most, which bounds what one task sorts, of texts without words, too.
    """
    sizes = materialize(token_counts(docs, seed), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, limit), "mix-targets")
    targets = F.broadcast(targets) if targets.count() <= SOURCES else targets  # a shuffle by source would be as uneven as the sources
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)).cast("long")
    placed = (
        sizes.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .join(targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"), "source_size", "source_rows", "target"), "_source")
        .withColumn("shard", F.col("_at") % shards_of)
    )
    shard_sizes = placed.groupBy("_source", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    # blocks of the whole mix to sources, then each source's blocks to its shards
    sources = shard_sizes.groupBy("_source").agg(F.first("target").alias("target"))
    total = F.sum("target").over(Window.partitionBy())
    sources = apportion(sources, [], "target", F.round(total / block).cast("long"), [F.col("_source")])
    # by way of bundles of shards, so that no window holds more parts than a bundle or a source has
    source, bundle = F.col("_source"), F.col("bundle")
    sized = shard_sizes.drop("target").withColumn("bundle", F.floor(F.col("shard") / BUNDLE).cast("long"))
    bundles = sized.groupBy("_source", "bundle").agg(F.sum("words").alias("words"))
    bundles = bundles.join(sources.select("_source", F.col("quota").alias("source_quota")), "_source")
    bundles = apportion(bundles, [source], "words", F.col("source_quota"), [bundle])
    shards = sized.join(bundles.select("_source", "bundle", F.col("quota").alias("bundle_quota")), ["_source", "bundle"])
    shards = apportion(shards, [source, bundle], "words", F.col("bundle_quota"), [F.col("shard")])
    taken_words = F.least(F.col("quota") * block, F.col("words") * limit)
    shards = shards.select("_source", "shard", "words", taken_words.alias("quota_words"))
    # whole passes, and the words that blocks chosen by seed add to them
    shards = shards.withColumn("passes", F.when(F.col("words") > 0, F.expr("quota_words div words")).otherwise(F.lit(0).cast("long")))
    shards = shards.withColumn("extra", F.round((F.col("quota_words") - F.col("passes") * F.col("words")) / block).cast("long"))
    # the extra blocks stand next to each other from a seeded one on, round the stream's end: so few documents are cut
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long")
    begin = seeded(seed + 1, F.col("_source"), F.col("shard")) % n_blocks
    shards = shards.withColumn("_begin", begin * block).withColumn("_end", (begin + F.col("extra")) * block).withColumn("_round", n_blocks * block)
    shards = shards.select("_source", "shard", "passes", "_begin", "_end", "_round")
    stream = Window.partitionBy("_source", "shard").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_to", F.sum("size").over(stream)).join(shards, ["_source", "shard"])
    start = F.col("_to") - F.col("size")

    def within(low: Column, high: Column) -> Column:
        return F.struct((F.greatest(low, start) - start).alias("from"), (F.least(high, F.col("_to")) - start).alias("to"))

    both = F.array(within(F.lit(0).cast("long"), F.col("_end") - F.col("_round")), within(F.col("_begin"), F.least(F.col("_end"), F.col("_round"))))
    pieces = F.filter(both, lambda p: p["to"] > p["from"])
    whole = F.exists("pieces", lambda p: p["to"] - p["from"] == F.col("size"))
    cut = laid.withColumn("pieces", pieces)
    cut = cut.withColumn("passes", F.when(whole, F.col("passes") + 1).otherwise(F.col("passes"))).withColumn("pieces", F.when(whole, F.slice("pieces", 1, 0)).otherwise(F.col("pieces")))
    return cut.select("doc_id", "source", "size", "source_size", "target", "passes", "pieces")


def taken_words() -> Column:
    """Words that a row of `plan` takes, repeats counted."""
    return F.col("passes") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"])


def apply_plan(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The mix itself: each document once for every pass, and its pieces as documents of their own.

    Documents with equal doc_id and equal size share their plans in a repeatable order.
    """
    planned = materialize(planned.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "passes", "pieces"), "mix-plan")
    docs, restored = set_aside(docs, "doc_id", "text", "source", "n_chars")
    docs_sized = docs.withColumn("_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size"))
    if planned.groupBy("_id", "_size").count().filter("count > 1").isEmpty():
        both = docs_sized.join(planned.hint("shuffle_hash"), same)
    else:
        planned = planned.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_size").orderBy("passes", F.col("pieces").cast("string"))))
        numbered = docs_sized.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "_words").orderBy("text", "source")))
        both = numbered.join(planned.hint("shuffle_hash"), same & (F.col("_row") == F.col("_nth")))
    whole = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    part = F.transform("pieces", lambda p: F.array_join(F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), ""))
    mixed = both.withColumn("text", F.explode(F.when(F.size("pieces") > 0, F.concat(whole, part)).otherwise(whole)))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return restored(mixed)
