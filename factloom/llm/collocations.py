"""Collocations: frequent phrases whose words come together more often than by chance.

Shards of texts become sequences of word numbers, with breaks where pieces end. A shard's suffix
array is built by prefix doubling to the depth wanted, in numpy; common prefixes of neighbours,
cut at breaks, form intervals, and an interval's size is the shard's count of a phrase. Counts of
all shards are merged by (language, phrase). Phrases can only be frequent where their words and
their pairs of words are, so it goes in three rounds, each exact and over the whole corpus:

1. words are counted; a shard puts breaks in the place of words that are rare in the corpus;
2. pairs are counted; a shard puts breaks between words whose pair is rare in the corpus;
3. phrases of three words and more are counted in what is left.

Most of what a shard counts is rare in the corpus. So before the phrases themselves, a shard sends
their hashes with their counts, packed, to as many parts as the corpus asks for; a part sums its
hashes and tells each shard which of them come to `least`. Phrases of equal hash only add to each
other, so no frequent one is lost; the phrases that are left are then counted as they are, by name.
No task and not the driver holds the corpus' words; a shard's own are bounded by its size.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count
each time; ties of scores go to the more frequent phrase, then by bytes; an empty table gives an
empty result; other columns are ignored. A single text is never cut, so it makes a shard alone if
it is longer than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, materialize
from .textarrays import mix, prefix_sums, slices, span_hashes

#: Words of a shard, about; words of a phrase at most; occurrences of one at least; phrases returned of a language.
SHARD, MOST, LEAST, TOP = 1 << 21, 5, 100, 2000
#: Bytes of text whose phrases' hashes make a part, about.
PART = 1 << 24
_BREAK = b"\xff"  # stands in no text

# What a text's bytes become: lower case, a break where a piece ends, a space between words.
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = _BREAK[0]
_TABLE = bytes(_TABLE)

#: A row is a shard's sequence (ids, its words' bytes and lengths, the languages and which is whose), the hashes (keys) or names of its phrases that go to a part, with
#: counts, or a count (n) of a language's words.
_FIELDS = [("shard", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("lengths", pa.binary()), ("of", pa.binary()), ("langs", pa.list_(pa.string())), ("part", pa.int64()), ("keys", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("lang", pa.string()), ("n", pa.int64())]
_ROW = pa.schema(_FIELDS)
_ROW_SQL = "shard long, ids binary, words binary, lengths binary, of binary, langs array<string>, part long, keys binary, names binary, counts binary, lang string, n long"


class _Numbers(dict):
    """Numbers of the words of one language in a shard; new words get the next number."""

    def __init__(self, all_words: list[bytes], langs: list[str], lang: str):
        super().__init__({_BREAK: 0})
        self.all_words, self.langs, self.lang = all_words, langs, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.all_words)
        self.all_words.append(word)
        self.langs.append(self.lang)
        return number


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text, with a break after each piece."""
    return (raw.translate(_TABLE) + _BREAK).replace(_BREAK, b" " + _BREAK + b" ").split()


def _columns(rows: int, **given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(name, pa.nulls(rows, kind)) for name, kind in _FIELDS], schema=_ROW)


_CODEC = pa.Codec("zstd", 1)


def pack(x: np.ndarray) -> bytes:
    """The numbers byte by byte, least bytes first, compressed: what is moved and stored is mostly small."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else x.view(np.uint8)
    return len(x).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def _sequence_row(shard: int, ids: np.ndarray, words: pa.Array, langs: pa.Array) -> pa.RecordBatch:
    words, known = words.slice(1).cast(pa.binary()), langs.dictionary_encode()
    lengths = pc.binary_length(words).to_numpy().astype(np.int32)
    given = {"ids": pack(ids.astype(np.int32)), "words": pack(np.frombuffer(b"".join(words.to_pylist()), np.uint8)), "lengths": pack(lengths), "of": pack(known.indices.to_numpy().astype(np.int32))}
    return _columns(1, shard=pa.array([shard], pa.int64()), langs=pa.array([known.dictionary.to_pylist()], pa.list_(pa.string())), **{c: pa.array([v], pa.binary()) for c, v in given.items()})


def _sequence(row: dict) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(ids, words, languages) of a shard; the first word is the break."""
    offsets = np.append(0, np.cumsum(unpack(row["lengths"], np.int32), dtype=np.int32)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(unpack(row["words"], np.uint8).tobytes())])
    langs = pa.array(row["langs"], pa.string()).take(pa.array(unpack(row["of"], np.int32)))
    return unpack(row["ids"], np.int32), pa.concat_arrays([pa.array([None], pa.string()), words]), langs


class Packed:
    """Hashes of a shard's phrases, cut to 24 bits, dealt to parts and sorted within each; `order` leads back to the phrases."""

    def __init__(self, hashes: np.ndarray, parts: int):
        self.part = (hashes % np.uint64(parts)).astype(np.int64)
        self.key = (hashes >> np.uint64(40)).astype(np.uint32)
        self.order = np.lexsort((self.key, self.part))
        dealt = self.part[self.order]
        self.begins = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])) if len(dealt) else np.zeros(0, np.int64)
        self.parts = dealt[self.begins]
        self.ends = np.append(self.begins[1:], len(dealt))

    def rows(self, shard: int, counts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        """What goes to each part. More than `least` in a shard is no more than that in the corpus."""
        kind = np.uint8 if least < 256 else np.uint32
        keys, counts = self.key[self.order], np.minimum(counts, least).astype(kind)[self.order]
        steps = np.diff(keys, prepend=keys[:1]).astype(np.uint32)
        steps[self.begins] = keys[self.begins]
        cut = lambda x: pa.array([pack(x[a:b]) for a, b in zip(self.begins, self.ends)], pa.binary())
        if len(self.parts):
            yield _columns(len(self.parts), shard=pa.array(np.full(len(self.parts), shard)), part=pa.array(self.parts), keys=cut(steps), counts=cut(counts))

    def named(self, which: np.ndarray, names: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The names of phrases `which`, with their counts, to each part; the lengths of names follow the counts."""
        place = np.full(len(self.order), -1, np.int64)
        place[which] = np.arange(len(which))
        dealt = self.order[place[self.order] >= 0]
        begins = np.flatnonzero(np.append(True, self.part[dealt][1:] != self.part[dealt][:-1])) if len(dealt) else np.zeros(0, np.int64)
        names, n = names.take(pa.array(place[dealt])), counts[place[dealt]].astype(np.int64)
        lengths = pc.binary_length(names).to_numpy().astype(np.int64)
        raw, upto = b"".join(names.to_pylist()), np.append(0, np.cumsum(lengths))
        rows = [(int(self.part[dealt[a]]), pack(np.frombuffer(raw[upto[a] : upto[b]], np.uint8)), pack(np.concatenate([n[a:b], lengths[a:b]]))) for a, b in zip(begins, np.append(begins[1:], len(dealt)))]
        if rows:
            part, blob, numbers = zip(*rows)
            yield _columns(len(rows), part=pa.array(part, pa.int64()), names=pa.array(blob, pa.binary()), counts=pa.array(numbers, pa.binary()))

    def frequent(self, told: pa.StructArray) -> np.ndarray:
        """Whether each phrase may be frequent, by what the parts have told (part, bits)."""
        out = np.zeros(len(self.order), bool)
        for part, bits in zip(told.field("part").to_pylist(), told.field("bits").to_pylist()):
            at = int(np.searchsorted(self.parts, part))
            a, b = self.begins[at], self.ends[at]
            out[self.order[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).view(bool)
        return out


_TOLD = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())])


def _part_rows(least: int):
    def run(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k, np.uint32), dtype=np.uint32) for k in rows.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint8 if least < 256 else np.uint32) for x in rows.column("counts").to_pylist()])
        which = np.unique(np.concatenate(keys), return_inverse=True)[1]
        enough = (np.bincount(which, counts) >= least)[which]
        out, at = [], 0
        for shard, part, k in zip(rows.column("shard").to_pylist(), rows.column("part").to_pylist(), keys):
            own = enough[at : at + len(k)]
            at += len(k)
            if own.any():
                out.append((shard, part, np.packbits(own).tobytes()))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_TOLD)], schema=_TOLD)

    return run


_NAMED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def _name_rows(least: int):
    """The phrases of a part that come to `least`, by name."""

    def run(rows: pa.Table) -> pa.Table:
        numbers = [unpack(x, np.int64).reshape(2, -1) for x in rows.column("counts").to_pylist()]
        n, lengths = np.concatenate(numbers, axis=1)
        offsets = np.append(0, np.cumsum(lengths))
        names = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(unpack(x, np.uint8).tobytes() for x in rows.column("names").to_pylist()))]).dictionary_encode()
        totals = np.zeros(len(names.dictionary), np.int64)
        np.add.at(totals, names.indices.to_numpy(), n)
        kept = np.flatnonzero(totals >= least)
        found = [name.decode().split("\t", 1) for name in names.dictionary.take(pa.array(kept)).to_pylist()]
        columns = [[x[1] for x in found], [x[0] for x in found], [x[0].count(" ") + 1 for x in found], totals[kept]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NAMED)], schema=_NAMED)

    return run


def word_hashes(words: list[bytes], langs: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word with its language, the same in every shard; the break's comes first and is 0."""

    def of(parts: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        return span_hashes(prefix_sums(data), ends - [len(p) for p in parts], ends)

    out = np.zeros(len(words) + 1, np.uint64)
    if words:
        names = sorted(set(langs))
        by_lang = dict(zip(names, mix(of(names) + np.uint64(1))))
        out[1:] = mix(of(words) ^ np.array([by_lang[x] for x in langs], np.uint64))
    return out


def phrase_hashes(words: np.ndarray, ids: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    out = np.full(len(starts), m, np.uint64)
    for t in range(m):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[ids[starts + t]])
    return out


def _encoded(words: pa.Array) -> list[bytes]:
    """The words but for the break."""
    return words.slice(1).cast(pa.binary()).to_pylist()


def _shard_rows(most: int, parts: int, least: int):
    """Shards of the texts: their sequences, the hashes of their words, and counts of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def anew():
            return [_BREAK], ["und"], {}, []

        def finished():
            ids = np.concatenate(seen)
            counts = np.bincount(ids, minlength=len(words))[1:]
            hashes = word_hashes(words[1:], [x.encode() for x in langs[1:]])[1:]
            names, which = np.unique(np.array(langs[1:], object), return_inverse=True) if len(langs) > 1 else (np.zeros(0, object), np.zeros(0, np.int64))
            yield _columns(len(names), lang=pa.array(names, pa.string()), n=pa.array(np.bincount(which, counts, len(names)).astype(np.int64)))
            yield _sequence_row(shard, ids, pa.array([None, *words[1:]], pa.binary()).cast(pa.string()), pa.array(langs, pa.string()))
            yield from Packed(hashes, parts).rows(shard, counts, least)

        words, langs, numbers, seen = anew()
        held = 0
        for batch in slices(batches):
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                lang = "und" if lang is None else lang
                known = numbers.get(lang)
                if known is None:
                    known = numbers[lang] = _Numbers(words, langs, lang)
                seen.append(np.fromiter(map(known.__getitem__, tokens(raw)), np.int32))
                held += len(seen[-1])
                if held >= most:
                    yield from finished()
                    words, langs, numbers, seen = anew()
                    held, shard = 0, shard + 1
        if seen:
            yield from finished()

    return run


# Suffix arrays of word numbers ------------------------------------------------------------


def suffix_order(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in the order of the `depth` words from there on, by doubled prefixes. ids: closed by as many breaks."""
    rank, known = ids.astype(np.int64), 1
    while True:
        step = min(known, depth - known)
        if known + step >= depth:  # the last round needs the starts alone
            key = rank[starts] * (rank.max(initial=0) + 1) + rank[starts + step]
            return starts[np.argsort(key, kind="stable")]
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + second, return_inverse=True)[1]
        known += step


def room(ids: np.ndarray) -> np.ndarray:
    """How many words stand from each place on up to the next break."""
    breaks = np.flatnonzero(ids == 0)
    return np.append(breaks, len(ids))[np.searchsorted(breaks, np.arange(len(ids)))] - np.arange(len(ids))


def intervals(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(m, order, begins, counts) for m from least to most: the phrases of m words and how often each stands.

    order: starts of suffixes with room for m words, sorted; a phrase's occurrences are those from
    its begin on, `counts` of them.
    """
    ids = np.append(ids, np.zeros(most, ids.dtype))
    space = room(ids)
    order = suffix_order(ids, np.flatnonzero(space >= least), most)
    if not len(order):
        return
    common = np.zeros(len(order), np.int64)  # words shared with the suffix above, up to a break and to `most`
    alike = np.ones(len(order) - 1, bool)
    for t in range(most):
        left, right = ids[order[:-1] + t], ids[order[1:] + t]
        alike &= (left == right) & (left > 0)
        common[1:] += alike
    for m in range(least, most + 1):
        enough = space[order] >= m
        # suffixes without room are passed over: what stands between two that share m words shares them, too
        held = np.flatnonzero(enough)
        begins = np.flatnonzero(common[held] < m)
        yield m, order[held], begins, np.diff(np.append(begins, len(held)))


def _phrases(words: pa.Array, ids: np.ndarray, starts: np.ndarray, m: int) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(ids[starts + t])) for t in range(m)), " ")


def _told_rows(step):
    """step(shard, ids, words, langs, told) for each shard's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, told in enumerate(batch.column("told")):
                row = batch.select(["shard", "ids", "words", "lengths", "of", "langs"]).slice(k, 1).to_pylist()[0]
                yield from step(row["shard"], *_sequence(row), told.values)

    return run


def _found(words: pa.Array, langs: pa.Array, ids: np.ndarray, least: int, most: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The intervals of phrases of least to most words, with the hash and count of each phrase."""
    by_word = word_hashes(_encoded(words), _encoded(langs))
    found = list(intervals(ids, least, most))
    closed = np.append(ids, np.zeros(most, ids.dtype))
    none = np.zeros(0, np.uint64)
    hashes = [phrase_hashes(by_word, closed, order[begins], m) for m, order, begins, _ in found]
    return found, np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int64), *(counts for *_, counts in found)])


def _named(found: list[tuple], frequent: np.ndarray, words: pa.Array, langs: pa.Array, ids: np.ndarray) -> pa.Array:
    """Names of the frequent phrases: their words, a tab (which stands in no word), and the language."""
    out, at = [pa.array([], pa.binary())], 0
    for m, order, begins, counts in found:
        starts = order[begins[frequent[at : at + len(counts)]]]
        at += len(counts)
        out.append(_with_lang(_phrases(words, ids, starts, m), langs.take(pa.array(ids[starts]))))
    return pa.concat_arrays(out)


def _with_lang(phrases: pa.Array, langs: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(phrases, langs, "\t").cast(pa.binary())


def _pair_step(parts: int, least: int):
    """Sequences of frequent words alone, the words' counts, and the hashes of pairs."""

    def step(shard, ids, words, langs, told):
        packed = Packed(word_hashes(_encoded(words), _encoded(langs))[1:], parts)
        which = np.flatnonzero(packed.frequent(told))
        kept = which + 1
        yield from packed.named(which, _with_lang(words.take(pa.array(kept)), langs.take(pa.array(kept))), np.bincount(ids, minlength=len(words))[kept])
        # rare words become breaks, of which no two in a row are kept
        new = np.zeros(len(words), np.int32)
        new[kept] = np.arange(1, len(kept) + 1)
        ids, kept = new[ids], pa.array(np.append(0, kept))
        ids = ids[np.append(True, (ids[1:] > 0) | (ids[:-1] > 0))]
        words, langs = words.take(kept), langs.take(kept)
        _, hashes, counts = _found(words, langs, ids, 2, 2)
        yield _sequence_row(shard, ids, words, langs)
        yield from Packed(hashes, parts).rows(shard, counts, least)

    return step


def _longer_step(parts: int, least: int, most: int):
    """Sequences whose rare pairs are parted, the pairs' counts, and the hashes of longer phrases."""

    def step(shard, ids, words, langs, told):
        found, hashes, counts = _found(words, langs, ids, 2, 2)
        packed = Packed(hashes, parts)
        frequent = packed.frequent(told)
        yield from packed.named(np.flatnonzero(frequent), _named(found, frequent, words, langs, ids), counts[frequent])
        linked = np.zeros(len(ids), bool)
        for _, order, _, counts in found:
            linked[order] = np.repeat(frequent, counts)
        # a break after each word that is not linked to the next
        at = np.flatnonzero(linked | np.append(False, linked[:-1]))
        ids = np.insert(ids[at], np.flatnonzero(~linked[at]) + 1, 0)
        _, hashes, counts = _found(words, langs, ids, 3, most)
        yield _sequence_row(shard, ids, words, langs)
        yield from Packed(hashes, parts).rows(shard, counts, least)

    return step


def _last_step(parts: int, most: int):
    """The counts of longer phrases."""

    def step(shard, ids, words, langs, told):
        found, hashes, counts = _found(words, langs, ids, 3, most)
        packed = Packed(hashes, parts)
        frequent = packed.frequent(told)
        yield from packed.named(np.flatnonzero(frequent), _named(found, frequent, words, langs, ids), counts[frequent])

    return step


# Rounds ------------------------------------------------------------------------------------


def _told(rows: DataFrame, least: int) -> DataFrame:
    """Each shard's sequence with what the parts tell of its phrases; shards without a frequent one are left out."""
    told = rows.filter("keys is not null").select("shard", "part", "keys", "counts").groupBy("part").applyInArrow(_part_rows(least), "shard long, part long, bits binary")
    told = told.groupBy("shard").agg(F.collect_list(F.struct("part", "bits")).alias("told"))  # bits of a shard's own phrases
    return rows.filter("ids is not null").select("shard", "ids", "words", "lengths", "of", "langs").join(told.hint("shuffle_hash"), "shard")


def frequent_phrases(docs: DataFrame, most: int = MOST, least: int = LEAST, shard: int = SHARD, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of the phrases of up to `most` words that stand `least` times or more, and (lang, n) of all words."""
    if most < 3 or least < 1:
        raise ValueError("phrases have three words or more, and occur")
    spark, named = docs.sparkSession, []
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part
    rows = materialize(docs.select("lang", "text").mapInArrow(_shard_rows(shard, parts, least), _ROW_SQL), "phrases-round")
    sizes = materialize(rows.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-sizes")
    for step in (_pair_step(parts, least), _longer_step(parts, least, most), _last_step(parts, most)):
        before, rows = rows, materialize(_told(rows, least).mapInArrow(_told_rows(step), _ROW_SQL), "phrases-round")
        drop(spark, before)
        counted = rows.filter("names is not null").select("part", "names", "counts").groupBy("part").applyInArrow(_name_rows(least), "lang string, phrase string, size int, n long")
        named.append(materialize(counted, "phrases"))
    drop(spark, rows)
    return named[0].unionByName(named[1]).unionByName(named[2]), sizes


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases.

    score: the least of floor(1000 a n / (l r)) over the cuts of a phrase in two, l and r the counts
    of the parts. A phrase inside a longer one that is as frequent is left out.
    """
    counted, sizes = frequent_phrases(docs, most, least, shard)
    found = counted.filter("size > 1").withColumnRenamed("n", "a")
    part = lambda k: F.substring_index("phrase", " ", k)
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    of = lambda name, count: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    exact = {c: f"cast({c} as decimal(19, 0))" for c in "alrn"}
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * ({exact['a']} * {exact['n']})) div ({exact['l']} * {exact['r']})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # if a phrase is in a longer one of equal count, it is also in one of just one word more
    inner = found.filter("size > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter("longer is null or longer < a").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
