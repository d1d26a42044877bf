import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factloom.llm import mixing

from . import cases
from .test_mixing import brute_targets, size
from .test_simhash import brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    data, labels = [], []
    for i in range(240):
        text = cases.prose(rng, rng.randint(20, 120))
        if i % 5 == 0:
            text = " ".join(w + rng.choice(["***", "###", "%%%"]) for w in text.split())
        if i % 17 == 3:
            text += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
        data.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    data += [(300 + i, data[7][1] if i % 2 else data[8][1] + " more", "en", "src1", 1) for i in range(30)]
    data += [data[11], data[11], (None, data[12][1] + " end", "en", None, 5), (900, None, "en", "src0", None), (901, "", "en", "src0", 0), (902, cases.prose(rng, 9000), "en", "src2", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    cases.docs(spark, data).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert kept.columns == columns
    before, after = rows(docs), rows(kept)
    assert {r[0] for r in before - after} == {i for i in range(0, 240, 5)} and not after - before

    kept = spark.createDataFrame([tuple(r) for r in kept.collect()], docs.schema)
    one = corpus_pipeline.near_duplicates(spark, kept, folder)
    given, got = kept.collect(), rows(one)
    groups = defaultdict(list)
    for r, root in zip(given, brute_groups([r.text for r in given])):
        groups[root].append(r)
    assert one.columns == columns and sum(got.values()) == len(groups)
    for members in groups.values():
        ids = [r.doc_id for r in members if r.doc_id is not None]
        assert sum(got[tuple(r)] > 0 for r in set(members)) == 1
        assert any(got[tuple(r)] for r in members if r.doc_id == min(ids, default=None))

    safe = corpus_pipeline.secret_scan(spark, one, folder).collect()
    assert len(safe) == len(groups) and not any("24be64439e" in (r.text or "") for r in safe)
    untouched = {r[0]: r[1] for r in got if "token" not in (r[1] or "")}
    assert all(r.text == untouched[r.doc_id] for r in safe if r.doc_id in untouched)

    safe_docs = spark.createDataFrame([tuple(r) for r in safe], docs.schema)
    mixed = corpus_pipeline.source_mix(spark, safe_docs, folder)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in safe:
        sizes[r.source] += size(r.text)
    whole = {r.doc_id: (r.text or "").split() for r in safe}
    for r in mixed.collect():
        taken[r.source] += size(r.text)
        mine, of = r.text.split(), whole[r.doc_id]
        assert any(of[k : k + len(mine)] == mine for k in range(len(of) - len(mine) + 1))
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * 16 + 1

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.piece_ids(spark, mixed, folder)
    assert rows(last.select("doc_id", F.col("ids").cast("string"))) == Counter((r.doc_id, str(library.encode(r.text))) for r in mixed.collect())


def test_run_is_the_stages_in_order(spark, folder):
    first, again = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert first.columns == ["doc_id", "source", "n_pieces", "ids"]
    assert rows(first.withColumn("ids", F.col("ids").cast("string"))) == rows(again.withColumn("ids", F.col("ids").cast("string")))


def test_other_columns_pass_and_may_have_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["key", "log_ratio", "n_grams", "passes", "pieces", "_words", "_id", "_hash", "fingerprint", "node", "root", "spans", "n_words", "_aside_9", "size", "target", "shard"]
    clashing = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns
        assert all(r[n] is None or r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    assert corpus_pipeline.piece_ids(spark, clashing, folder).columns == ["doc_id", "source", "n_pieces", "ids"]


def test_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert mixing.plan(cases.empty(spark)).collect() == []
