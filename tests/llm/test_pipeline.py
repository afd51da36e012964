"""The corpus pipeline's stages and the whole of it on hand-made tables."""

import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from orfweave.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return [f"word{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with toxic ones, exact copies, near copies, nulls and repeated rows, and labels of most."""
    rng, rows, labels, kinds = random.Random(3), [], [], {}

    def add(kind, text, source="s"):
        rows.append((len(rows), text, "en", f"{source}{len(rows) % 4}", len(text or "")))
        kinds[len(rows) - 1] = kind

    for k in range(700):
        words = prose(rng, 40)
        if k % 7 == 0:
            words[rng.randrange(40)] = rng.choice(["vexing", "vexing", "grumble"])
        add("toxic" if k % 7 == 0 else "clean", " ".join(words))
        labels.append((len(rows) - 1, 0, int(k % 7 == 0)))
    for _ in range(20):
        base = prose(rng, 80)
        add("original", " ".join(base))
        add("exact", "  ".join(base))
        add("near", " ".join([*base, "ending"]))
    add("null", None)
    rows.append((None, " ".join(prose(rng, 30)), None, None, 5))
    rows.append((3, " ".join(prose(rng, 30)), None, None, 5))
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), kinds, rows


def test_stages_one_by_one(spark, made):
    folder, kinds, rows = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    kept = STAGES["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    ids = Counter(kinds.get(r.doc_id, "other") for r in kept.collect())
    assert ids["toxic"] <= 10 and ids["clean"] >= 590 and ids["near"] == 20 and ids["null"] == 1
    exact = STAGES["exact dedup"](spark, docs, folder)
    left = Counter(kinds.get(r.doc_id, "other") for r in exact.collect())
    assert exact.columns == docs.columns and left["exact"] == 0 and left["original"] == 20 and left["clean"] == 601
    near = STAGES["SimHash near-dedup"](spark, docs, folder)
    left = Counter(kinds.get(r.doc_id, "other") for r in near.collect())
    assert near.columns == docs.columns and left["near"] == left["exact"] == 0 and left["original"] == 20 and left["clean"] == 601 and left["null"] == 1
    mixed = STAGES["mixing sources to target weights"](spark, docs, folder)
    plan = mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == plan
    packed = STAGES["packing"](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_is_its_stages(spark, made, tmp_path):
    """run() gives what the stages give when each is written and read again; a second run agrees."""
    folder, _, _ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    total = lambda df: df.agg({"length": "sum"}).first()[0]
    one = corpus_pipeline.run(spark, folder)
    assert total(one) == total(docs) > 0
    whole = {(r.doc_id, r.doc_tokens) for r in one.collect()}
    assert whole == {(r.doc_id, r.doc_tokens) for r in docs.collect()}
    sequences = {}
    for r in one.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a " * 20_000, "en", "s", 9)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        none.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        found = {r.doc_id for r in got.collect()}
        # of the empty texts one stays, the one with the smallest id
        assert found == ({1, 2} if rows else set())
