"""Toxicity and top-k search."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from orfweave.llm import topk, toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1500):
        text = [rng.choice(words) for _ in range(40)]
        bad = k % 6 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["vexing", "vexer", "Grumble!"])
        rows.append((k, " ".join(text), "x"))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, known)
    assert len(model) < 1 << 12
    scored = toxicity.score_column(docs.withColumn("held", toxicity.held_out("doc_id")), model)
    got = [(r.doc_id % 6 == 0, r[toxicity.SCORE] >= 0.5) for r in scored.where("held").collect()]
    assert len(got) > 200
    assert sum(a == b for a, b in got) / len(got) > 0.97
    # the same rows give the same model
    assert toxicity.train(docs.repartition(3), known) == model


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "퟿" * 10)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, none)
    assert len(model) == 0 and model.bias is None and {r[toxicity.SCORE] for r in toxicity.score_column(docs, model).collect()} == {0.0}
    constant = toxicity.Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.5)
    assert toxicity.score_column(docs.limit(0), constant).count() == 0
    assert {round(r[toxicity.SCORE], 6) for r in toxicity.score_column(docs, constant).collect()} == {round(1 / (1 + math.exp(-0.5)), 6)}


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8)) + rng.integers(0, 3, (600, 1)) * 4
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(k, vectors[7].tolist()) for k in range(700, 760)]
    rows += [(800, None), (801, [1.0, None]), (802, [float("nan")] * 8), (None, [1.0] * 8), (900, [2.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS id")
    clean = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))) for i, v in rows if i not in (None, 800, 801, 802)]
    want = {}
    for q, v in clean:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q))[:10]
            want[q] = [(i, -s) for s, i in scores]
    # one cell; twenty cells and more, cut into shells and parts
    for block, cell in ((8192, 2048), (16, 25)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "CELL", cell)
        got = {}
        for r in topk.search(df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
    assert topk.search(df.limit(0)).count() == 0


def test_topk_prunes_clusters(spark, monkeypatch):
    """Vectors of separate clusters: most shells are never asked; the answers stay whole."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 16)) * 10
    points = np.repeat(centres, 40, axis=0) + rng.normal(size=(1000, 16)) * 0.05
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk, "CELL", 40)
    asked, searched = [], topk._searched

    def counted(blocks, shells, wanted, *more):
        asked.append((wanted.count(), len(shells)))
        return searched(blocks, shells, wanted, *more)

    monkeypatch.setattr(topk, "_searched", counted)
    got = {}
    for r in topk.search(df, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(points * 1024)
    for q in range(0, 1000, 20):
        scores = whole @ whole[q]
        order = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in order]
    assert asked[0][1] >= 20 and asked[1][0] < 0.3 * 50 * asked[1][1]


def test_topk_repeated_query_ids_and_size(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df).collect())
    one = 1 << 20
    assert got == sorted([(0, 1, 1, one), (0, 2, 2, one // 2), (0, 3, 0, 0), (0, 1, 1, one), (0, 2, 2, one // 4), (0, 3, 0, 0)])
    with pytest.raises(ValueError, match="exact"):
        topk.search(spark.createDataFrame([(0, [1e5])], df.schema))


def test_tree_covers():
    points = np.random.default_rng(4).normal(size=(500, 5))
    tree = topk.Tree(points, leaf=10)
    for centre, radius, rows in zip(tree.centre, tree.radius, tree.rows):
        assert np.sqrt(((points[rows] - centre) ** 2).sum(axis=1)).max() <= radius
    assert sorted(np.concatenate([r for r, c in zip(tree.rows, tree.children) if not c]).tolist()) == list(range(500))


def coordinates(text):
    parts = list(toxicity.Features.of()([text]))
    return set().union(*(set(c.tolist()) for _, c in parts))


def test_features_match_plain_tokeniser():
    """A text's coordinates are those of its words, stems, pairs and skip pairs, each taken from the smallest text that
    has it."""
    text = "One, two three-four; ONE über eleven seventeen 42 one two"
    words = re.findall(r"[^\W_]+", text.lower())
    want = set()
    for k, w in enumerate(words):
        want |= coordinates(w)
        assert len(coordinates(w)) == 1 + sum(len(w) > n for n in toxicity.STEMS)
        for d in toxicity.DISTANCES:
            if k + d < len(words):
                between = ["zq"] * (d - 1)
                alone = coordinates(w) | coordinates(words[k + d]) | coordinates("zq")
                own = set()
                for x, y in itertools.pairwise([w, *between, words[k + d]]):
                    own |= coordinates(f"{x} {y}") if d > 1 else set()
                if d == 3:
                    own |= coordinates(f"{w} zq zq") | coordinates(f"zq zq {words[k + d]}")
                want |= coordinates(" ".join([w, *between, words[k + d]])) - alone - own
    assert coordinates(text) == want
    assert coordinates("a b") != coordinates("b a") and coordinates("") == set()


def test_fit_matches_dictionary_ftrl():
    rng = np.random.default_rng(8)
    rows = [(np.unique(rng.integers(0, 300, 20)).astype(np.uint32), int(rng.random() < 0.3)) for _ in range(400)]
    rows = [(np.union1d(c, [500]).astype(np.uint32) if y and rng.random() < 0.9 else c, y) for c, y in rows]
    kept, weights, got_bias = toxicity.fit(rows)
    got = np.zeros(1 << toxicity.BITS)
    got[kept] = weights
    z, n = {}, {}
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(k, l1, l2):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for c, y in rows:
            keys = [(k, l1, l2) for k in c.tolist()] + [("bias", 0.0, 0.0)]
            w = {k: weight(k, a, b) for k, a, b in keys}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE if y else 1.0)
            for k in w:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k], n[k] = z.get(k, 0.0) + g - sigma * w[k], n.get(k, 0.0) + g * g
    want = np.zeros(len(got))
    for k in z:
        if k != "bias":
            want[k] = weight(k, l1, l2)
    assert np.abs(got - want).max() < 5e-3 and want[500] > 1 and abs(got_bias - weight("bias", 0.0, 0.0)) < 5e-3


def test_training_takes_one_row_an_id(spark):
    rows = [(k % 20, f"text {k % 20}" + " vile" * (k % 20 < 10)) for k in range(200)] + [(3, "another text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 10)) for k in range(20)], "doc_id bigint, toxic int")
    one = docs.dropDuplicates(["doc_id", "text"])
    assert toxicity.train(docs, labels) == toxicity.train(one, labels)
