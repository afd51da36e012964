import random

import numpy as np
import pytest

from orfweave.llm import simhash
from orfweave.llm.common import Scratch


def brute_components(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(fps)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: least[find(k)] for k in range(len(fps))}


def brute_fingerprint(text, width):
    import xxhash

    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_masks_cover():
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    rng = random.Random(0)
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flipped & m == 0 for m in masks)


def test_fingerprint():
    for text in ["", " \n ", "One", "a B c d", "a b c d e f g a b c d", "é À x y z w"]:
        assert simhash.fingerprint(text, 4) & (1 << 64) - 1 == brute_fingerprint(text, 4)


@pytest.mark.parametrize("large", [4096, 4])
def test_near_groups(spark, large):
    rng = random.Random(large)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(60):  # chains and a dense group
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps += [fps[0] ^ (1 << b) for b in range(20)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    ids = rng.sample(range(1000), len(fps))
    prints = spark.createDataFrame(list(zip(ids, signed)), "id bigint, fp bigint")
    groups = simhash.near_groups(prints, Scratch(spark, "test"), large=large)
    got = {r["id"]: r["component_id"] for r in prints.join(groups, "fp").collect()}
    assert got == brute_components(fps, ids, 4)


def test_edge_cases(spark):
    rows = [(3, None, 1), (2, "", 2), (5, "a b c d e", 3), (5, "a b c d e", 3), (None, "other words here now", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.link_documents(docs, width=4).collect())
    assert got == [(False, 2, 2), (False, 3, 2), (False, 5, 5), (False, 5, 5), (True, None, None)]
    assert simhash.link_documents(docs.limit(0)).count() == 0


def test_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for k in range(12):
        own = list(base)
        for _ in range(k % 3):
            own[rng.randrange(300)] = "edit"
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.kept_documents(docs).collect())
    grams = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8:
                parent[i] = min(parent[i], parent[j])
    assert kept == [k for k in range(len(texts)) if parent[k] == k]


def test_forest_blocks():
    values = np.array([0, 1, 3, 1 << 40, (1 << 40) + 1], np.uint64)
    places = np.arange(5)
    a, b = simhash.forest(values, places, places, 1)
    assert dict(zip(a.tolist(), b.tolist())) == {1: 0, 3: 0, 1 << 40: 0, (1 << 40) + 1: 0}


def brute_kept(texts, similarity=0.8):
    grams = [set(zip(*(t.lower().split()[k:] for k in range(5)))) if len(t.split()) > 4 else {tuple(t.lower().split())} - {()} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(grams[i] | grams[j])
            if not union or len(grams[i] & grams[j]) / union >= similarity:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [k for k in range(len(texts)) if label[k] == k]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(r.doc_id for r in simhash.kept_documents(docs).collect())


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_added_and_cut_passages(spark):
    """Similarities of 0.80 to 0.91 from one passage, by which sets of words differ as much as shingles."""
    rng, texts = random.Random(1), []
    for size, more in [(300, 72), (300, 60), (300, 45), (300, 30), (1000, 240), (60, 12)] * 8:
        base = words(rng, size)
        texts += [" ".join(base), " ".join(base + words(rng, more))]
        base = words(rng, size + more)
        texts += [" ".join(base), " ".join(base[:size])]
    assert kept(spark, texts) == brute_kept(texts)


def test_repeated_lines(spark):
    """Similarity is over distinct shingles: a line's repeats don't part copies."""
    rng = random.Random(2)
    texts = []
    for _ in range(6):
        base, line = words(rng, 120), words(rng, 11)
        texts += [" ".join(base + line * n) for n in (1, 100)]
    assert kept(spark, texts) == brute_kept(texts) == [0, 2, 4, 6, 8, 10]


def test_clusters_joined_by_few_pairs(spark):
    """Two tight clusters that only a few cross pairs connect are one group."""
    for seed in range(3):
        rng = random.Random(seed)
        one = words(rng, 400)
        two = one[:346] + words(rng, 54)
        texts = []
        for base in (one, two):
            for k in range(40):
                own = list(base)
                for _ in range(k % 4 + 1):
                    own[rng.randrange(346)] = f"edit{rng.random()}"
                texts.append(" ".join(own))
        texts.append(" ".join(one[:346] + one[346:373] + two[373:]))
        rng.shuffle(texts)
        assert kept(spark, texts) == brute_kept(texts)


def test_one_line_dominates(spark):
    """Different texts with the same line many times have one fingerprint over repeats, and both stay."""
    rng = random.Random(4)
    line = words(rng, 11)
    texts = [" ".join(words(rng, 200) + line * 100) for _ in range(4)]
    assert kept(spark, texts) == brute_kept(texts) == [0, 1, 2, 3]


def test_long_texts_at_the_threshold(spark):
    """Texts of thousands of shingles at 0.79 and 0.81 are judged from all of them."""
    rng, texts = random.Random(6), []
    for _ in range(12):
        for share in (0.79, 0.81):
            base = words(rng, 3000, 10**6)
            texts += [" ".join(base), " ".join(base + words(rng, int(2996 / share) - 2996, 10**6))]
    assert kept(spark, texts) == brute_kept(texts)


def test_null_and_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c, d = (words(rng, 100) for _ in range(4))
    near = [" ".join(a + [f"x{k}"]) for k in range(4)]
    rows = [(1, near[0]), (5, near[1]), (5, " ".join(b)), (None, near[2]), (None, " ".join(c)), (None, " ".join(d)), (None, " ".join(d + ["y"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.text) for r in simhash.kept_documents(docs).collect()}
    assert rows[0] in got and rows[2] in got and rows[4] in got
    assert len(got) == 4 and len(got & set(rows[5:])) == 1


def test_texts_are_not_moved(spark, monkeypatch):
    """However many copies there are, texts stay where they are read: what goes and what is compared comes to them in bands."""
    rng, texts = random.Random(8), []
    for _ in range(30):
        base = words(rng, 200)
        texts += [" ".join(base), " ".join(base + ["x"]), " ".join(base[:185] + words(rng, 15)), " ".join(base[:140] + words(rng, 60))]
    monkeypatch.setattr(simhash, "FEW", 16)
    monkeypatch.setattr(simhash, "BANDS", 64, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.kept_documents(docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in found.collect()) == brute_kept(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "Exchange hashpartitioning" not in plan


def test_long_parities():
    """With two bits a shingle, sets that differ in half their shingles are told apart at any length."""
    rng = np.random.default_rng(9)
    for n in (40, 1000, 20_000):
        hashes = np.unique(rng.integers(0, 1 << 63, 3 * n // 2, np.uint64))
        one, two = (simhash._parities(h, None).view(np.uint64) for h in (hashes[:n], hashes[-n:]))
        apart = int(np.bitwise_count(one ^ two).sum())
        assert len(one) == len(two) and 0.2 / 1.8 * 2 * n < apart <= n
