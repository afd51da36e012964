"""The language model against dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orfweave.llm import language_model as lm

SCHEMA = "doc_id bigint, text string, row string, words int"


def texts(n=160, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Éa", "x" * 70, "x" * 71, "."]
    out = [None, "", " \n\t", "One one ONE", "\x0bw1  w2\r\nw3 "]
    for _ in range(n):
        k = int(rng.expovariate(1 / 40)) + 1
        out.append(" ".join(words[min(len(words) - 1, int(rng.expovariate(1 / 9)))] + ("q%d" % rng.randrange(10**6) if rng.random() < 0.05 else "") for _ in range(k)))
    out.append(" ".join(f"w{k % 50} w{k % 7}" for k in range(30000)))
    return out


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def grams(own, m):
    """n-grams of m that end at each token, an end before the first; None where they would reach out of the text."""
    full = [None, *own]
    return [tuple(full[k - m + 1 : k + 1]) if k - m + 1 >= 0 else None for k in range(1, len(full))]


def brute(rows, learnt, order, base, prior):
    counts = [Counter() for _ in range(order)]
    for (_, t), use in zip(rows, learnt):
        if use:
            for m in range(1, order + 1):
                counts[m - 1].update(g for g in grams(tokens(t), m) if g)
    n, v = sum(counts[0].values()), len(counts[0])
    whole = n + 0.5 * (v + 1)

    def seen(g):
        c = counts[len(g) - 1][g]
        if not c:
            return 0.0
        q = 0
        while c >= math.ceil(base**q - 1e-9):
            q += 1
        return math.sqrt(math.ceil(base ** (q - 1) - 1e-9) * (math.ceil(base**q - 1e-9) - 1))

    out = []
    for _, t in rows:
        own = tokens(t)
        exact = sum(math.log10((counts[0][(w,)] + 0.5) / whole) for w in own)
        known = sum(counts[0][(w,)] > 0 for w in own)
        total, all_grams = 0.0, [grams(own, m) for m in range(1, order + 1)]
        for k, w in enumerate(own):
            p = (min(seen((w,)), n) + 0.5) / whole
            for m in range(2, order + 1):
                if g := all_grams[m - 1][k]:
                    context = seen(g[:-1])
                    p = (min(seen(g), context, seen(g[1:])) + prior * p) / (context + prior)
            total += math.log10(p)
        out.append((len(own), known, n, exact, total))
    return out


@pytest.mark.parametrize("order, hot, max_bytes", [(2, 1 << 17, 1 << 27), (3, 20, 1 << 27), (2, 0, 9000)])
def test_scores(spark, order, hot, max_bytes):
    rows = [(k if k != 11 else None, t) for k, t in enumerate(texts())]
    rows += rows[:8] + [(3, rows[9][1])]
    docs = spark.createDataFrame([(k, t, "r", 1) for k, t in rows], SCHEMA).repartition(3)
    use = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    learnt = [k is not None and zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in rows]
    # so many bits that hardly anything is found that isn't there
    got = lm.score(docs, use, order=order, bits=60, hashes=9, hot=hot, max_bytes=max_bytes, prior=30.0).collect()
    want = brute(rows, learnt, order, lm.BASE, 30.0)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    got = sorted(((r.doc_id, r.learnt, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((k, use_, *w) for (k, _), use_, w in zip(rows, learnt, want)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-7, atol=1e-7)


def test_bands(spark):
    """As many passes as bands give what one pass gives, and production parameters are near to exact counts."""
    rows = [(k, t) for k, t in enumerate(texts(60))]
    docs = spark.createDataFrame([(k, t, "r", 1) for k, t in rows], SCHEMA)
    one, many = ({r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 5 != 1, max_bytes=b).collect()} for b in (1 << 27, 500))
    assert one == many
    want = brute(rows, [k % 5 != 1 for k, _ in rows], lm.ORDER, lm.BASE, lm.PRIOR)
    assert abs(sum(one.values()) / sum(w[4] for w in want) - 1) < 0.01


def test_order_helps(spark):
    """Where a word tells the next one, texts that weren't learnt from are likelier than their words alone."""
    rng = random.Random(8)
    rows = []
    for k in range(80):
        at, own = rng.randrange(40), []
        for _ in range(rng.randrange(1, 60)):
            own.append(f"w{at}")
            at = (at * 7 + rng.choice((1, 3))) % 40
        rows.append((k, " ".join(own), "r", 1))
    got = lm.score(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 5 != 1, prior=10.0).where("NOT learnt").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm.score(none, F.lit(True)).count() == 0
    # nothing to learn from: every token has the chance 1/2 over 1/2
    docs = spark.createDataFrame([(1, "a b", "", 0), (2, None, "", 0)], SCHEMA)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs, F.lit(False)).collect()}
    assert got == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2), rng.integers(1, 500, 5000)
    low = lm.levels(1.5)
    entries = lm._entries(keys, counts, low)
    size = 64 * (10 * len(entries) // 64)
    field = np.zeros(size, bool)
    for j in range(5):
        field[lm._place(entries, lm._again(entries), j, size)] = True
    found = lm.Filter(np.array([size]), 0, np.packbits(field, bitorder="little").tobytes(), 1.5, 5)
    want = np.searchsorted(low, counts, "right")
    got = found.levels(keys)
    assert (got >= want).all() and (got > want).mean() < 0.02
    assert (found.levels(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.02


def test_filter_in_parts(spark, monkeypatch):
    """The driver holds a part of the filter at once; tasks put the same band together."""
    rows = spark.createDataFrame([(" ".join(f"w{k * j % 97}" for j in range(40)),) for k in range(60)], "text string")
    model = lm.Model(rows, 2, 1.5, 10, 5, 400.0, 1 << 27, 100)
    whole = model.band(0)
    monkeypatch.setattr(lm, "PART", 200)
    parts = model.band(0)
    assert len(whole.parts) == 1 and len(parts.parts) > 1
    one, many = whole.filter(), parts.filter()
    assert (one.bits == many.bits).all() and 8 * len(one.bits) == model.sizes.sum()


def test_memory_of_tasks(spark):
    """Counting gives up an earlier model's filter, and a task's slices come one at a time, several a partition."""
    import pyarrow as pa

    from orfweave.llm import common

    common.held("filter of another model", lambda: bytes(100))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "b c c"])], ["text"])
    (counted,) = lm._count(3, 2)(iter([batch]))
    assert not common._HELD
    # a, b, c and the end; bigrams with the ends before the first words
    assert sum(len(x) for x in counted.column("words").to_pylist()) == 8 * 4
    assert sum(np.frombuffer(b"".join(counted.column("gram_counts").to_pylist()), "<u4")) == 7
    model = lm.Model(spark.createDataFrame([("a b",)] * 3, "text string"), lm.ORDER, lm.BASE, lm.BITS, lm.HASHES, lm.PRIOR, lm.MAX_BYTES, lm.HOT)
    assert len(model.sizes) >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
