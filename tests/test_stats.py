"""Tails of distributions against printed tables, and small tests against plain Python."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orfweave.functions import distributions
from orfweave.operators import stats


def test_tails_match_tables():
    # upper 5 and 1 per cent points
    for f, a, b, p in ((4.1028, 2, 10, 0.05), (7.5594, 2, 10, 0.01), (2.8661, 4, 20, 0.05), (3.8415, 1, 1_000_000, 0.05)):
        assert stats.f_tail(f, a, b) == pytest.approx(p, abs=5e-5)
    for t, n, p in ((2.2281, 10, 0.05), (3.1693, 10, 0.01), (12.7062, 1, 0.05), (1.9600, 1_000_000, 0.05)):
        assert stats.t_tail(t, n) == pytest.approx(p, abs=5e-5) == stats.t_tail(-t, n)
    assert stats.f_tail(0, 2, 3) == 1.0 and stats.t_tail(0.0, 5) == pytest.approx(1.0)


def test_last_read_of_a_file(spark):
    rows = [("f", 1, "r1", "g1.1", 0.0), ("f", 2, "r1", "g1.2", 0.0), ("f", 3, "r1", "g2.1", 1.0), ("f", 4, "r2", "g1.2", 0.0), ("g", 1, "r9", "g1.1", 0.0)]
    df = spark.createDataFrame(rows, "file string, line bigint, read string, orf string, e_value double")
    assert {r.orf: r.hits for r in stats.hits_per_orf(df).collect()} == {"g1.1": 2, "g1.2": 1}
    assert {r.orf: r.hits for r in stats.hits_per_orf(df, drop_last=True).collect()} == {"g1.1": 1}


def test_paired_t_and_sample(spark):
    df = spark.createDataFrame([(float(k),) for k in range(50)], "value double")
    got = stats.paired_t(df, df.selectExpr("value + 100 AS value"), "value", 50, 3).first()
    assert got.n == 50 and got.t < -10
    drawn = [r.value for r in stats.sample(df, 20, 7).collect()]
    assert len(set(drawn)) == 20 and drawn == [r.value for r in stats.sample(df, 20, 7).collect()]
    rows = stats.resample(df.selectExpr("value", "CAST(value AS INT) AS id", "'a' AS g"), "id", "g", "value", 5, 50).collect()
    assert [(r.n, r["mean"]) for r in rows] == [(50, statistics.mean(range(50)))] * 5


def test_tails_as_columns(spark):
    points = [(4.1028, 2.0, 10.0, 0.05), (7.5594, 2.0, 10.0, 0.01), (2.8661, 4.0, 20.0, 0.05), (3.8415, 1.0, 1e6, 0.05), (-1.0, 2.0, 3.0, 1.0), (math.inf, 2.0, 3.0, 0.0), (math.nan, 2.0, 3.0, None), (None, 2.0, 3.0, None)]
    df = spark.createDataFrame(points, "f double, a double, b double, want double")
    for r in df.select("want", distributions.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p"), "f", "a", "b").collect():
        assert (r.p is None and r.want is None) or r.p == pytest.approx(r.want, abs=5e-5)
        if r.p and 0 < r.p < 1:
            assert r.p == pytest.approx(stats.f_tail(r.f, r.a, r.b), abs=1e-7)
    # printed upper points of the studentized range: q, groups, degrees of freedom
    points = [(3.877, 3, 10.0, 0.05), (3.635, 2, 5.0, 0.05), (4.646, 10, 60.0, 0.05), (5.270, 3, 10.0, 0.01), (3.314, 3, 1e7, 0.05), (17.97, 2, 1.0, 0.05), (0.0, 3, 9.0, 1.0)]
    df = spark.createDataFrame(points, "q double, k int, n double, want double")
    for r in df.select("want", distributions.range_tail(F.col("q"), F.col("k"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(r.want, abs=1e-4)
    x = [0.5, 1.0, 3.3, 9.99, 1e5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(distributions.ln_gamma(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)


def test_medians(spark):
    """Ties, few rows, values of all sizes, null groups, nulls and NaN."""
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(301)] + [("b", float(rng.randrange(3))) for _ in range(200)] + [("c", rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300)) for _ in range(150)]
    rows += [("d", 7.0), ("e", 1.0), ("e", 2.0), (None, 5.0), (None, 9.0), ("f", math.inf), ("f", -math.inf), ("f", 3.0), ("g", 1e308), ("g", -1e308), ("a", None), ("a", math.nan), ("h", None)]
    got = {r.g: r["median"] for r in stats.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = [v for k, v in rows if k == g and v is not None and v == v]
        if own:
            want[g] = statistics.median(own)
    assert got == want
    assert stats.medians(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_hits_over_ranges(spark):
    """Runs that reach over ranges, a read that comes again, a file that one range begins in the middle of."""
    rng = random.Random(2)
    rows, read = [], 0
    for file in ("f", "g", "h"):
        for line in range(400):
            read = read if rng.random() < 0.85 else rng.randrange(4)
            rows.append((file, line, f"r{read}", f"g{rng.randrange(3)}.{rng.randrange(5)}", float(rng.random() < 0.1)))
        # one run over several ranges
        rows += [(file, 1000 + k, "long", f"g{k % 2}.{k % 5}", 0.0) for k in range(500)]
    df = spark.createDataFrame(rows, "file string, line bigint, read string, orf string, e_value double")
    for drop in (False, True):
        want = Counter()
        for file in ("f", "g", "h"):
            runs, last = [], None
            for _, line, read, orf, e in sorted(r for r in rows if r[0] == file):
                if e > 1e-10:
                    continue
                if read != last:
                    runs.append({})
                last = read
                runs[-1].setdefault(orf.split(".")[0], orf)
            for run in runs[: -1 if drop else None]:
                want.update(run.values())
        assert {r.orf: r.hits for r in stats.hits_per_orf(df.repartition(5), drop_last=drop).collect()} == dict(want)
    assert stats.hits_per_orf(df.limit(0)).count() == 0


def test_draws(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 4 AS INT) AS g", "CAST(id AS DOUBLE) AS v")
    drawn = stats.draws(df, "id", 6, 100, by=("g",)).collect()
    assert Counter((r.repeat, r.g) for r in drawn) == {(k, g): 100 for k in range(1, 7) for g in range(4)}
    assert len({(r.repeat, r.id) for r in drawn}) == len(drawn) and {r.place for r in drawn} == set(range(1, 101))
    # the smallest hashes of all
    numbers = {r.id: r.n for r in df.select("id", F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(stats.PRIME)).alias("n")).collect()}
    k, a, b = stats.draw_hashes(6)[2]
    best = sorted((i for i in numbers if i % 4 == 1), key=lambda i: ((numbers[i] * a + b) % stats.PRIME, i))[:100]
    assert [r.id for r in sorted((r for r in drawn if (r.repeat, r.g) == (k, 1)), key=lambda r: r.place)] == best
    # most rows are left out before they are put in order
    assert stats.draws(df, "id", 2, 10000).count() == 10000 and stats.draws(df.limit(0), "id", 2, 5).count() == 0
    tests = {(r.test, r.a, r.b): (r.draws, r.significant) for r in stats.significant(stats.draw_tests(stats.draws(df, "id", 5, 400).withColumn("v", F.col("v") + F.col("g") * 4000), "g", "v")).collect()}
    assert tests["anova", None, None] == (5, 5) and tests["tukey", 0, 3] == (5, 5) and len(tests) == 2 + 6 + 6
    got = stats.paired_draws(df.selectExpr("id", "v"), df.selectExpr("id", "v + 3000 AS v"), "id", "v", 3, 200).collect()
    assert all(r.n == 200 and r.t < -10 and r.p < 1e-6 for r in got) and len(got) == 3
