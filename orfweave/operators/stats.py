"""Statistics over calls: hits, summaries, tests between groups. Everything is relational, tails of distributions too
(see distributions); f_tail and t_tail here are the same for single numbers."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfweave.functions import distributions
from orfweave.plans.scratch import Scratch


def hits_per_orf(alignments: DataFrame, limit: float = 1e-10, drop_last: bool = False) -> DataFrame:
    """orf, hits: a run of lines of one read counts each genome (the ORF's name before the dot) once, with its first
    ORF. drop_last leaves out a file's last run.

    Lines are dealt into ranges of file and line. A range tells of each of its files the first and the last read and how
    often the read changes; what comes before it follows from these totals alone, so a file is read by many tasks.
    """
    spark = alignments.sparkSession
    scratch = Scratch(spark, "hits")
    good = alignments.where(F.col("e_value") <= limit).select("file", "line", "read", "orf")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range of a line is written down: later readers can't come to another division
    ranged = scratch.write(good.repartitionByRange(n, "file", "line").withColumn("part", F.spark_partition_id()), "ranged")
    order = Window.partitionBy("part", "file").orderBy("line")
    changes = ranged.withColumn("new", (~F.lag("read").over(order).eqNullSafe(F.col("read")) & (F.row_number().over(order) > 1)).cast("int"))
    totals = changes.groupBy("file", "part").agg(F.min_by("read", "line").alias("first"), F.max_by("read", "line").alias("last"), F.sum("new").alias("changes"))
    # a row a file and range
    ranges = Window.partitionBy("file").orderBy("part")
    begins = (~F.lag("last").over(ranges).eqNullSafe(F.col("first")) | F.lag("part").over(ranges).isNull()).cast("int")
    carried = totals.withColumn("begins", begins).withColumn("upto", F.sum(F.col("changes") + F.col("begins")).over(ranges))
    carried = carried.select("file", "part", (F.col("upto") - F.col("changes")).alias("run_before"), F.max("upto").over(Window.partitionBy("file")).alias("final"))
    runs = changes.withColumn("own", F.sum("new").over(order)).join(carried, ["file", "part"]).withColumn("run", F.col("run_before") + F.col("own"))
    if drop_last:
        runs = runs.where("run < final")
    first = runs.groupBy("file", "run", F.substring_index("orf", ".", 1).alias("genome")).agg(F.min_by("orf", "line").alias("orf"))
    return first.groupBy("orf").agg(F.count(F.lit(1)).alias("hits"))


#: Parts into which a round of a selection cuts the range that it has come to.
BINS = 1024


def _same(keys: list[str], other: dict[str, str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(other[k]))
    return out


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys and the median of each group, exactly, without a group's rows ever being in one place. Rounds count rows in
    BINS parts of a range that holds the middle rows, for all groups at once, until the range is one value. Nulls and NaN
    take no part; infinite values count as the largest doubles."""
    scratch = Scratch(rows.sparkSession, "medians")
    most = 1.7e308
    v = F.greatest(F.lit(-most), F.least(F.lit(most), F.col(value).cast("double")))
    base = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, v.alias("v"))
    ends = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    middle = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))).alias("rank")
    # rank: which of the two middle rows; place: its number among the rows of the range
    state = scratch.write(ends.select(*keys, middle, "lo", "hi").withColumn("place", F.col("rank")), "state")
    own = {k: f"_own_{k}" for k in keys}
    sized = lambda v: F.signum(v) * F.when(v == 0, 0.0).otherwise(F.log(F.abs(v)) + 745)
    for turn in itertools.count():
        if state.where("lo < hi").isEmpty():
            break
        open_ = state.where("lo < hi").withColumnsRenamed(own)
        within = base.join(open_, _same(keys, own) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        # even parts by value (halves, as a range of all doubles would overflow) and by size take turns; the upper end has a
        # part of its own, so that a range always shrinks
        x, lo, hi = (sized(F.col(c)) if turn % 2 else F.col(c) / 2 for c in ("v", "lo", "hi"))
        part = F.least(F.lit(BINS - 1), F.coalesce(F.floor(F.try_divide(x - lo, hi - lo) * BINS), F.lit(0)).cast("int"))
        counts = within.groupBy(*keys, "rank", "place", F.when(F.col("v") == F.col("hi"), BINS).otherwise(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("part"))
        chosen = counts.withColumn("end", upto).where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
        chosen = chosen.select(*keys, "rank", "lo", "hi", (F.col("place") - F.col("end") + F.col("n")).alias("place"))
        state = scratch.write(state.where("lo = hi").unionByName(chosen), "state")
    return state.groupBy(*keys).agg(((F.min("lo") + F.max("lo")) / 2).alias("median"))


def summary(rows: DataFrame, group: str, value: str, sample: bool = True) -> DataFrame:
    """Per group: n, least, most, mean, sd (of the sample, or of the population), median; two decimals."""
    v = F.col(value)
    sd = F.stddev_samp(v) if sample else F.stddev_pop(v)
    out = rows.groupBy(group).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.mean(v), 2).alias("mean"), F.round(sd, 2).alias("sd"))
    middle = medians(rows, [group], value).select(F.col(group).alias("_own"), F.round("median", 2).alias("median"))
    return out.join(middle, F.col(group).eqNullSafe(F.col("_own")), "left").drop("_own")


def zero_percent(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col(value) == 0) / F.count(F.lit(1))).alias("zero_percent"))


def _moments(rows: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*by, group).agg(F.count(v).alias("n"), F.mean(v).alias("mean"), F.var_samp(v).alias("variance"))


def anova(rows: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of by: df_between, df_within, ss_between, ss_within, f, eta (explained share), f2
    (explained by unexplained), p. By columns aren't null."""
    m = _moments(rows, group, value, by)
    total = m.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    parts = m.join(total, list(by)) if by else m.crossJoin(F.broadcast(total))  # one row
    sums = parts.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("df_between"), (F.sum("n") - F.count(F.lit(1))).alias("df_within"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ss_between"), F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).alias("ss_within"))
    f = F.try_divide(F.try_divide("ss_between", "df_between"), F.try_divide("ss_within", "df_within"))
    out = sums.select("*", f.alias("f"), F.try_divide("ss_between", F.col("ss_between") + F.col("ss_within")).alias("eta"), F.try_divide("ss_between", "ss_within").alias("f2"))
    return out.withColumn("p", distributions.f_tail(F.col("f"), F.col("df_between"), F.col("df_within")))


def regression(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One numeric predictor: n, slope, intercept, r2, f, f2, p."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    fit = rows.agg(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))
    rest = 1 - F.col("r2")
    out = fit.select("*", F.try_divide("r2", F.try_divide(rest, F.col("n") - 2)).alias("f"), F.try_divide("r2", rest).alias("f2"))
    return out.withColumn("p", distributions.f_tail(F.col("f"), 1.0, F.col("n") - 2))


def cohen_d(rows: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, d for each pair of groups, a group with itself included: difference of means by the pooled deviation."""
    m = _moments(rows, group, value)
    left = m.select(F.col(group).alias("a"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("variance").alias("v1"))
    right = m.select(F.col(group).alias("b"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("variance").alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    # pairs of groups, not of rows
    return left.join(right, F.col("a") <= F.col("b")).select("a", "b", ((F.col("m1") - F.col("m2")) / pooled).alias("d"))


def levene(rows: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The test of equal variances around medians: anova() of the distances from the group's median."""
    v, keys = F.col(value).cast("double"), [*by, group]
    own = {k: f"_own_{k}" for k in keys}
    middle = medians(rows, keys, value).withColumnsRenamed(own)
    apart = rows.join(middle, _same(keys, own)).select(*keys, F.abs(v - F.col("median")).alias("apart"))
    return anova(apart, group, "apart", by)


def tukey(rows: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, difference, the studentized range q and p of each pair of groups; for each value of by, if given."""
    m = _moments(rows, group, value, by)
    count, keys = F.count(F.lit(1)), list(by)
    within = m.groupBy(*by).agg((F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))) / (F.sum("n") - count)).alias("ms"), count.alias("groups"), (F.sum("n") - count).alias("df"))
    left = m.select(*keys, F.col(group).alias("a"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    right = m.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col(group).alias("b"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    # pairs of groups, not of rows
    same = F.col("a") < F.col("b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_b_{k}"))
    pairs = left.join(right, same)
    pairs = pairs.join(within, keys) if keys else pairs.crossJoin(F.broadcast(within))  # one row
    error = F.sqrt(F.col("ms") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    q = F.try_divide(F.abs(F.col("m2") - F.col("m1")), error)
    return pairs.select(*keys, "a", "b", (F.col("m2") - F.col("m1")).alias("difference"), q.alias("q"), distributions.range_tail(q, F.col("groups"), F.col("df")).alias("p"))


def neighbours(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, order, before, value and after: each value with those beside it in its group, null at the ends."""
    along = Window.partitionBy(group).orderBy(order)
    return rows.select(group, order, F.lag(value).over(along).alias("before"), value, F.lead(value).over(along).alias("after"))


def histogram(rows: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """group, bucket (its lower end) and n."""
    return rows.where(F.col(value).isNotNull()).groupBy(group, (F.floor(F.col(value) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(F.rand(seed)).limit(n)


def paired_t(a: DataFrame, b: DataFrame, value: str, n: int, seed: int) -> DataFrame:
    """n, t of two samples that are paired by their random order."""
    place = lambda df, k: df.select(F.col(value).cast("double").alias(f"v{k}"), F.rand(seed + k).alias("r")).orderBy("r").limit(n).withColumn("place", F.row_number().over(Window.orderBy("r")))
    pairs = place(a, 0).drop("r").join(place(b, 1).drop("r"), "place")
    d = F.col("v0") - F.col("v1")
    return pairs.agg(F.count(d).alias("n"), (F.mean(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))


#: A prime; hashes of a draw are below it.
PRIME = (1 << 31) - 1


def draw_hashes(repeats: int, seed: int = 0) -> list[tuple[int, int, int]]:
    """(repeat, a, b): a row with key number x has the hash (a x + b) mod PRIME in that repeat."""
    rng = random.Random(seed)
    return [(k, rng.randrange(1, PRIME), rng.randrange(PRIME)) for k in range(1, repeats + 1)]


def draws(rows: DataFrame, key: str, repeats: int, n: int, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """n rows without replacement, drawn repeats times, of all rows or of each value of by: the rows' columns, repeat and place
    (from 1 in a draw). Fewer rows than n are all drawn.

    A draw is the n rows of the smallest hashes of their key. Which hashes can be among them follows from how many rows there
    are, so all but some n rows a draw are left out where they are read; a draw that comes out short, which hardly ever
    happens, has its bound doubled and all are drawn again. Reruns agree; rows of one key are told apart by nothing
    else, so keys should be different.
    """
    scratch = Scratch(rows.sparkSession, "draws")
    sizes = scratch.write(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).withColumnsRenamed({k: f"_own_{k}" for k in by}), "sizes")
    number = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(PRIME))
    numbered = rows.withColumn("_number", F.coalesce(number, F.lit(0)))
    same = _same(list(by), {k: f"_own_{k}" for k in by})
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("repeat"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for k, a, b in draw_hashes(repeats, seed)))).alias("_draw")
    most, whole = n + 6 * math.sqrt(n) + 30, repeats * sizes.where("_rows > 0").count()
    while True:
        bound = F.least(F.lit(float(PRIME)), F.ceil(most / F.col("_rows") * PRIME))
        bounded = numbered.join(F.broadcast(sizes), same) if not by else numbered.join(sizes, same)
        hashed = bounded.select(*rows.columns, "_rows", bound.alias("_bound"), "_number", each)
        hashed = hashed.withColumn("_hash", F.pmod(F.col("_number") * F.col("_draw.a") + F.col("_draw.b"), F.lit(PRIME))).where(F.col("_hash") < F.col("_bound"))
        kept = scratch.write(hashed.select(*rows.columns, "_rows", F.col("_draw.repeat").alias("repeat"), "_hash"), "kept")
        found = kept.groupBy("repeat", *by).agg(F.count(F.lit(1)).alias("_n"), F.first("_rows").alias("_rows"))
        full = found.where(F.col("_n") >= F.least(F.lit(n), F.col("_rows"))).count()
        if full == whole:
            break
        most *= 2
    order = Window.partitionBy("repeat", *by).orderBy("_hash", key)
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("_rows", "_hash")


def resample(rows: DataFrame, key: str, group: str, value: str, repeats: int, n: int, seed: int = 0) -> DataFrame:
    """repeat, group, n and mean of n rows of each group drawn repeats times."""
    drawn = draws(rows.where(F.col(group).isNotNull()).select(key, group, F.col(value).cast("double").alias("value")), key, repeats, n, seed, (group,))
    return drawn.groupBy("repeat", group).agg(F.count(F.lit(1)).alias("n"), F.mean("value").alias("mean"))


def draw_tests(drawn: DataFrame, group: str, value: str) -> DataFrame:
    """Of rows with the number of their draw (repeat): test, a, b, repeat and p. anova and levene of all groups (a and b null),
    tukey and levene of each pair of groups."""
    drawn = scratch_copy(drawn.where(F.col(value).isNotNull()).select("repeat", F.col(group).alias("grp"), F.col(value).cast("double").alias("v")))
    by = ("repeat",)
    none = F.lit(None).cast(drawn.schema["grp"].dataType)
    whole = [f(drawn, "grp", "v", by).select(F.lit(name).alias("test"), none.alias("a"), none.alias("b"), "repeat", "p") for name, f in (("anova", anova), ("levene", levene))]
    pairs = tukey(drawn, "grp", "v", by).select(F.lit("tukey").alias("test"), "a", "b", "repeat", "p")
    # groups, few, with each other
    names = drawn.select("grp").distinct()
    two = names.select(F.col("grp").alias("a")).join(names.select(F.col("grp").alias("b")), F.col("a") < F.col("b"))
    both = drawn.join(two, (F.col("grp") == F.col("a")) | (F.col("grp") == F.col("b")))
    apart = levene(both, "grp", "v", ("repeat", "a", "b")).select(F.lit("levene").alias("test"), "a", "b", "repeat", "p")
    return whole[0].unionByName(whole[1]).unionByName(pairs).unionByName(apart)


def scratch_copy(df: DataFrame) -> DataFrame:
    """A table that is read several times, written once."""
    return Scratch(df.sparkSession, "stats").write(df, "rows")


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """test, a, b, draws and significant: in how many draws p is below the level."""
    return tests.groupBy("test", "a", "b").agg(F.count(F.lit(1)).alias("draws"), F.count_if(F.col("p") < level).alias("significant"))


def paired_draws(a: DataFrame, b: DataFrame, key: str, value: str, repeats: int, n: int, seed: int = 0) -> DataFrame:
    """repeat, n, t and p of paired tests: draws of both samples, paired by their places. Pairs with a null are left out."""
    one, other = (draws(df.select(key, F.col(value).cast("double").alias("value")), key, repeats, n, seed + k).select("repeat", "place", F.col("value").alias(f"v{k}")) for k, df in enumerate((a, b)))
    d = F.col("v0") - F.col("v1")
    out = one.join(other, ["repeat", "place"]).groupBy("repeat").agg(F.count(d).alias("n"), F.try_divide(F.mean(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))
    return out.withColumn("p", distributions.t_tail(F.col("t"), F.col("n") - 1))


def f_tail(f: float, df1: float, df2: float) -> float:
    """The chance of a larger F."""
    return 1.0 if f <= 0 else _beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_tail(t: float, df: float) -> float:
    """The chance of a larger t, either side."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by numerical integration in the angle that takes the poles away."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    import numpy as np

    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    points, weights = np.polynomial.legendre.leggauss(200)

    def part(low: float, high: float) -> float:
        edges = np.linspace(low, high, 41)
        total = 0.0
        for p, q in zip(edges, edges[1:]):
            angle = (q - p) / 2 * points + (p + q) / 2
            total += (q - p) / 2 * float(weights @ (2 * np.exp(scale + (2 * a - 1) * np.log(np.sin(angle)) + (2 * b - 1) * np.log(np.cos(angle)))))
        return total

    return min(1.0, part(0.0, math.asin(math.sqrt(x))))
