"""Operator 4, mixing sources to target weights by entropy balancing.

Among all document rates between 0 and MOST that give each source its target of words, the mix takes the
one nearest to rate 1 in relative entropy (with the logit distance, which keeps rates between the bounds):
an exponential tilt of the document's size,

    odds(rate / MOST) = odds(1 / MOST) * exp(lambda_source * size),

whose lambda is the solution of a convex dual in one unknown a source. Documents are first summed up to strata, a
table of (source, size) with counts; a Newton iteration is one aggregate over the strata of all sources that joins each
with its source's lambda so far, and a bracket turns a step that leaves it into a bisection. A dual that isn't solved
after ITERATIONS is an error. Every document has the rate of its own size, however long its text is.

Rates become whole copies. For that, sizes fall into classes, exact below 128 words and 1/64 of an octave wide
above, so a source has at most a few thousand. In a source, classes are taken from the largest down; each gets the
number of copies nearest to its documents' rates and what the larger classes left over, so the smallest class
carries the last rounding error. Within a class every document gets the same whole part and the first ones by
hash get one copy more; the rank by hash is counted in cells of about CELL rows, so that a stratum that
holds a third of all rows is still ranked in small groups.

Weights go to the sources in code point order, null last, in turn; targets stop at MOST times a source's
size, and what that leaves is shared again among the others. Null texts have size 0; a document of size 0
gets one copy and takes nothing. A total of zero gives targets of zero. Repeated rows are documents of their
own; mixed_documents() gives out what they take together. Reruns agree: no random numbers, and ties only between
rows that are alike in id, source and size. Further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, partitions, table, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
ITERATIONS = 80
#: Relative gaps to the targets at which iterations end, and above which the dual counts as unsolved.
TOLERANCE, UNSOLVED = 1e-9, 1e-6
CELL = 512
#: Where the bracket of a tilt begins and ends, for sizes relative to their mean.
_FAR = 1e6
_SEED = 7_919


def word_count(text_column: str = "text") -> Column:
    return F.regexp_count(whole_text(text_column), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Classes that grow with the size: one a size below 128, then 64 an octave."""
    octave = F.floor(F.log2(size.cast("double"))).cast("int")
    fine = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * 64).cast("int")
    return F.when(size < 128, size.cast("int")).otherwise(128 + (octave - 7) * 64 + fine)


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source and source_size to those and target. The driver sees two sums a round."""
    ranked = _ranked(sizes, scratch)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = scratch.write(ranked.withColumn("weight", weight), "weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    # target = min(most * size, level * weight); the level rises until the targets share out the total
    level, capped = 0.0, -1
    while True:
        cap = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = weighted.agg(F.count_if(cap).alias("n"), F.sum(F.when(cap, most * F.col("source_size"))).alias("fixed"), F.sum(F.when(~cap, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - (row["fixed"] or 0)) / row["open"]
    # where each source is at its bound, nothing is left to share
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def _ranked(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their place in code point order from 0, null last, counted over ranges."""
    order = F.col("source").asc_nulls_last()
    ranged = scratch.write(sizes.repartitionByRange(partitions(sizes.sparkSession), order).withColumn("part", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("within")).alias("rank"))


def _rate(tilt: Column, most: int) -> Column:
    return most / (1 + (most - 1) * F.exp(-tilt))


def _clipped(tilt: Column) -> Column:
    return F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt))


def solve(strata: DataFrame, targets: DataFrame, scratch: Scratch, most: int = MOST, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """The dual: source, source_size and target to those and scale (the mean size), tilt (of sizes relative to it) and bound
    (true where every rate is at the upper bound). A round is one aggregate over the strata of all sources that aren't solved
    yet; the driver sees the largest gap."""
    bound = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    settled = bound | (F.col("source_size") == 0)
    means = strata.groupBy("source").agg(F.greatest(F.lit(1e-9), F.sum("words") / F.greatest(F.lit(1), F.sum("n"))).alias("scale"))
    state = targets.withColumnsRenamed({"source": "own"}).join(means, F.col("own").eqNullSafe(F.col("source")))
    gap = F.when(settled, F.lit(0.0)).otherwise(F.lit(float("inf")))
    state = state.select("source", "source_size", "target", "scale", bound.alias("bound"), F.lit(0.0).alias("tilt"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"), gap.alias("gap"))
    state = scratch.write(state, "dual")
    for done in range(iterations + 1):
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance or done == iterations:
            break
        before, state = state, scratch.write(_newton(strata, state, most, tolerance), "dual")
        scratch.drop(before)
    if worst is not None and worst > UNSOLVED:
        raise RuntimeError(f"the dual is off its target by {worst} after {iterations} iterations")
    return state.drop("low", "high", "gap")


def _newton(strata: DataFrame, state: DataFrame, most: int, tolerance: float) -> DataFrame:
    """state after one Newton iteration of every source whose gap is above the tolerance. Gradient and curvature are sums over
    strata, added up before they are moved, as decimals so that the order of adding doesn't count. A bracket turns a step
    that leaves it into a bisection."""
    todo = state.where(F.col("gap") > tolerance).withColumnRenamed("source", "own")
    x = F.col("size") / F.col("scale")
    rate = _rate(_clipped(F.col("tilt") * x), most)
    met = strata.select("source", "size", "words").join(todo, F.col("source").eqNullSafe(F.col("own"))).withColumn("rate", rate)
    total = lambda value: F.sum(value.cast("decimal(34,12)")).cast("double")
    taken, slope = total(F.col("words") * F.col("rate")), total(F.col("words") * F.col("rate") * (1 - F.col("rate") / most) * x)
    known = [c for c in state.columns if c not in ("source", "gap")]
    sums = met.groupBy("source").agg(*(F.first(c).alias(c) for c in known), (taken - F.first("target")).alias("over"), slope.alias("slope"))
    sums = sums.withColumn("gap", F.abs("over") / F.greatest(F.col("target"), F.lit(1.0)))
    near = F.col("gap") <= tolerance
    sums = sums.withColumns({"low": F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("over") < 0, F.col("high")).otherwise(F.col("tilt"))})
    step = F.col("tilt") - F.col("over") / F.greatest(F.col("slope"), F.lit(1e-300))
    inside = (step > F.col("low")) & (step < F.col("high"))
    moved = F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
    stepped = sums.withColumn("tilt", F.when(near, F.col("tilt")).otherwise(moved)).select(*state.columns)
    return state.where(F.col("gap") <= tolerance).unionByName(stepped)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per row: the id, size, source, source_size, target, rate and copies."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(text_column).alias("size"))
    sized = scratch.write(sized.withColumn("class", size_class(F.col("size"))), "sizes")
    return _copies(sized, scratch, weights, most).withColumnRenamed("id", id_column)


def _copies(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...], most: int) -> DataFrame:
    counts = sized.groupBy("source", "class", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    strata = scratch.write(counts, "strata")
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, weights, most)
    dual = solve(strata, targets, scratch, most)
    plan = scratch.write(_rounded(strata, dual, most), "plan")
    # cells of a stratum: by hash, in numbers that follow its size, each with its share of the stratum's extra copies
    plan = plan.withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")).withColumnRenamed("source", "of").withColumnRenamed("class", "of_class")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))
    hashed = F.xxhash64(F.col("id"), F.col("size"), F.lit(_SEED))
    placed = sized.join(plan, same).withColumn("hash", hashed).withColumn("cell", F.pmod(F.col("hash"), F.col("cells")).cast("int"))
    placed = scratch.write(placed.drop("of", "of_class"), "placed")
    cells = placed.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    # as many cells as a stratum has rows by CELL; their counts are summed up within the stratum
    upto = Window.partitionBy("source", "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    share = cells.withColumn("end", F.sum("rows").over(upto)).select(F.col("source").alias("of"), F.col("class").alias("of_class"), F.col("cell").alias("of_cell"), F.expr("extra * end div n - extra * (end - rows) div n").alias("more"))
    share = scratch.write(share, "cells")
    ranked = placed.withColumn("place", F.row_number().over(Window.partitionBy("source", "class", "cell").orderBy("hash", "id", "size")))
    ranked = ranked.join(share, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")) & (F.col("cell") == F.col("of_cell")))
    copies = F.col("base") + (F.col("place") <= F.col("more")).cast("int")
    kept = [c for c in sized.columns if c not in ("size", "class", "source")]
    return ranked.select(*kept, "size", "source", "source_size", "target", _own_rate(F.col("size"), F.col("size"), most).alias("rate"), copies.cast("int").alias("copies"))


def _own_rate(size: Column, words: Column, most: int) -> Column:
    """Of documents of a size in a source with tilt, scale and bound; those without words have rate 1."""
    tilt = _clipped(F.col("tilt") * size / F.col("scale"))
    return F.when(words == 0, F.lit(1.0)).when(F.col("bound"), F.lit(float(most))).otherwise(_rate(tilt, most))


def _rounded(strata: DataFrame, dual: DataFrame, most: int) -> DataFrame:
    """Classes with their source's dual, base (copies of every document) and extra (how many documents get one more)."""
    state = dual.withColumnRenamed("source", "own")
    rated = strata.join(state, F.col("source").eqNullSafe(F.col("own"))).withColumn("rate", _own_rate(F.col("size"), F.col("words"), most))
    of_class = F.sum(F.col("n") * F.col("rate")).alias("wish"), F.sum(F.col("words") * F.col("rate")).alias("due")
    first = [F.first(c).alias(c) for c in ("source_size", "target", "tilt", "scale", "bound")]
    classes = rated.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), *of_class, *first)
    # a source's size classes are bounded by the width of a count, not by its documents
    one = F.struct((-F.col("class")).alias("down"), F.col("class"), F.col("n"), (F.col("words") / F.col("n")).alias("mean"), "wish", "due")
    listed = classes.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "tilt", "scale", "bound")], F.array_sort(F.collect_list(one)).alias("classes"))
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<class:int,n:bigint,total:bigint>>").alias("out"))

    def take(state: Column, c: Column) -> Column:
        wish = c["wish"] + F.when(c["mean"] > 0, (state["left"] + c["due"] - c["wish"] * c["mean"]) / c["mean"]).otherwise(0.0)
        # sums that differ by their order alone must not fall on two sides of a half
        total = F.greatest(F.lit(0), F.least(c["n"] * most, F.round(F.round(wish, 6)).cast("long")))
        left = state["left"] + c["due"] - total * c["mean"]
        return F.struct(left.alias("left"), F.concat(state["out"], F.array(F.struct(c["class"].alias("class"), c["n"].alias("n"), total.alias("total")))).alias("out"))

    taken = listed.select("source", "source_size", "target", "tilt", "scale", "bound", F.explode(F.aggregate("classes", start, take)["out"]).alias("c"))
    base = F.expr("c.total div c.n")
    return taken.select("source", "source_size", "target", "tilt", "scale", "bound", F.col("c.class").alias("class"), F.col("c.n").alias("n"), base.alias("base"), (F.col("c.total") - base * F.col("c.n")).alias("extra"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents mixed to weights 5, 2, 1 by source."""
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns. Rows that repeat id, source and text are
    given out as often as the mix takes them together, with the columns of one of them."""
    scratch = Scratch(docs.sparkSession, "mix")
    text_key = F.xxhash64(whole_text(text_column))
    sized = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(text_column).alias("size"), text_key.alias("key"))
    sized = scratch.write(sized.withColumn("class", size_class(F.col("size"))), "sizes")
    copies = _copies(sized, scratch, weights, most).groupBy("id", "source", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    copies = scratch.write(copies.where("copies > 0"), "copies")
    own, to_id, to_source, to_key, rows, times, again = fresh(docs, "own_key", "to_id", "to_source", "to_key", "key_rows", "copies", "again")
    copies = copies.select(F.col("id").alias(to_id), F.col("source").alias(to_source), F.col("key").alias(to_key), F.col("rows").alias(rows), F.col("copies").cast("int").alias(times))
    marked = docs.withColumn(own, text_key)
    same = F.col(id_column).eqNullSafe(F.col(to_id)) & F.col(source_column).eqNullSafe(F.col(to_source)) & (F.col(own) == F.col(to_key))
    once = marked.join(copies.where(F.col(rows) == 1), same)
    repeated = marked.join(copies.where(F.col(rows) > 1), same).dropDuplicates([id_column, source_column, own])
    return once.unionByName(repeated).withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
