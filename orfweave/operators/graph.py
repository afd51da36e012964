"""The weighted ORF graph: nodes, and the families of edges between them.

Edges have contig_id, source and target (structs gene, type, frame, position), kind, length, p and cost.
Nodes within reach are found by going along stretches of contigs, sorted by place: what ends a gene is met with what
begins one and the other way round, so the work follows the edges, also where starts lie side by side. Where few places
are asked for, a band join does: an equi-join on buckets of the reach's width, each left row in its own bucket and the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfweave.functions.sequence import gap_cost, overlap_cost
from orfweave.params import DEFAULT, Params

TRNA_WEIGHT = -20.0
#: Bases of a stretch that a task goes along; nodes within reach of its end are in it as well.
STRETCH = 32768
KINDS = ("gap_same", "gap_diff", "overlap_same", "overlap_diff")
#: Pairs handed on at once.
_PAIRS = 1 << 18
#: Nodes as numbers sort as their texts do (see paths): by position, then these.
FRAMES, TYPES, GENES = (-1, -2, -3, -4, 0, 1, 2, 3, 4), ("source", "start", "stop", "target"), ("CDS", "source", "tRNA", "target")
PER = len(FRAMES) * len(TYPES) * len(GENES)
SOURCE = 4 * len(TYPES) * len(GENES) + GENES.index("source")


def node(gene, type_, frame, position) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(gene).alias("gene"), lit(type_).alias("type"), lit(frame).cast("int").alias("frame"), lit(position).cast("int").alias("position"))


def number(node: Column) -> Column:
    """A node as a number that sorts by position, then strand and frame, type and gene."""
    frame = F.when(node["frame"] < 0, -1 - node["frame"]).otherwise(node["frame"] + 4).cast("bigint")
    place = lambda x, known: reduce(lambda c, k: c.when(x == known[k], k), range(1, len(known)), F.when(x == known[0], 0)).cast("bigint")
    return ((node["position"].cast("bigint") * len(FRAMES) + frame) * len(TYPES) + place(node["type"], TYPES)) * len(GENES) + place(node["gene"], GENES)


def numbers(position: np.ndarray, frame: np.ndarray, opens: np.ndarray, trna: np.ndarray) -> np.ndarray:
    """number() of starts and stops."""
    frame = np.where(frame < 0, -1 - frame, frame + 4).astype(np.int64)
    return ((position * len(FRAMES) + frame) * len(TYPES) + np.where(opens, TYPES.index("start"), TYPES.index("stop"))) * len(GENES) + np.where(trna, GENES.index("tRNA"), GENES.index("CDS"))


def targets(position: np.ndarray) -> np.ndarray:
    """number() of targets."""
    return ((position * len(FRAMES) + FRAMES.index(0)) * len(TYPES) + TYPES.index("target")) * len(GENES) + GENES.index("target")


def contig_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows in order of contig_id as tables of whole contigs: what a batch has of its last contig waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("contig_id")
        new = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(ids) > 1 else np.zeros(0, np.int64)
        if waiting and waiting[-1].column("contig_id")[-1] != ids[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if len(new):
            last = int(new[-1])
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = [batch.slice(last)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def band_join(left: DataFrame, right: DataFrame, width: int, key: str = "contig_id", l: str = "l", r: str = "r", low: int = 0) -> DataFrame:
    """Pairs of one key with low < r - l < width, low not negative."""
    bucket = lambda c: F.floor(F.col(c) / width)
    near = left.withColumn("bucket", F.explode(F.array(bucket(l), bucket(l) + 1)))
    pairs = near.join(right.withColumn("bucket", bucket(r)), [key, "bucket"]).drop("bucket")
    return pairs.where((F.col(r) - F.col(l) > low) & (F.col(r) - F.col(l) < width))


def orf_edges(scored: DataFrame) -> DataFrame:
    """Start to stop forward, stop to start backward: along the contig either way."""
    start, stop = node("CDS", "start", F.col("frame"), F.col("start")), node("CDS", "stop", F.col("frame"), F.col("stop"))
    ahead = F.col("strand") > 0
    return scored.select("contig_id", F.when(ahead, start).otherwise(stop).alias("source"), F.when(ahead, stop).otherwise(start).alias("target"), F.lit("orf").alias("kind"), "length", F.col("pstop").alias("p"), F.col("score").alias("cost"), "ln_score")


def nodes(orfs: DataFrame, contigs: DataFrame, trnas: DataFrame | None = None) -> DataFrame:
    """contig_id, gene, type, frame, position, other (a stop's farthest start, a start's stop), p (a stop's longest ORF's
    pstop, else the contig's), pgap, length. contigs: contig_id, length, pstop."""
    far = F.max_by(F.struct("start", "pstop"), "length")
    stops = orfs.groupBy("contig_id", "frame", F.col("stop").alias("position")).agg(far.alias("far"))
    stops = stops.select("contig_id", F.lit("CDS").alias("gene"), F.lit("stop").alias("type"), "frame", "position", F.col("far.start").alias("other"), F.col("far.pstop").alias("p"))
    starts = orfs.select("contig_id", F.lit("CDS").alias("gene"), F.lit("start").alias("type"), "frame", F.col("start").alias("position"), F.col("stop").alias("other"), F.lit(None).cast("double").alias("p"))
    out = stops.unionByName(starts)
    if trnas is not None:
        out = out.unionByName(trna_nodes(trnas))
    own = contigs.select("contig_id", F.col("length").alias("contig_length"), F.col("pstop").alias("pgap"))
    return out.join(own, "contig_id").withColumn("p", F.coalesce("p", "pgap"))


def trna_ends(trnas: DataFrame) -> DataFrame:
    """contig_id, start, stop (start > stop: backward) to one row each with its frame and leftmost codon bases."""
    ahead = F.col("start") < F.col("stop")
    return trnas.select("contig_id", F.when(ahead, 4).otherwise(-4).alias("frame"), F.when(ahead, F.col("start")).otherwise(F.col("stop")).alias("low"), (F.when(ahead, F.col("stop")).otherwise(F.col("start")) - 2).alias("high"))


def trna_nodes(trnas: DataFrame) -> DataFrame:
    ends = trna_ends(trnas)
    ahead = F.col("frame") > 0
    low = F.struct(F.when(ahead, "start").otherwise("stop").alias("type"), F.col("low").alias("position"), F.col("high").alias("other"))
    high = F.struct(F.when(ahead, "stop").otherwise("start").alias("type"), F.col("high").alias("position"), F.col("low").alias("other"))
    both = ends.select("contig_id", "frame", F.inline(F.array(low, high)))
    return both.select("contig_id", F.lit("tRNA").alias("gene"), "type", "frame", "position", "other", F.lit(None).cast("double").alias("p"))


def trna_edges(trnas: DataFrame) -> DataFrame:
    ends = trna_ends(trnas)
    first, last = F.when(F.col("frame") > 0, "start").otherwise("stop"), F.when(F.col("frame") > 0, "stop").otherwise("start")
    return ends.select("contig_id", node("tRNA", first, F.col("frame"), F.col("low")).alias("source"), node("tRNA", last, F.col("frame"), F.col("high")).alias("target"), F.lit("tRNA").alias("kind"), (F.col("high") - F.col("low") + 3).alias("length"), F.lit(None).cast("double").alias("p"), F.lit(TRNA_WEIGHT).alias("cost"), F.lit(None).cast("double").alias("ln_score"))


def disjoint_trnas(first: DataFrame, second: DataFrame) -> DataFrame:
    """Those of the first scan, and those of the second that overlap none of the first. Spans are half open.

    Both scans' spans are put in order of their lower ends, and the farthest end of the first scan so far is carried along:
    a span overlaps one that begins before it if that end lies beyond its begin. What begins within it is told by the next
    begin of the first scan. So no span is joined with another, however many there are in a place.
    """
    span = lambda df, own: df.select("contig_id", "start", "stop", F.least("start", "stop").alias("a"), F.greatest("start", "stop").alias("b"), F.lit(own).alias("own"))
    both = span(first, True).unionByName(span(second, False))
    along, back = (Window.partitionBy("contig_id").orderBy(a) for a in (F.col("a"), F.col("a").desc()))
    own_end, own_begin = F.max(F.when(F.col("own"), F.col("b"))), F.min(F.when(F.col("own"), F.col("a")))
    rows = both.withColumns({
        "reach": own_end.over(along.rangeBetween(Window.unboundedPreceding, 0)),
        # an empty span lies within those only that begin before it
        "earlier": own_end.over(along.rangeBetween(Window.unboundedPreceding, -1)),
        # down from the last one: a frame that goes on to the last row is gone through again for each row
        "next": own_begin.over(back.rangeBetween(Window.unboundedPreceding, -1)),
    })
    reach = F.when(F.col("a") < F.col("b"), F.col("reach")).otherwise(F.col("earlier"))
    meets = F.coalesce(reach > F.col("a"), F.lit(False)) | F.coalesce(F.col("next") < F.col("b"), F.lit(False))
    return rows.where(F.col("own") | ~meets).select("contig_id", "start", "stop")


def _sides(nodes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = ("gene", "type", "frame", "other", "p")
    left = nodes_.select("contig_id", "contig_length", "pgap", F.col("position").alias("l"), *(F.col(c).alias(f"l_{c}") for c in columns))
    right = nodes_.select("contig_id", F.col("position").alias("r"), *(F.col(c).alias(f"r_{c}") for c in columns))
    return left, right


def connections(nodes_: DataFrame, params: Params = DEFAULT, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Gaps from left to right and overlaps from right to left between nodes less than reach apart; of these kinds."""
    columns = ("gene", "type", "frame", "other", "p")
    size = max(STRETCH, params.reach)
    at = F.expr(f"position div {size}").cast("int")
    # those within reach of a stretch's end are met by its own nodes
    stretches = F.when((F.col("position") >= size) & (F.col("position") % size < params.reach), F.array(at, at - 1)).otherwise(F.array(at))
    placed = nodes_.where("contig_id IS NOT NULL").select("contig_id", F.explode(stretches).alias("stretch"), "position", "pgap", *columns)
    placed = placed.select("contig_id", "stretch", "position", "pgap", _ends().alias("ends"), (F.col("gene") == "tRNA").alias("trna"), (F.col("type") == "start").alias("opens"), F.col("frame").cast("int").alias("frame"), F.col("other").cast("int").alias("other"), "p")
    n = int(nodes_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = placed.repartition(n, "contig_id", "stretch").sortWithinPartitions("contig_id", "stretch", "position")
    kind = nodes_.schema["contig_id"].dataType.simpleString()
    pairs = sorted_.mapInArrow(_sweep(params.reach, size, kinds), f"contig_id {kind}, kind int, p double, " + ", ".join(f"{s} int, {s}_frame int, {s}_trna boolean, {s}_opens boolean" for s in "lr"))
    named = {f"{s}_gene": F.when(F.col(f"{s}_trna"), "tRNA").otherwise("CDS") for s in "lr"} | {f"{s}_type": F.when(F.col(f"{s}_opens"), "start").otherwise("stop") for s in "lr"}
    return _costed(pairs.withColumns(named).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), params)


def _ends() -> Column:
    """Whether a node is the right end of a gene; else it is the left one."""
    opens = F.col("type") == "start"
    return F.when(F.col("frame") > 0, ~opens).otherwise(opens)


_NODE = ("frame", "trna", "opens")


def _sweep(reach: int, size: int, kinds: tuple[str, ...]):
    """Pairs of nodes within reach of each other, of rows sorted by contig, stretch and position. Nodes whose reach goes beyond
    the rows that came so far wait for the next ones."""
    asked = [k in kinds for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            rows = some if waiting is None else pa.concat_tables([waiting, some])
            rows = rows.combine_chunks()
            if not rows.num_rows:
                continue
            key = _keys(rows)
            done = int(np.searchsorted(key, key[-1] - reach, "right"))
            yield from met(rows, key, done)
            waiting = rows.slice(done)
        if waiting is not None and waiting.num_rows:
            yield from met(waiting, _keys(waiting), waiting.num_rows)

    def met(rows: pa.Table, key: np.ndarray, done: int) -> Iterator[pa.RecordBatch]:
        x = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "contig_id"}
        # a node lies in the stretch before its own only to be met
        own = (np.arange(len(key)) < done) & (x["position"] // size == x["stretch"])
        for kind, p, l, r in _met(x, key, own, reach, asked):
            sides = [pa.array(x[c][i]) for i in (l, r) for c in ("position", *_NODE)]
            contig = rows.column("contig_id").combine_chunks().take(pa.array(l))
            yield pa.RecordBatch.from_arrays([contig, pa.array(kind), pa.array(p), *sides], ["contig_id", "kind", "p", *(f"{s}_{c}" if c else s for s in "lr" for c in ("", *_NODE))])

    return run


def _met(x: dict[str, np.ndarray], key: np.ndarray, own: np.ndarray, reach: int, asked: list[bool]) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of nodes in order of key, the left one among own: places in KINDS, p, and the nodes' places."""
    ends = x["ends"]
    for gap in (True, False):
        if not any(asked[:2] if gap else asked[2:]):
            continue
        left, right = np.flatnonzero(own & (ends == gap)), np.flatnonzero(ends != gap)
        low, high = np.searchsorted(key[right], key[left], "right"), np.searchsorted(key[right], key[left] + reach, "left")
        sizes = high - low
        total = np.cumsum(sizes)
        cuts = np.searchsorted(total, np.arange(_PAIRS, int(total[-1]) if len(total) else 0, _PAIRS))
        for part in np.split(np.arange(len(left)), cuts):
            n = sizes[part]
            l = np.repeat(left[part], n)
            r = right[np.repeat(low[part] - np.cumsum(n) + n, n) + np.arange(len(l))]
            kind, l, r = _gaps(x, l, r) if gap else _overlaps(x, l, r)
            keep = np.array(asked)[kind]
            kind, l, r = kind[keep], l[keep], r[keep]
            if len(l):
                yield kind, x["pgap"][l] if gap else (x["p"][l] + x["p"][r]) / 2, l, r


def _keys(rows: pa.Table) -> np.ndarray:
    """Numbers that grow along the rows by their positions, and by more than any position between stretches."""
    new = np.zeros(rows.num_rows, np.int64)
    for c in ("contig_id", "stretch"):
        values = rows.column(c).combine_chunks()
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return (np.cumsum(new) << 40) + rows.column("position").to_numpy()


def _gaps(x: dict[str, np.ndarray], l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in KINDS of what ends a gene, then begins one, and those pairs."""
    same = ((x["frame"][l] > 0) == (x["frame"][r] > 0)) | x["trna"][l] | x["trna"][r]
    keep = same | ~x["opens"][l] | (x["position"][r] - x["position"][l] > 2)
    return np.where(same, 0, 1).astype(np.int32)[keep], l[keep], r[keep]


def _overlaps(x: dict[str, np.ndarray], l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in KINDS of what begins a gene and what ends one that began before it, and those pairs."""
    position, other, frame, opens = x["position"], x["other"], x["frame"], x["opens"]
    keep = ~(x["trna"][l] | x["trna"][r]) & (position[r] < other[l]) & (other[r] < position[l])
    l, r = l[keep], r[keep]
    same = (frame[l] > 0) == (frame[r] > 0)
    keep = np.where(same, frame[l] != frame[r], opens[l] | (other[r] + 3 < position[l]))
    return np.where(same, 2, 3).astype(np.int32)[keep], l[keep], r[keep]


def _edges(pairs: DataFrame, params: Params) -> DataFrame:
    return _costed(pairs.withColumn("p", F.when(F.col("kind").startswith("gap"), F.col("pgap")).otherwise((F.col("l_p") + F.col("r_p")) / 2)), params)


def _costed(pairs: DataFrame, params: Params) -> DataFrame:
    gap = F.col("kind").startswith("gap")
    direction = F.substring_index("kind", "_", -1)
    length = F.col("r") - F.col("l") + F.when(gap, -3).otherwise(3)
    left, right = (node(F.col(f"{s}_gene"), F.col(f"{s}_type"), F.col(f"{s}_frame"), F.col(s)) for s in "lr")
    rows = pairs.select("contig_id", F.when(gap, left).otherwise(right).alias("source"), F.when(gap, right).otherwise(left).alias("target"), "kind", length.alias("length"), "p", direction.alias("direction"), gap.alias("gap"))
    cost = F.when(F.col("gap"), gap_cost(F.col("length"), F.col("direction"), F.col("p"), params.linear_gap, params.strand_chance)).otherwise(overlap_cost(F.col("length"), F.col("direction"), F.col("p"), params.strand_chance))
    return rows.select("contig_id", "source", "target", "kind", "length", "p", cost.alias("cost"), F.lit(None).cast("double").alias("ln_score"))


def edges_along(own: DataFrame, scored: DataFrame, longest: DataFrame, contigs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """build()'s edges, a contig's next to each other and with its nodes as numbers: contig_id, s, t, cost, ln_score, orf (whether
    it is an ORF's). What is moved for it is a row a node, with its ORF's score, and the edges over stretches without ORFs;
    all other edges are made where a contig's nodes are, so they are neither moved nor written. own: the contigs' nodes()."""
    none = lambda kind: F.lit(None).cast(kind)
    about = contigs.select("contig_id", F.col("length").alias("contig_length"), "pstop")
    starts = scored.select("contig_id", F.lit("CDS").alias("gene"), F.lit("start").alias("type"), "frame", F.col("start").alias("position"), F.col("stop").alias("other"), F.col("score").alias("cost"), "ln_score")
    starts = starts.join(about, "contig_id").withColumnsRenamed({"pstop": "pgap"}).withColumn("p", F.col("pgap"))
    others = own.where("type <> 'start' OR gene <> 'CDS'").withColumns({"cost": F.when(F.col("gene") == "tRNA", TRNA_WEIGHT), "ln_score": none("double")}).select(*starts.columns)
    rows = others.unionByName(starts).where("contig_id IS NOT NULL")
    rows = rows.select("contig_id", F.col("position").cast("int").alias("position"), "pgap", F.col("contig_length").cast("int").alias("contig_length"), _ends().alias("ends"), (F.col("gene") == "tRNA").alias("trna"), (F.col("type") == "start").alias("opens"), F.col("frame").cast("int").alias("frame"), F.col("other").cast("int").alias("other"), "p", "cost", "ln_score", none("bigint").alias("s"), none("bigint").alias("t"))
    far = long_gaps(own, coverage_gaps(longest, contigs, params.reach), params).select("contig_id", number(F.col("source")).alias("s"), number(F.col("target")).alias("t"), "cost")
    rows = rows.unionByName(far, allowMissingColumns=True)
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, "contig_id").sortWithinPartitions("contig_id", "position")
    kind = own.schema["contig_id"].dataType.simpleString()
    found = sorted_.mapInArrow(_along(params), f"contig_id {kind}, s bigint, t bigint, gap boolean, differ boolean, length int, p double, cost double, ln_score double, orf boolean")
    direction = F.when(F.col("differ"), "diff").otherwise("same")
    cost = F.when(F.col("gap"), gap_cost(F.col("length"), direction, F.col("p"), params.linear_gap, params.strand_chance)).otherwise(overlap_cost(F.col("length"), direction, F.col("p"), params.strand_chance))
    return found.select("contig_id", "s", "t", F.when(F.col("length").isNull(), F.col("cost")).otherwise(cost).alias("cost"), "ln_score", "orf")


def _along(params: Params):
    """Nodes of whole contigs in order of their places, and edges that are there already, to all edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in contig_batches(batches):
            yield from met(rows)

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("contig_id").combine_chunks()
        new = np.zeros(len(ids), np.int64)
        new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        contig, known = np.cumsum(new), rows.column("s").is_valid().to_numpy()
        own = rows.filter(pa.array(~known))
        x = {c: own.column(c).to_numpy() for c in own.column_names if c not in ("contig_id", "s", "t")}
        at, position, ahead = contig[~known], x["position"].astype(np.int64), x["frame"] > 0
        node = numbers(position, x["frame"], x["opens"], x["trna"])
        key = (at << 40) + position
        parts = []

        def add(contig, s, t, gap=None, differ=None, length=None, p=None, cost=None, ln_score=None, orf=False):
            parts.append((contig, *(np.broadcast_to(np.asarray(v), len(contig)) if v is not None else None for v in (s, t, gap, differ, length, p, cost, ln_score, orf))))

        for kind, p, l, r in _met(x, key, np.ones(len(key), bool), params.reach, [True] * len(KINDS)):
            gap = kind < 2
            add(at[l], np.where(gap, node[l], node[r]), np.where(gap, node[r], node[l]), gap, kind % 2 == 1, position[r] - position[l] + np.where(gap, -3, 3), p)
        # an ORF's start leads to its stop, backward from it; of a tRNA's ends the left one has the edge
        of_orf = x["opens"] & ~x["trna"]
        other = numbers(x["other"].astype(np.int64), x["frame"], ~x["opens"], x["trna"])
        for some, turned, orf in ((of_orf & ahead, False, True), (of_orf & ~ahead, True, True), (x["trna"] & ~x["ends"], False, False)):
            a, b = (other, node) if turned else (node, other)
            add(at[some], a[some], b[some], cost=x["cost"][some], ln_score=x["ln_score"][some], orf=orf)
        first = ~x["ends"] & (position <= params.end_reach)
        add(at[first], SOURCE, node[first], True, False, position[first], x["pgap"][first])
        left = x["contig_length"] - position
        last = x["ends"] & (left <= params.end_reach)
        add(at[last], node[last], targets(x["contig_length"][last].astype(np.int64) + 1), True, False, left[last], x["pgap"][last])
        far = rows.filter(pa.array(known))
        add(contig[known], far.column("s").to_numpy(), far.column("t").to_numpy(), cost=far.column("cost").to_numpy())
        owner = np.concatenate([p[0] for p in parts])
        order = np.argsort(owner, kind="stable")
        begins = np.flatnonzero(np.append(True, new[1:]))
        columns = [ids.take(pa.array(begins[owner[order]]))]
        for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()), 1):
            some = [pa.nulls(len(p[0]), kind) if p[k] is None else pa.array(p[k], from_pandas=kind == pa.float64()).cast(kind) for p in parts]
            columns.append(pa.concat_arrays(some).take(pa.array(order)))
        whole = pa.RecordBatch.from_arrays(columns, ["contig_id", "s", "t", "gap", "differ", "length", "p", "cost", "ln_score", "orf"])
        for k in range(0, whole.num_rows, _PAIRS):
            yield whole.slice(k, _PAIRS)

    return run


def coverage_gaps(longest: DataFrame, contigs: DataFrame, width: int = 500) -> DataFrame:
    """contig_id, last, base: stretches over width without an ORF, from the last covered base to the next. Base 0 counts as
    covered; a stretch at the end doesn't count."""
    low, high = F.least("start", "stop"), F.greatest("start", "stop")
    spans = longest.join(contigs.select("contig_id", F.col("length").alias("contig_length")), "contig_id").select("contig_id", low.alias("low"), (F.least(high, F.col("contig_length") - 1) - 1).alias("high")).where("high >= low")
    order = Window.partitionBy("contig_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("last", F.coalesce(F.max("high").over(order), F.lit(0)))
    return spans.where(F.col("low") - F.col("last") > width).select("contig_id", "last", F.col("low").alias("base"))


def long_gaps(nodes_: DataFrame, gaps: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Edges over stretches without ORFs, from what ends before to what begins after."""
    own = nodes_.where("gene = 'CDS'")
    before, right = _sides(own.where(_ends()))[0], _sides(own.where(~_ends()))[1]
    reach = params.reach
    gaps = gaps.withColumn("gap_number", F.monotonically_increasing_id())
    # a stretch's edges reach over it: each side is a band of its own
    near = band_join(gaps.withColumn("edge", F.col("last") + 1), before.withColumn("l_shift", F.col("l") + reach), reach + 2, l="edge", r="l_shift", low=-1)
    near = near.where((F.col("l") <= F.col("last") + 1) & (F.col("l") > F.col("last") - reach)).drop("edge", "l_shift")
    pairs = band_join(near.withColumn("edge", F.col("base") - 2), right, reach + 2, l="edge", r="r").drop("edge")
    pairs = pairs.where((F.col("r") >= F.col("base") - 1) & (F.col("r") < F.col("base") + reach))
    same = F.col("l_frame") * F.col("r_frame") > 0
    differ = F.col("l_type") != F.col("r_type")
    kind = F.when(same & differ, "gap_same").when(~same & ~differ, "gap_diff")
    kinds = pairs.withColumn("kind", kind).where("kind IS NOT NULL").dropDuplicates(["contig_id", "l", "l_type", "l_frame", "r", "r_type", "r_frame"])
    return _edges(kinds, params).withColumn("kind", F.concat(F.lit("long_"), F.col("kind")))


def end_edges(nodes_: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """From the source to what begins a gene near the contig's start, and from what ends one near its end to the target."""
    begins = F.when(F.col("frame") > 0, F.col("type") == "start").otherwise(F.col("type") == "stop")
    own = node(F.col("gene"), F.col("type"), F.col("frame"), F.col("position"))
    first = nodes_.where(begins & (F.col("position") <= params.end_reach)).select("contig_id", node("source", "source", 0, 0).alias("source"), own.alias("target"), F.lit("source").alias("kind"), F.col("position").alias("length"), F.col("pgap").alias("p"))
    left = F.col("contig_length") - F.col("position")
    last = nodes_.where(~begins & (left <= params.end_reach)).select("contig_id", own.alias("source"), node("target", "target", 0, F.col("contig_length") + 1).alias("target"), F.lit("target").alias("kind"), left.alias("length"), F.col("pgap").alias("p"))
    both = first.unionByName(last)
    cost = gap_cost(F.col("length"), F.lit("same"), F.col("p"), params.linear_gap, params.strand_chance)
    return both.select("*", cost.alias("cost"), F.lit(None).cast("double").alias("ln_score"))


def build(scored: DataFrame, own: DataFrame, contigs: DataFrame, longest: DataFrame, trnas: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """All edges of all contigs. own: their nodes()."""
    parts = [orf_edges(scored), long_gaps(own, coverage_gaps(longest, contigs, params.reach), params), connections(own, params), end_edges(own, params)]
    if trnas is not None:
        parts.append(trna_edges(trnas))
    return reduce(DataFrame.unionByName, parts)


def proximity(orfs: DataFrame, width: int = 300) -> DataFrame:
    """Pairs of different ORFs of a contig, right end of one within width of the left end of the other, either side."""
    low, high = F.least("start", "stop"), F.greatest("start", "stop")
    ends = orfs.select("contig_id", low.alias("low"), high.alias("high"))
    shifted = ends.select("contig_id", (F.col("high") - 1).alias("l"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    others = ends.select("contig_id", (F.col("low") + width).alias("r"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    pairs = band_join(shifted, others, 2 * width + 2)
    return pairs.where((F.col("a_low") != F.col("b_low")) & (F.col("a_high") != F.col("b_high"))).drop("l", "r")
