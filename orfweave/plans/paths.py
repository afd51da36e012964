"""The cheapest path along contigs of any length, block by block.

A contig is cut into blocks of so many bases. An edge whose ends lie in one block has level 0; another has the level at
which the halvings of the contig that hold its ends first meet: level 1 joins two neighbouring blocks, level 2 two such
pairs. Going up, a block's graph shrinks to a min-plus table, the cost from each node that edges of higher levels lead to
(an entry) to each that they leave from (an exit); tables of two halves and the edges between them make the next table.
Going down, costs from the source reach the entries of ever smaller parts. In a block they then settle every node's
predecessor, and for each exit how its block was crossed: a jump from the exit to the node before its entry. Jumps from
the target to the source are followed by doubling, in logarithmically many joins.

A task sees one block's edges, or two tables between boundary nodes, and never a contig. Costs are whole numbers of any
size, so they are exact, and paths are those that one task over the contig finds, ties included: a node's predecessor is
the lowest by position, strand and kind of those that reach its cost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal, localcontext
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfweave.operators import graph
from orfweave.plans.scratch import Scratch

#: Weights are multiplied by this and cut to whole numbers before paths are summed up.
PRECISION = 1000
#: Bases of a block; contigs up to this length are one.
BLOCK = 1 << 16
#: The level of what lies beyond all blocks.
_BEYOND = 99
SOURCE = "0000000000 0 source source"


def whole_cost(cost: float, ln_score: float | None) -> int:
    """Costs as whole numbers of any size. An ORF's comes from its logarithm, where a double would be infinite."""
    if ln_score is not None and ln_score == ln_score and ln_score > 600:
        with localcontext() as context:
            context.prec = 60
            return -int(Decimal(ln_score).exp() * PRECISION)
    return int(Decimal(cost) * PRECISION)


def node_key(node: Column) -> Column:
    """A node as text that sorts by position, then strand and frame, type and gene."""
    return F.format_string("%010d %d %s %s", node["position"], node["frame"], node["type"], node["gene"])


def whole_costs(cost: np.ndarray, ln_score: np.ndarray) -> list[int]:
    """whole_cost() of many; ln_score may be NaN. A product that rounding lifted to a whole number is told by its error,
    which splitting the factor in halves gives exactly."""
    with np.errstate(over="ignore", invalid="ignore"):
        product = cost * PRECISION
        plain = (np.abs(product) < 2.0**53) & ~(ln_score > 600)
        high = cost * 134217729.0
        high = high - (high - cost)
        error = (high * PRECISION - product) + (cost - high) * PRECISION
        whole = np.trunc(product)
        less = (whole == product) & (error * product < 0)
        out = np.where(plain, whole, 0.0).astype(np.int64) - np.where(plain & less, np.sign(product), 0.0).astype(np.int64)
    found = out.tolist()
    for k in np.flatnonzero(~plain).tolist():
        found[k] = whole_cost(float(cost[k]), float(ln_score[k]))
    return found


#: Nodes as numbers sort as node_key() sorts their texts.
_FRAMES, _TYPES, _GENES, _PER = graph.FRAMES, graph.TYPES, graph.GENES, graph.PER
node_number, contig_batches = graph.number, graph.contig_batches


def calls_of(rows: pa.Table) -> pa.RecordBatch:
    """Whole contigs' edges (contig_id, s, t, cost, ln_score; a contig's next to each other) to the pairs of their cheapest paths.
    Where orf says which edges are ORFs, pairs of their ends have their cost as score, and their ln_score."""
    ids = rows.column("contig_id").combine_chunks()
    number = lambda name: rows.column(name).to_numpy()
    s, t, costs = number("s"), number("t"), whole_costs(number("cost").astype(np.float64), number("ln_score").astype(np.float64))
    begins = np.append(0, np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1) if len(ids) else np.zeros(0, np.int64)
    target = _GENES.index("target")
    owners, counts, nodes = [], [], []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)]):
        ends = t[a:b][t[a:b] % len(_GENES) == target]
        path = cheapest_path(list(zip(s[a:b].tolist(), t[a:b].tolist(), costs[a:b])), graph.SOURCE, int(ends[0]))[1:] if len(ends) else []
        pairs = len(path) // 2
        owners.append(a)
        counts.append(pairs)
        nodes += path[: 2 * pairs]
    both, owner = np.array(nodes, np.int64).reshape(-1, 2), np.repeat(np.array(owners, np.int64), counts)
    place = np.arange(len(both)) - np.repeat(np.cumsum(counts) - counts, counts)
    scores = []
    if "orf" in rows.column_names:
        orf = np.flatnonzero(number("orf"))
        row, edge = _orfs_of(owner, both, begins[np.searchsorted(begins, orf, "right") - 1], s[orf], t[orf])
        scores = [pa.array(np.where(edge < 0, np.nan, number(c)[orf[edge]] if len(orf) else np.nan), from_pandas=True) for c in ("cost", "ln_score")]
        both, owner, place = both[row], owner[row], place[row]
    rest, position = both // len(_GENES) // len(_TYPES), both // _PER
    columns = [
        ids.take(pa.array(owner)),
        pa.array(place.astype(np.int32)),
        pa.array(_GENES).take(pa.array(both[:, 0] % len(_GENES))),
        pa.array(np.array(_FRAMES, np.int32)[rest[:, 0] % len(_FRAMES)]),
        *(pa.array(position[:, k].astype(np.int32)) for k in (0, 1)),
        *scores,
    ]
    return pa.RecordBatch.from_arrays(columns, ["contig_id", "number", "gene", "frame", "left", "right", *(("score", "ln_score") if scores else ())])


def _orfs_of(owner: np.ndarray, pairs: np.ndarray, contig: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs' places, each as often as its contig has ORFs with its frame, left and right, and those ORFs' places; -1 without one."""
    per = len(_GENES) * len(_TYPES)
    # a node's frame and position
    keys = [np.stack((c, a // per, b // _PER), 1) for c, a, b in ((owner, pairs[:, 0], pairs[:, 1]), (contig, s, t))]
    _, same = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
    of_pair, of_orf = same.reshape(-1)[: len(pairs)], same.reshape(-1)[len(pairs) :]
    order = np.argsort(of_orf, kind="stable")
    low, high = (np.searchsorted(of_orf[order], of_pair, side) for side in ("left", "right"))
    n = np.maximum(high - low, 1)
    row = np.repeat(np.arange(len(pairs)), n)
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(row))
    met = (high > low)[row]
    return row, np.where(met, np.append(order, -1)[np.where(met, at, -1)], -1)


def settle(edges: list[tuple], start: dict) -> tuple[dict, dict]:
    """Costs and predecessors of all nodes that lead on from start (node to cost). Weights may be negative; a cycle that
    gets ever cheaper is an error.

    Rounds go over the nodes along the contig, so all edges that lead on are settled in one round; each edge that
    leads back costs one more. Only nodes that changed are looked at again.
    """
    out, names = defaultdict(list), set(start)
    for a, b, w in edges:
        out[a].append((b, w))
        names.update((a, b))
    order = sorted(names)
    cost, before, open_ = dict(start), {}, set(start)
    for _ in range(len(names) + 1):
        if not open_:
            return cost, before
        for a in order:
            if a not in open_:
                continue
            open_.discard(a)
            here = cost[a]
            for b, w in out[a]:
                new = here + w
                if b not in cost or new < cost[b]:
                    cost[b], before[b] = new, a
                    open_.add(b)
                elif new == cost[b] and b in before and a < before[b]:
                    before[b] = a
    if not open_:
        return cost, before
    raise ValueError("the graph has a negative cycle")


def chain(node, before: dict, stop) -> list:
    """Nodes from after the one where stop holds up to node."""
    path, seen = [node], {node}
    while not stop(before[path[-1]]):
        path.append(before[path[-1]])
        if path[-1] in seen:
            raise ValueError("the graph has a cycle without cost")
        seen.add(path[-1])
    return path[::-1]


def cheapest_path(edges: list[tuple], source, target) -> list:
    """Nodes of the cheapest path, [] if there's none. Ties keep the predecessor that sorts first."""
    cost, before = settle(edges, {source: 0})
    return [source, *chain(target, before, lambda n: n == source)] if target in before else []


def table(edges: list[tuple], entries: list) -> dict:
    """node: ({entry's place: cost}) from each entry to all nodes; costs of one node are settled side by side."""
    out, names = defaultdict(list), set(entries)
    for a, b, w in edges:
        out[a].append((b, w))
        names.update((a, b))
    order, n = sorted(names), len(entries)
    cost = {a: np.zeros(n, object) for a in names}
    has = {a: np.zeros(n, bool) for a in names}
    open_ = {}
    for k, e in enumerate(entries):
        has[e][k] = True
        open_[e] = has[e].copy()
    for _ in range(len(names) + 1):
        if not open_:
            break
        for a in order:
            if (mask := open_.pop(a, None)) is None:
                continue
            own = np.flatnonzero(mask)
            here = cost[a][own]
            for b, w in out[a]:
                new, known = here + w, has[b][own]
                better = ~known
                better[known] = (new[known] < cost[b][own[known]]).astype(bool)
                if better.any():
                    at = own[better]
                    cost[b][at], has[b][at] = new[better], True
                    if b not in open_:
                        open_[b] = np.zeros(n, bool)
                    open_[b][at] = True
    if open_:
        raise ValueError("the graph has a negative cycle")
    return {a: {k: cost[a][k] for k in np.flatnonzero(has[a]).tolist()} for a in names}


# an edge or an entry of a table: s and t are keys of nodes, w a whole number; s_in is the highest level of the edges that
# lead to s, t_in of those to t, t_out of those that leave t; block is the part of the contig that holds both
_ROWS = "contig_id {kind}, block bigint, s string, t string, w string, s_in int, t_in int, t_out int"


def _contract(level: int):
    """A part's rows to its min-plus table between entries and exits."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        entries = sorted(set(rows["s"][rows["s_in"] > level]))
        leaves = rows[rows["t_out"] > level].drop_duplicates("t")
        found = table(list(zip(rows["s"], rows["t"], map(int, rows["w"]))), entries) if len(entries) else {}
        s_in = dict(zip(rows["s"], rows["s_in"]))
        first = rows.iloc[0]
        out = [(first["contig_id"], first["block"], entries[k], t, str(w), s_in[entries[k]], t_in, t_out) for t, t_in, t_out in zip(leaves["t"], leaves["t_in"], leaves["t_out"]) for k, w in found.get(t, {}).items() if entries[k] != t]
        return pd.DataFrame(out, columns=rows.columns)

    return one


# what is known of a node: its cost from the source; the highest levels of edges to and from it; its block
_KNOWN = "contig_id {kind}, node string, cost string, level_in int, level_out int"


def _descend(keep: str, level: int):
    """A part's rows, with costs of its entries as rows that begin at nothing, to costs of more of its nodes."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["s"] == ""
        start = {t: int(w) for t, w in zip(rows["t"][known], rows["w"][known])}
        edges = rows[~known]
        cost, _ = settle(list(zip(edges["s"], edges["t"], map(int, edges["w"]))), start) if start else ({}, {})
        # this level's edges may lead to an entry at less cost than those of higher levels
        ends = rows.drop_duplicates("t")
        ends = ends[(ends["t_in"] >= level) if keep == "entries" else (ends["t_out"] > 0)]
        out = [(rows["contig_id"].iloc[0], t, str(cost[t]), i, o) for t, i, o in zip(ends["t"], ends["t_in"], ends["t_out"]) if t in cost]
        return pd.DataFrame(out, columns=["contig_id", "node", "cost", "level_in", "level_out"])

    return one


_JUMPS = "contig_id {kind}, node string, prev string, n bigint, nodes array<string>"


def _jumps(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's own edges, and those that lead to it with their begin's cost (before), to a jump from each exit."""
    outer = rows[rows["before"].notna()]
    start = {s: int(c) for s, c in zip(outer["s"], outer["before"])}
    if (rows["s"] == SOURCE).any():
        start[SOURCE] = 0
    cost, before = settle(list(zip(rows["s"], rows["t"], map(int, rows["w"]))), start) if start else ({}, {})
    leaves = rows[rows["t_out"] > 0]["t"].drop_duplicates()
    out = []
    for node in leaves:
        if node in before:
            nodes = chain(node, before, lambda n: n in start)
            out.append((rows["contig_id"].iloc[0], node, before[nodes[0]], len(nodes), nodes))
    return pd.DataFrame(out, columns=["contig_id", "node", "prev", "n", "nodes"])


def _whole(cost: pd.Series, ln_score: pd.Series) -> pd.Series:
    return pd.Series([str(whole_cost(c, x)) for c, x in zip(cost, ln_score)], dtype=object)


def _leveled(edges: DataFrame, block: int) -> DataFrame:
    """Edges with keys, costs, level and what _ROWS has; block is the begin's, t_block the end's."""
    whole = F.pandas_udf(_whole, "string")
    of = lambda side: F.expr(f"{side}.position div {block}")
    rows = edges.select("contig_id", of("source").alias("block"), of("target").alias("t_block"), node_key(F.col("source")).alias("s"), node_key(F.col("target")).alias("t"), whole("cost", "ln_score").alias("w"), (F.col("target.gene") == "target").alias("last"))
    apart = F.expr("block ^ t_block")
    rows = rows.withColumn("level", F.when(apart == 0, 0).otherwise(F.length(F.bin(apart))).cast("int"))
    into = rows.groupBy("contig_id", F.col("t").alias("node")).agg(F.max("level").alias("level_in"))
    away = rows.groupBy("contig_id", F.col("s").alias("node")).agg(F.max("level").alias("level_out"))
    named = lambda df, node, **names: df.select("contig_id", F.col("node").alias(node), *(F.col(a).alias(b) for a, b in names.items()))
    rows = rows.join(named(into, "s", level_in="s_in"), ["contig_id", "s"], "left").join(named(into, "t", level_in="t_in"), ["contig_id", "t"]).join(named(away, "t", level_out="t_out"), ["contig_id", "t"], "left")
    s_in = F.when(F.col("s") == SOURCE, _BEYOND).otherwise(F.coalesce("s_in", F.lit(0)))
    t_out = F.when(F.col("last"), _BEYOND).otherwise(F.coalesce("t_out", F.lit(0)))
    return rows.select("contig_id", "block", "t_block", "level", "s", "t", "w", s_in.cast("int").alias("s_in"), "t_in", t_out.cast("int").alias("t_out"))


def solve_blocks(edges: DataFrame, kind: str = "bigint", block: int = BLOCK) -> DataFrame:
    """The cheapest path of every contig as disjoint pairs of nodes: contig_id, number, gene, frame, left, right. Contigs
    without a path have no rows. The driver sees how high the highest level is."""
    scratch = Scratch(edges.sparkSession, "paths")
    rows_of, known_of, jumps_of = (x.format(kind=kind) for x in (_ROWS, _KNOWN, _JUMPS))
    all_ = scratch.write(_leveled(scratch.write(edges, "given"), block), "edges")
    top = all_.agg(F.max("level")).first()[0] or 0
    columns = ["contig_id", "block", "s", "t", "w", "s_in", "t_in", "t_out"]
    at = lambda level: F.shiftright("block", level).alias("block")
    level_rows = [all_.where("level = 0").select(columns)]
    for level in range(1, top + 1):
        tables = level_rows[-1].groupBy("contig_id", "block").applyInPandas(_contract(level - 1), rows_of)
        between = all_.where(F.col("level") == level).select("contig_id", at(level), *columns[2:])
        level_rows.append(scratch.write(tables.select("contig_id", at(1), *columns[2:]).unionByName(between), f"level{level}"))
    sources = all_.select("contig_id").distinct().select("contig_id", F.lit(SOURCE).alias("node"), F.lit("0").alias("cost"), F.lit(_BEYOND).alias("level_in"), F.lit(_BEYOND).alias("level_out"))
    known = scratch.write(sources, "known")
    # the first ten characters of a key are its position
    own_block = F.expr(f"CAST(substring(node, 1, 10) AS BIGINT) div {block}")
    begun = lambda level: known.where(F.col("level_in") > level).select("contig_id", F.shiftright(own_block, level).alias("block"), F.lit("").alias("s"), F.col("node").alias("t"), F.col("cost").alias("w"), F.lit(0).alias("s_in"), F.col("level_in").alias("t_in"), F.col("level_out").alias("t_out"))
    for level in range(top, 0, -1):
        reached = level_rows[level].unionByName(begun(level)).groupBy("contig_id", "block").applyInPandas(_descend("entries", level), known_of)
        known = scratch.write(reached, f"down{level}")
    exits = scratch.write(level_rows[0].unionByName(begun(0)).groupBy("contig_id", "block").applyInPandas(_descend("exits", 0), known_of), "exits")
    leading = all_.where("level > 0").join(exits.select("contig_id", F.col("node").alias("s"), F.col("cost").alias("before")), ["contig_id", "s"])
    leading = leading.select("contig_id", F.col("t_block").alias("block"), *columns[2:], "before")
    inner = level_rows[0].withColumn("before", F.lit(None).cast("string"))
    jumps = scratch.write(inner.unionByName(leading).groupBy("contig_id", "block").applyInPandas(_jumps, jumps_of), "jumps")
    return _followed(jumps, scratch)


def _followed(jumps: DataFrame, scratch: Scratch) -> DataFrame:
    """Jumps from the target back to the source, as pairs of nodes."""
    powers = [jumps.select("contig_id", "node", "prev", "n")]
    while not powers[-1].where(F.col("prev") != SOURCE).isEmpty():
        a = powers[-1]
        b = a.select("contig_id", F.col("node").alias("prev"), F.col("prev").alias("again"), F.col("n").alias("more"))
        # a jump to a node that isn't reached from the source can't be
        twice = a.join(b, ["contig_id", "prev"], "left").select("contig_id", "node", F.coalesce("again", "prev").alias("prev"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        powers.append(scratch.write(twice, f"power{len(powers)}"))
    ends = F.col("node").endswith(" target target")
    total = powers[-1].where(ends).select("contig_id", F.col("n").alias("total"))
    met = total.select("contig_id", F.lit(0).cast("bigint").alias("after")).join(jumps.where(ends).select("contig_id", "node"), "contig_id")
    for power in reversed(powers):
        met = scratch.write(met.unionByName(met.join(power, ["contig_id", "node"]).where(F.col("prev") != SOURCE).select("contig_id", (F.col("after") + F.col("n")).alias("after"), F.col("prev").alias("node"))), "met")
    path = met.join(jumps, ["contig_id", "node"]).join(total, "contig_id").select("contig_id", (F.col("total") - F.col("after") - F.col("n")).alias("first"), F.posexplode("nodes").alias("k", "key"))
    place = F.col("first") + F.col("k")
    part = F.split("key", " ")
    path = path.select("contig_id", F.expr("(first + k) div 2").cast("int").alias("number"), F.when(place % 2 == 0, F.struct(part[3].alias("gene"), part[1].cast("int").alias("frame"), part[0].cast("int").alias("position"))).alias("a"), F.when(place % 2 == 1, part[0].cast("int")).alias("b"))
    pairs = path.groupBy("contig_id", "number").agg(F.first("a", True).alias("a"), F.first("b", True).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.select("contig_id", "number", F.col("a.gene").alias("gene"), F.col("a.frame").alias("frame"), F.col("a.position").alias("left"), F.col("b").alias("right"))
