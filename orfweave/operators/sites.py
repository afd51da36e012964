"""What genes are found by, measured in one pass over pieces of contigs.

A piece is read with the bases that windows around its ends reach, so pieces need nothing of each other. A row is a
piece and a reading frame, not a base: only codons that begin or end genes are listed one by one. Counts begin
anew with each piece; before() adds up those of the pieces before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfweave.functions.sequence import CODES, COMPLEMENTS, MOTIF, OFFSETS, RBS_BINS, RBS_WINDOW
from orfweave.operators import profile
from orfweave.params import DEFAULT, Params

#: Bases of a piece: a multiple of three, so that frames begin at the same places in each.
PIECE = 3000
BASES = "atgc"
#: (richest, poorest) of the three GC windows.
PAIRS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
#: Places in an event's counts: bases before its codon, bases up to its codon's end, pairs of windows as the forward strand
#: reads them before this codon, and as the backward strand does with it.
BEGUN, ENDED, FORWARD, BACKWARD, COUNTS = 0, 4, 8, 17, 26
#: Bits of a counter, for what a piece of up to 4,093 bases has, and things counted in one number.
_WIDTH, _SIDE = 12, 5
#: Pieces that are laid side by side, and whose events are handed on at once.
_BATCH = 64
_STRONG = b"gcsbvGCSBV"
#: Each letter's complement; others stay.
_TURNED = np.arange(256, dtype=np.uint8)
_TURNED[list(CODES.encode())] = list(COMPLEMENTS.encode())


class _Pieces:
    """Measures pieces; tables of motifs and letters are made once a task."""

    def __init__(self, params: Params):
        half = params.gc_window // 3 // 2
        self.half, self.left, self.right = half, max(RBS_WINDOW - 1, 3 * half), max(RBS_WINDOW + 2, 3 * half + 2)
        back = str.maketrans(CODES, COMPLEMENTS)
        known = [*params.starts, *params.stops]
        self.codons = [c.encode() for c in sorted({*known, *(c[::-1].translate(back) for c in known)}) if len(c) == 3]
        # codons of a, c, g, t by number; others are compared letter by letter
        self.codon, self.others = np.zeros(125, bool), [x for x in self.codons if x.strip(b"acgt")]
        for x in self.codons:
            if x not in self.others:
                self.codon[sum(5 ** (2 - k) * b"acgt".index(b) for k, b in enumerate(x))] = True
        # counters side by side in a number, so that one running sum counts them all
        self.base = np.zeros(256, np.int64)
        self.base[list(BASES.encode())] = 1 << _WIDTH * np.arange(len(BASES))
        self.pair = [np.array([1 << _WIDTH * (k - first) if first <= k < first + _SIDE else 0 for k in range(len(PAIRS))], np.int64) for first in range(0, len(PAIRS), _SIDE)]
        self.letter = np.full(256, 4, np.int16)
        self.other = np.full(256, 4, np.int16)
        for k, b in enumerate("acgt"):
            self.letter[ord(b)], self.other[ord(b)] = k, 3 - k
        self.gc = np.zeros(256, np.int32)
        self.gc[list(_STRONG)] = 1
        # the scores of all groups of offsets, of a word in one number
        self.motifs = np.stack(list(profile.motif_tables().values()), 1).copy().view(np.int32).ravel()

    def _motif(self, codes: np.ndarray, step: int, first: int, n: int) -> np.ndarray:
        """Best motif score of n windows; the word at a place is read in the direction of step."""
        words = np.zeros(len(codes) - MOTIF + 1, np.int16)
        for k in range(MOTIF):
            at = k if step > 0 else MOTIF - 1 - k
            words *= 5
            words += codes[at : at + len(words)]
        # the word that is read down from a place ends, in these codes, MOTIF - 1 before it
        shift = 0 if step > 0 else 1 - MOTIF
        best = np.zeros(n, np.int8)
        every = self.motifs[words].view(np.int8).reshape(-1, len(OFFSETS))
        for g, (low, high) in enumerate(OFFSETS.values()):
            found = np.ascontiguousarray(every[:, g])
            for o in range(low, high + 1):
                at = first + step * o + shift
                np.maximum(best, found[at : at + n], out=best)
        return best

    def motif_scores(self, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows before n bases and, on the other strand, after them; there, a start's window begins behind its codon."""
        return self._motif(self.letter[y], -1, self.left, n), self._motif(self.other[y], 1, self.left, n + 3)

    def lay(self, context: str, head: int, n: int) -> np.ndarray:
        """A piece's letters, with zeros where its contig has no bases for what windows reach."""
        text = np.frombuffer(context.encode("ascii", "replace"), np.uint8)
        y = np.zeros(self.left + n + self.right, np.uint8)
        y[self.left - head : self.left - head + len(text)] = text
        return y

    def windows(self, y: np.ndarray, n: int) -> np.ndarray:
        """GC of n bases in the window of their own phase and the next two, from sums along it."""
        wide = np.zeros(-(-len(y) // 3) * 3, np.int32)
        wide[: len(y)] = self.gc[y]
        along = wide.reshape(-1, 3).cumsum(0).ravel()
        high, low = self.left + 3 * self.half, self.left - 3 * self.half
        g = along[high : high + n + 2] - along[low : low + n + 2]
        return np.stack([g[:n], g[1 : n + 1], g[2 : n + 2]])

    def measure(self, context: str, head: int, n: int, first: int, length: int):
        """For each frame of a piece, its counts of bases and pairs of windows, side by side in numbers (see _unpacked)."""
        for row in _Measured(self, [context], [head], [n], [first], [length]).totals:
            yield (row,)


class _Measured:
    """Pieces laid one after another and measured together, so that a call of NumPy goes along many of them. Rows are
    three a piece, one for each frame. Sums go on from piece to piece; counts are differences of two of them. What is
    counted by codons lies in planes, one for each phase, since a frame's codons are neighbours there."""

    def __init__(self, tool: _Pieces, contexts: list[str], heads: list[int], sizes: list[int], firsts: list[int], lengths: list[int]):
        self.tool = tool
        n, first, length = (np.array(x, np.int64) for x in (sizes, firsts, lengths))
        margin = -(-tool.left // 3) * 3
        wide = -(-(margin + n + tool.right) // 3) * 3
        ends = np.cumsum(wide)
        begin = ends - wide + margin
        parts = []
        for context, head, w in zip(contexts, heads, wide.tolist()):
            text = context.encode("ascii", "replace")
            parts += [bytes(margin - head), text, bytes(w - margin + head - len(text))]
        self.y = y = np.frombuffer(b"".join(parts), np.uint8)
        total, self.begin, self.shift = len(y), begin, first + 1 - begin
        piece = np.repeat(np.arange(len(n)), wide // 3)
        codes = tool.letter[y]
        span = total - tool.left - tool.right + 3
        own = slice(tool.left, tool.left + span)
        self.forward, self.backward = np.zeros(total, np.int8), np.zeros(total + 3, np.int8)
        self.forward[own] = tool._motif(codes, -1, tool.left, span)
        self.backward[own] = tool._motif(tool.other[y], 1, tool.left, span)
        # codons by number; letters that are none of a, c, g, t make none of the known ones
        self.code = np.full(total, 124, np.int8)
        self.code[:-2] = 25 * codes[:-2] + 5 * codes[1:-1] + codes[2:]
        hit = tool.codon[self.code]
        for x in tool.others:
            hit[:-2] |= (y[:-2] == x[0]) & (y[1:-1] == x[1]) & (y[2:] == x[2])
        key = (3 * RBS_BINS * piece[:, None] + RBS_BINS * np.arange(3)).ravel()
        none, last = 3 * RBS_BINS * len(n), 0
        # codons that end within their contig
        whole = np.minimum(n, length - 2 - first)
        for b, e, size, codons, at, left in zip(begin.tolist(), ends.tolist(), n.tolist(), whole.tolist(), first.tolist(), (length - 5 - first).tolist()):
            codons = max(codons, 0)
            if at < 3:
                hit[b : b + 3 - at] = True
            hit[b + max(0, left) : b + codons] = True
            hit[last:b] = hit[b + codons : e] = False
            key[last:b] = key[b + size : e] = none
            last = e
        scores = np.bincount(key + self.backward[:total], minlength=none + RBS_BINS)
        for k in np.flatnonzero(first < RBS_WINDOW - 1):
            key[begin[k] : begin[k] + RBS_WINDOW - 1 - first[k]] = none
        scores += np.bincount(key + self.forward, minlength=none + RBS_BINS)
        self.scores = scores[:none].reshape(-1, RBS_BINS)
        self.bases = np.cumsum(tool.base[y])
        along = np.cumsum(tool.gc[y].reshape(-1, 3).T, 1, dtype=np.int32)
        g = np.zeros((3, along.shape[1] + 1), np.int8)
        g[:, tool.half : -1 - tool.half] = along[:, 2 * tool.half :] - along[:, : along.shape[1] - 2 * tool.half]
        # the windows of the next two phases, too
        windows = [np.stack([g[(p + k) % 3, (p + k) // 3 : along.shape[1] + (p + k) // 3] for p in range(3)]) for k in range(3)]
        pairs = _places(*windows)
        # sums[k][:, 1 + r] counts up to a plane's r-th codon
        self.sums = []
        for p in pairs:
            for t in tool.pair:
                sums = np.zeros((3, p.shape[1] + 1), np.int64)
                np.cumsum(t[p], 1, out=sums[:, 1:])
                self.sums.append(sums)
        phases, row = np.tile(np.arange(3), len(n)), np.repeat(begin // 3, 3)
        codons = np.maximum(0, (np.repeat(n, 3) - phases + 2) // 3)
        self.totals = np.stack([np.repeat(self.bases[begin + n - 1] - self.bases[begin - 1], 3), *(x[phases, row + codons] - x[phases, row] for x in self.sums)], 1)
        self.pairs = []
        places = list(zip(phases.tolist(), row.tolist(), (row + codons).tolist()))
        for p in pairs:
            digits = (p + ord("1")).astype(np.uint8)
            self.pairs.append(pa.array([digits[f, low:high].tobytes().decode() for f, low, high in places], pa.string()))
        # events in order of their rows and places
        at = np.flatnonzero(hit)
        owner = (3 * piece[at // 3] + at % 3).astype(np.int16)
        order = np.argsort(owner, kind="stable")
        self.at, self.owner = at[order], owner[order].astype(np.int64)
        self.size = np.bincount(owner, minlength=3 * len(n))
        self.pos = self.at + self.shift[self.owner // 3]
        self.length = length[self.owner // 3]
        ahead = np.where(self.pos >= RBS_WINDOW, self.forward[self.at], 0)
        self.rbs = ahead, self.backward[self.at + 3]

    def counts(self, which: np.ndarray) -> np.ndarray:
        """Counts of some events, as in events' n."""
        at, begin = self.at[which], self.begin[self.owner[which] // 3]
        phase, row, from_ = at % 3, at // 3, begin // 3
        side = len(self.tool.pair)
        before = self.bases[begin - 1]
        packed = [self.bases[at - 1] - before, self.bases[at + 2] - before]
        packed += [x[phase, row + (k >= side)] - x[phase, from_] for k, x in enumerate(self.sums)]
        return _unpacked(np.stack(packed, 1), 2)

    def codons(self, which: np.ndarray, back: bool = False) -> pa.Array:
        """The codons of some events, as one of the strands reads them."""
        letters = self.y[self.at[which][:, None] + np.arange(3)]
        letters = np.ascontiguousarray(_TURNED[letters[:, ::-1]] if back else letters)
        return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32) * 3), pa.py_buffer(letters))

    def kept(self, some: pa.RecordBatch) -> list[pa.Array]:
        """The columns that all rows have, in the order of _KEPT."""
        thrice = pa.array(np.repeat(np.arange(some.num_rows), 3))
        keys = [some.column(x).take(thrice) for x in ("contig_id", "length", "first")]
        frame = pa.array(np.tile(np.arange(1, 4, dtype=np.int32), some.num_rows))
        return [*keys, frame, _lists(_unpacked(self.totals, 1)), _lists(self.scores), *self.pairs]


def _measured(batches, tool: _Pieces):
    """Some pieces at a time, with what was measured of them."""
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH):
            some = batch.slice(start, _BATCH)
            yield some, _Measured(tool, *(some.column(x).to_pylist() for x in ("context", "before", "chunk_length", "first", "length")))


def _met(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """How often each motif score was met on both strands."""
    return np.bincount(backward, minlength=RBS_BINS) + np.bincount(forward, minlength=RBS_BINS)


def _places(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in PAIRS of the richest and the poorest of three windows, as each strand reads them. Ties: the later window
    is the richest, the earlier one the poorest."""
    out = []
    for x, y, z in ((a, b, c), (c, b, a)):
        last, first = (z >= x) & (z >= y), (x <= y) & (x <= z)
        rich = 2 * last + (~last & (y >= x))
        out.append((3 * rich + np.where(first, 0, 2 - (y <= z))).astype(np.int8))
    return out[0], out[1]


def _unpacked(packed: np.ndarray, bases: int) -> np.ndarray:
    """Counters, a row each, from rows of numbers that hold them side by side: bases numbers of BASES, then two of PAIRS."""
    wide = ((packed[:, :, None] >> _WIDTH * np.arange(_SIDE)) & ((1 << _WIDTH) - 1)).astype(np.int32)
    rows, side = len(packed), (packed.shape[1] - bases) // 2
    pairs = wide[:, bases:].reshape(rows, 2, side * _SIDE)[:, :, : len(PAIRS)]
    return np.concatenate([wide[:, :bases, : len(BASES)].reshape(rows, bases * len(BASES)), pairs.reshape(rows, 2 * len(PAIRS))], axis=1)


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of numbers, all of one width."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel().astype(np.int32)))


def _events(m: _Measured) -> pa.Array:
    every = np.arange(len(m.at))
    ends = np.concatenate([[0], np.cumsum(m.size)]).astype(np.int32)
    number = lambda x: pa.array(x.astype(np.int32))
    rows = pa.StructArray.from_arrays([number(m.pos), m.codons(every), *map(number, m.rbs), _lists(m.counts(every))], ["pos", "codon", "rbs_f", "rbs_r", "n"])
    return pa.ListArray.from_arrays(ends, rows)


_KEPT = ["contig_id", "length", "first", "frame", "totals", "scores", "pairs_f", "pairs_r"]
_SCHEMA = "contig_id {kind}, length int, first int, frame int, totals array<int>, scores array<int>, pairs_f string, pairs_r string, {last}"
_EVENTS = "events array<struct<pos: int, codon: string, rbs_f: int, rbs_r: int, n: array<int>>>"
_MARK = "struct<pos: int, n: array<int>>"
_CLOSED = "closed array<struct<strand: int, start: int, stop: int, start_codon: string, rbs_score: int, bases: array<int>, n: array<int>>>"
_PAIRED = f"{_CLOSED}, open array<struct<strand: int, start: int, start_codon: string, rbs_score: int, n: array<int>>>, after {_MARK}, upto {_MARK}, initial {_MARK}, final {_MARK}"


def scan(contigs: DataFrame, params: Params = DEFAULT, shortest: int = profile.SHORTEST) -> DataFrame:
    """contig_id, length, first (position before the piece), frame; totals (of the piece: a, t, g, c, then pairs of windows
    forward and backward in the frame), scores (how often each motif score was met in the frame, both strands),
    pairs_f and pairs_r (a digit for each codon: 1 and the pair's place in PAIRS) and events: codons that begin or end
    genes, and those at the contig's ends, with motif scores and counts. Keep it (a table) where it is used twice.
    Contigs under shortest bases are left out."""
    whole = contigs.where(F.col("length") >= shortest)
    return scan_pieces(profile.chunks(whole, PIECE, *reaches(params)), params)


def reaches(params: Params = DEFAULT) -> tuple[int, int]:
    """Bases before and after a piece that scan_pieces() needs."""
    reach = _Pieces(params)
    return reach.left, reach.right


def scan_pieces(pieces: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """scan() of pieces of PIECE bases that are cut already, with reaches() bases around them."""
    kind = pieces.schema["contig_id"].dataType.simpleString()
    return pieces.mapInArrow(_scanner(params), _SCHEMA.format(kind=kind, last=_EVENTS))


def _scanner(params: Params):
    def run(batches):
        for some, m in _measured(batches, _Pieces(params)):
            yield pa.RecordBatch.from_arrays([*m.kept(some), _events(m)], [*_KEPT, "events"])

    return run


def scan_scores(contigs: DataFrame, params: Params = DEFAULT, shortest: int = profile.SHORTEST) -> DataFrame:
    """contig_id and scores (how often each motif score was met, both strands) of pieces, or of several of a contig: what
    scan() gives, summed up, without all else that it measures."""
    cut = profile.chunks(contigs.where(F.col("length") >= shortest), PIECE, *reaches(params))

    def run(batches):
        tool = _Pieces(params)
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("context", "before", "chunk_length", "first")]
            rows, begins, last = [], [], None
            for k, (contig, context, head, n, first) in enumerate(zip(batch.column("contig_id").to_pylist(), *columns)):
                forward, backward = tool.motif_scores(tool.lay(context, head, n), n)
                scores = _met(forward[max(0, RBS_WINDOW - 1 - first) :], backward[:n])
                if rows and contig == last and first:
                    rows[-1] = rows[-1] + scores
                else:
                    rows.append(scores)
                    begins.append(k)
                last = contig
            yield pa.RecordBatch.from_arrays([batch.column("contig_id").take(pa.array(begins, pa.int64())), _lists(np.array(rows).reshape(-1, RBS_BINS))], ["contig_id", "scores"])

    kind = cut.schema["contig_id"].dataType.simpleString()
    return cut.mapInArrow(run, f"contig_id {kind}, scores array<int>")


def pair(scanned: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """scan()'s rows with what is left of their events once starts have met the stops of their piece and frame. closed: ORFs of
    at least the least length, with bases (of BASES) and n (pairs of windows); open: starts that meet no stop in the piece.
    after and upto: the first stop forward and the last one backward; initial and final: the first and the last event. All
    but closed have their event's counts."""
    kind = scanned.schema["contig_id"].dataType.simpleString()
    return scanned.mapInArrow(_pairer(params), _SCHEMA.format(kind=kind, last=_PAIRED))


def scan_pairs(contigs: DataFrame, params: Params = DEFAULT, shortest: int = profile.SHORTEST) -> DataFrame:
    """pair() of scan(), in one pass: events are neither written nor handed to Spark. A contig's pieces come one after another
    here, so starts that are open at a piece's end meet their stops along the way: closed has all ORFs, each in the row where
    its other end was met, and nothing is open."""
    pieces = profile.chunks(contigs.where(F.col("length") >= shortest), PIECE, *reaches(params))
    met, joiner = _meeter(params), _joiner(params)
    kind = pieces.schema["contig_id"].dataType.simpleString()
    return pieces.mapInArrow(lambda batches: joiner(met(batches)), _SCHEMA.format(kind=kind, last=_CLOSED))


class _Pairs:
    """Starts and stops of a batch of pieces, each piece's events in order of their places."""

    def __init__(self, params: Params):
        back = str.maketrans(CODES, COMPLEMENTS)
        self.turn = lambda codon: codon[::-1].translate(back)
        self.starts, self.stops, self.least = list(params.starts), list(params.stops), params.min_length
        # by a codon's number; those with other letters are odd
        letters = [(a, b, c) for a in range(5) for b in range(5) for c in range(5)]
        self.odd = np.array([4 in x for x in letters])
        words = ["".join("acgtn"[k] for k in x) for x in letters]
        self.kind, _, at = self.kinds(pa.array(words))
        self.turned = np.array([self.turn(c) in self.starts for c in words])

    def kinds(self, codons: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Each event's class (forward starts go first, then backward ones, then stops), all codons and each event's."""
        named = codons.dictionary_encode()
        words = named.dictionary.to_pylist()
        turned = [self.turn(c) for c in words]
        kind = [1 if c in self.starts else 2 if t in self.starts else 3 if c in self.stops else 4 if t in self.stops else 0 for c, t in zip(words, turned)]
        at = named.indices.to_numpy(zero_copy_only=False)
        return np.array(kind, np.int8)[at] if len(at) else np.zeros(0, np.int8), words, at

    def split(self, batch: pa.RecordBatch) -> list[pa.Array]:
        listed = batch.column("events")
        flat = listed.flatten()
        number = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        size = np.diff(listed.offsets.to_numpy())
        n = flat.field("n").flatten().to_numpy(zero_copy_only=False).reshape(-1, COUNTS)
        kind, words, codon = self.kinds(flat.field("codon"))
        turned = np.array([self.turn(c) in self.starts for c in words], bool)[codon] if len(words) else np.zeros(0, bool)
        length = batch.column("length").to_numpy(zero_copy_only=False)[np.repeat(np.arange(len(size)), size)]
        texts = pa.array(words, pa.string()), pa.array([self.turn(c) for c in words], pa.string())
        return self.met(number("pos"), size, length, kind, turned, (number("rbs_f"), number("rbs_r")), n.__getitem__, lambda which, back: texts[back].take(pa.array(codon[which])))

    def split_measured(self, m: _Measured, whole: np.ndarray) -> list[pa.Array]:
        """split() of pieces that were measured just now: counts are looked up where starts and stops of an ORF ask for them.
        whole: which rows have all of their contig."""
        code = m.code[m.at]
        kind, turned = self.kind[code], self.turned[code]
        # the few with other letters
        odd = np.flatnonzero(self.odd[code])
        if len(odd):
            words = m.codons(odd)
            kind[odd], words, codon = self.kinds(words)
            turned[odd] = np.array([self.turn(c) in self.starts for c in words], bool)[codon]
        return self.met(m.pos, m.size, m.length, kind, turned, m.rbs, m.counts, m.codons, whole)

    def met(self, pos, size, length, kind, turned, rbs, n, codons, whole=None) -> list[pa.Array]:
        """The columns that pair() adds, from events in order of their rows and places. n and codons give counts and codons of
        some events. Open starts of rows that are whole end with the row's first or last event."""
        ends = np.cumsum(size)
        begins, owner, every = ends - size, np.repeat(np.arange(len(size)), size), np.arange(len(pos))
        # a start may lie on a stop, which is its own then
        after = np.minimum.accumulate(np.where(kind == 3, every, len(pos))[::-1])[::-1]
        upto = np.maximum.accumulate(np.where(kind == 4, every, -1))
        ahead = (kind == 1) | (pos <= 3)
        # a backward ORF that meets no stop codon begins with the frame's last codon
        behind = (kind == 2) | ((pos + 5 > length) & ~turned)
        closed, open_ = [], []
        for back, (some, end) in enumerate(((ahead, after), (behind, upto))):
            own = np.flatnonzero(some)
            row, end = owner[own], end[own]
            hit = end >= begins[row] if back else end < ends[row]
            if whole is not None:
                end = np.where(~hit & whole[row], begins[row] if back else ends[row] - 1, end)
                hit |= whole[row]
            waits = own[~hit]
            own, end = own[hit], end[hit]
            long = np.abs(pos[end] - pos[own]) + 3 >= self.least
            own, end = own[long], end[long]
            left, right = (n(end), n(own)) if back else (n(own), n(end))
            bases = right[:, ENDED : ENDED + len(BASES)] - left[:, BEGUN : BEGUN + len(BASES)]
            at = BACKWARD if back else FORWARD
            pairs = right[:, at : at + len(PAIRS)] - left[:, at : at + len(PAIRS)]
            strand = np.full(len(own), -1 if back else 1, np.int32)
            closed.append((owner[own], [strand, pos[own], pos[end], codons(own, bool(back)), rbs[back][own], bases, pairs]))
            strand = np.full(len(waits), -1 if back else 1, np.int32)
            open_.append((owner[waits], [strand, pos[waits], codons(waits, bool(back)), rbs[back][waits], n(waits)]))
        # of each row: what starts of other pieces may meet, and where its contig may begin and end
        last = np.maximum(ends - 1, 0)
        first_stop = after[np.minimum(begins, max(0, len(pos) - 1))] if len(pos) else begins
        last_stop = upto[last] if len(pos) else begins
        marks = [(first_stop, (size > 0) & (first_stop < ends)), (last_stop, (size > 0) & (last_stop >= begins)), (begins, size > 0), (last, size > 0)]
        return [_grouped(closed, len(size), ["strand", "start", "stop", "start_codon", "rbs_score", "bases", "n"]), _grouped(open_, len(size), ["strand", "start", "start_codon", "rbs_score", "n"]), *(_marked(pos, n, *m) for m in marks)]


def _column(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else _lists(x) if x.ndim == 2 else pa.array(x.astype(np.int32))


def _grouped(parts: list[tuple], rows: int, names: list[str]) -> pa.Array:
    """Lists of structs, those of each row together."""
    owner = np.concatenate([p[0] for p in parts])
    order = np.argsort(owner, kind="stable")
    columns = [np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*(p[1] for p in parts))]
    taken = [_column(x[order] if isinstance(x, np.ndarray) else x.take(pa.array(order))) for x in columns]
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(taken, names))


def _marked(pos: np.ndarray, n, at: np.ndarray, some: np.ndarray) -> pa.Array:
    """An event a row, null where there is none."""
    counts = np.zeros((len(some), COUNTS), np.int32)
    counts[some] = n(at[some])
    places = np.zeros(len(some), np.int32)
    places[some] = pos[at[some]]
    return pa.StructArray.from_arrays([_column(places), _column(counts)], ["pos", "n"], mask=pa.array(~some))


_PARTS = [*_KEPT, "closed", "open", "after", "upto", "initial", "final"]


def _pairer(params: Params):
    def run(batches):
        tool = _Pairs(params)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _KEPT), *tool.split(batch)], _PARTS)

    return run


def _meeter(params: Params):
    """pair() of scan() with events that stay here; contigs of a single piece have nothing open."""

    def run(batches):
        tool = _Pairs(params)
        for some, m in _measured(batches, _Pieces(params)):
            first, length = (some.column(x).to_numpy() for x in ("first", "length"))
            whole = np.repeat((first == 0) & (length <= PIECE), 3)
            yield pa.RecordBatch.from_arrays([*m.kept(some), *tool.split_measured(m, whole)], _PARTS)

    return run


class _Along:
    """What a contig's frame has had so far: counts of its pieces, the last stop that backward starts meet, the first event
    and the last one, and forward starts that met no stop yet."""

    def __init__(self):
        self.counts, self.behind, self.begin, self.final, self.waiting = np.zeros(COUNTS, np.int64), None, None, None, []


class _Joiner:
    """Goes along pieces in order and lets open starts meet stops of other pieces."""

    def __init__(self, params: Params):
        self.least, self.frames = params.min_length, {}

    def join(self, batch: pa.RecordBatch) -> pa.Array:
        """closed of each row, with the ORFs that its marks close."""
        rows, length = batch.num_rows, batch.column("length").to_pylist()
        totals = batch.column("totals").flatten().to_numpy().reshape(rows, -1).astype(np.int64)
        totals = np.concatenate([totals[:, : len(BASES)], totals], 1)
        opened = batch.column("open")
        ends, flat = opened.offsets.to_numpy(), opened.flatten()
        column = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("strand", "start", "rbs_score")}
        counts = flat.field("n").flatten().to_numpy().reshape(-1, COUNTS)
        codons = flat.field("start_codon")
        marks = {}
        for name in ("after", "upto", "initial", "final"):
            mark = batch.column(name)
            marks[name] = (mark.is_valid().to_numpy(zero_copy_only=False), mark.field("pos").to_numpy(), mark.field("n").flatten().to_numpy().reshape(rows, COUNTS))
        met = []
        for k, (first, frame) in enumerate(zip(batch.column("first").to_pylist(), batch.column("frame").to_pylist())):
            if first == 0:
                if length[k] <= PIECE:
                    continue
                self.frames[frame] = _Along()
            along = self.frames[frame]
            at = {name: (int(pos[k]), n[k] + along.counts) if some[k] else None for name, (some, pos, n) in marks.items()}
            along.begin, along.final = along.begin or at["initial"], at["final"] or along.final
            own = slice(ends[k], ends[k + 1])
            if at["after"] and along.waiting:
                met += [(k, w, at["after"]) for w in along.waiting]
                along.waiting = []
            if ends[k + 1] > ends[k]:
                ahead = column["strand"][own] > 0
                for some, forward in ((ahead, True), (~ahead, False)):
                    if some.any():
                        found = (column["strand"][own][some], column["start"][own][some], codons[own].filter(pa.array(some)), column["rbs_score"][own][some], counts[own][some] + along.counts)
                        if forward:
                            along.waiting.append(found)
                        elif along.behind or along.begin:
                            met.append((k, found, along.behind or along.begin))
            if first + PIECE >= length[k]:
                # the contig's end: what met no stop ends with the last event
                met += [(k, w, along.final) for w in along.waiting if along.final]
                along.waiting = []
            along.behind = at["upto"] or along.behind
            along.counts = along.counts + totals[k]
        return self.all_closed(batch.column("closed"), met)

    def all_closed(self, closed: pa.Array, met: list[tuple]) -> pa.Array:
        if not met:
            return closed
        sizes = [len(found[1]) for _, found, _ in met]
        owner = np.repeat([k for k, _, _ in met], sizes)
        strand, start, rbs, n = (np.concatenate([found[i] for _, found, _ in met]) for i in (0, 1, 3, 4))
        codon = pa.concat_arrays([found[2] for _, found, _ in met])
        stop, other = np.repeat([m[0] for _, _, m in met], sizes), np.repeat(np.stack([m[1] for _, _, m in met]), sizes, 0)
        keep = np.abs(stop - start) + 3 >= self.least
        owner, strand, start, rbs, n, stop, other, codon = owner[keep], strand[keep], start[keep], rbs[keep], n[keep], stop[keep], other[keep], codon.filter(pa.array(keep))
        ahead = (strand > 0)[:, None]
        left, right = np.where(ahead, n, other), np.where(ahead, other, n)
        bases = right[:, ENDED : ENDED + len(BASES)] - left[:, BEGUN : BEGUN + len(BASES)]
        size = len(PAIRS)
        pairs = np.where(ahead, right[:, FORWARD : FORWARD + size] - left[:, FORWARD : FORWARD + size], right[:, BACKWARD : BACKWARD + size] - left[:, BACKWARD : BACKWARD + size])
        flat, rows = closed.flatten(), len(closed)
        within = [flat.field(x) for x in ("strand", "start", "stop", "start_codon", "rbs_score")]
        within = [x if pa.types.is_string(x.type) else x.to_numpy(zero_copy_only=False) for x in within] + [flat.field(x).flatten().to_numpy().reshape(-1, w) for x, w in (("bases", len(BASES)), ("n", size))]
        return _grouped([(np.repeat(np.arange(rows), np.diff(closed.offsets.to_numpy())), within), (owner, [strand, start, stop, codon, rbs, bases, pairs])], rows, ["strand", "start", "stop", "start_codon", "rbs_score", "bases", "n"])


def _joiner(params: Params):
    def run(batches):
        tool = _Joiner(params)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _KEPT), tool.join(batch)], [*_KEPT, "closed"])

    return run


def gc_triplets(contigs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """contig_id, pos, frame, g1, g2, g3: GC in windows of the position's own phase and the next two, as scan() counts them;
    positions up to length - 2."""
    names = ["contig_id", "length", "first", "g1", "g2", "g3"]

    def run(batches):
        tool = _Pieces(params)
        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH):
                some = batch.slice(start, _BATCH)
                columns = [some.column(x).to_pylist() for x in ("context", "before", "chunk_length")]
                g = [tool.windows(tool.lay(context, head, n), n) for context, head, n in zip(*columns)]
                ends = pa.array(np.cumsum([0, *columns[2]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([w[k] for w in g]).astype(np.int32))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*(some.column(x) for x in names[:3]), *lists], names)

    cut = profile.chunks(contigs, PIECE, *reaches(params))
    kind = cut.schema["contig_id"].dataType.simpleString()
    rows = cut.mapInArrow(run, f"contig_id {kind}, length int, first int, g1 array<int>, g2 array<int>, g3 array<int>")
    rows = rows.select("contig_id", "length", "first", F.posexplode(F.arrays_zip("g1", "g2", "g3")).alias("at", "g"))
    pos = F.col("first") + F.col("at") + 1
    return rows.where(pos <= F.col("length") - 2).select("contig_id", pos.alias("pos"), ((pos - 1) % 3 + 1).alias("frame"), "g.*")


def gc_indices(scanned: DataFrame) -> DataFrame:
    """contig_id, pos, frame, and which window is richest and poorest as each strand reads them; from scan()."""
    digits = [F.regexp_extract_all(x, F.lit("."), F.lit(0)) for x in ("pairs_f", "pairs_r")]
    zipped = F.arrays_zip(*(d.alias(n) for d, n in zip(digits, "fr")))
    rows = scanned.select("contig_id", "length", "first", "frame", F.posexplode(zipped).alias("at", "pair"))
    pos = F.col("first") + F.col("frame") + 3 * F.col("at")
    f, r = (F.col(f"pair.{x}").cast("int") - 1 for x in "fr")
    places = {f"{m}_{s}": x for s, pair in (("f", f), ("r", r)) for m, x in (("max", F.floor(pair / 3).cast("int") + 1), ("min", pair % 3 + 1))}
    return rows.where(pos <= F.col("length") - 2).select("contig_id", pos.alias("pos"), "frame", *(x.alias(n) for n, x in places.items()))


def before(sites: DataFrame) -> DataFrame:
    """sites with before: what the frame's earlier pieces add to an event's counts. Rows a contig and frame stay together."""
    earlier = Window.partitionBy("contig_id", "frame").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    n = [F.coalesce(F.sum(F.col("totals")[k].cast("long")).over(earlier), F.lit(0)) for k in range(4 + 2 * len(PAIRS))]
    return sites.withColumns({f"_{k}": x for k, x in enumerate(n)}).select(*sites.columns, F.array(*(F.col(f"_{k}") for k in (*range(4), *range(len(n))))).alias("before"))
