"""Gene calls as text. Each writer gives contig_id, number and line(s); write() puts a contig's lines in order.

calls: contig_id, gene, strand, left, right, score, and where scores may be infinite ln_score; contigs: contig_id, seq,
length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from orfweave.functions.sequence import CODES, COMPLEMENTS, revcomp, translate_codons
from orfweave.params import DEFAULT, Params, output_format

#: The line that a file of that format begins with.
GFF3 = "##gff-version 3"


def score_text(score: Column, ln_score: Column | None = None) -> Column:
    """Six decimals and an exponent. A score that no double holds is written from the logarithm of its size."""
    plain = F.format_string("%E", score)
    if ln_score is None:
        return plain
    tens = ln_score / math.log(10)
    mantissa = F.round(F.pow(F.lit(10.0), tens - F.floor(tens)), 6)
    # 9.9999996 is 10 after rounding
    over = mantissa >= 10
    digits, power = F.when(over, mantissa / 10).otherwise(mantissa), F.floor(tens) + over.cast("int")
    large = F.concat(F.lit("-"), F.format_string("%.6f", digits), F.lit("E+"), power.cast("string"))
    return F.when(F.abs(score) == float("inf"), large).otherwise(plain)


def _numbered(calls: DataFrame) -> DataFrame:
    """With place in the contig and score_text."""
    order = Window.partitionBy("contig_id").orderBy("left", "right", "strand")
    ln_score = F.col("ln_score") if "ln_score" in calls.columns else None
    return calls.withColumns({"place": F.row_number().over(order), "score_text": score_text(F.col("score"), ln_score)})


def cut(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """genes (contig_id, strand, left, right and more) with length (the contig's), dna (as the strand reads it), and head and
    tail, the contig's bases before and after a gene that is nearer to an end than a codon. A contig's genes are listed, and
    cut out of its sequence in one row, so the sequence is carried once and not for each gene."""
    own = [c for c in genes.columns if c != "contig_id"]
    listed = genes.groupBy("contig_id").agg(F.collect_list(F.struct(*own)).alias("genes"))
    rows = listed.join(contigs.select("contig_id", "seq"), "contig_id")
    fields = [rows.schema["contig_id"], StructField("length", IntegerType()), *(genes.schema[c] for c in own), *(StructField(c, StringType()) for c in ("dna", "head", "tail"))]
    return rows.select("contig_id", "seq", "genes").mapInArrow(_cutter(own), StructType([StructField(f.name, f.dataType) for f in fields]))


#: Contigs whose genes are handed on at once.
_CONTIGS = 64
_BACK = str.maketrans(CODES, COMPLEMENTS)


def _cutter(own: list[str]):
    """A slice takes as long as its gene, wherever in the contig that lies."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _CONTIGS):
                some = batch.slice(k, _CONTIGS)
                genes = some.column("genes")
                sizes, flat = pc.list_value_length(genes).to_numpy(zero_copy_only=False), genes.flatten()
                strand, left, right = (flat.field(c).to_pylist() for c in ("strand", "left", "right"))
                dna, head, tail, length, at = [], [], [], [], 0
                for seq, n in zip(some.column("seq").to_pylist(), sizes.tolist()):
                    length += [len(seq)] * n
                    for s, a, b in zip(strand[at : at + n], left[at : at + n], right[at : at + n]):
                        bases = seq[a - 1 : b]
                        dna.append(bases[::-1].translate(_BACK) if s < 0 else bases)
                        head.append(seq[: a - 1] if a <= 3 else "")
                        tail.append(seq[b : b + 3] if b > len(seq) - 3 else "")
                    at += n
                contig = some.column("contig_id").take(pa.array(np.repeat(np.arange(some.num_rows), sizes)))
                texts = [pa.array(x, pa.string()) for x in (dna, head, tail)]
                yield pa.RecordBatch.from_arrays([contig, pa.array(length, pa.int32()), *(flat.field(c) for c in own), *texts], ["contig_id", "length", *own, "dna", "head", "tail"])

    return run


def _with_sequence(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    return cut(calls.where("gene = 'CDS'"), contigs)


def with_ends(genes: DataFrame, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """genes with left_text and right_text: their ends, overwritten by a text where that is neither null nor empty."""
    of = lambda name, text: F.col(name).cast("string") if text is None else F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.col(name).cast("string"))
    return genes.withColumns({"left_text": of("left", left), "right_text": of("right", right)})


def _open_ends(params: Params) -> tuple[Column, Column]:
    """Whether a gene that is cut out lacks its codon on the left and on the right."""
    no_start = ~F.left("dna", F.lit(3)).isin(list(params.starts))
    no_stop = ~F.right("dna", F.lit(3)).isin(list(params.stops))
    ahead = F.col("strand") > 0
    return F.when(ahead, no_start).otherwise(no_stop), F.when(ahead, no_stop).otherwise(no_start)


def tabular(calls: DataFrame) -> DataFrame:
    """START STOP FRAME CONTIG SCORE of coding genes; the stop comes first backward."""
    back = F.col("strand") < 0
    start, stop = F.when(back, F.col("right")).otherwise(F.col("left")), F.when(back, F.col("left")).otherwise(F.col("right"))
    line = F.concat_ws("\t", start, stop, F.when(back, "-").otherwise("+"), F.col("contig_id"), F.col("score_text"))
    body = _numbered(calls).where("gene = 'CDS'").select("contig_id", "place", line.alias("line"))
    names = calls.select("contig_id").distinct()
    head = names.select("contig_id", F.explode(F.array(F.struct(F.lit(-1).alias("place"), F.concat(F.lit("#id:\t"), F.col("contig_id")).alias("line")), F.struct(F.lit(0).alias("place"), F.lit("#START\tSTOP\tFRAME\tCONTIG\tSCORE").alias("line")))).alias("h"))
    return head.select("contig_id", "h.place", "h.line").unionByName(body)


def _location() -> Column:
    span = F.concat(F.col("left"), F.lit(".."), F.col("right"))
    return F.when(F.col("strand") < 0, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)


def genbank(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    """A flat file with the genome: features with their scores, and the sequence in blocks of ten, sixty a line."""
    note = F.concat(F.lit(" " * 21 + "/note=score:"), F.col("score_text"))
    feature = F.concat(F.lit("     "), F.rpad("gene", 16, " "), _location(), F.lit("\n"), note)
    body = _numbered(calls).select("contig_id", "place", feature.alias("line"))
    locus = F.concat(F.lit("LOCUS       "), F.rpad(F.col("contig_id").cast("string"), 16, " "), F.lpad(F.col("length").cast("string"), 8, " "), F.lit(" bp \nFEATURES             Location/Qualifiers"))
    head = contigs.select("contig_id", F.lit(0).alias("place"), locus.alias("line"))
    return head.unionByName(body).unionByName(_origin(contigs))


def _origin(contigs: DataFrame) -> DataFrame:
    """The sequence in blocks of ten, six a line."""
    lines = F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0))
    blocks = F.transform(lines, lambda x, k: F.concat(F.lpad((k * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.rtrim(F.regexp_replace(x, "(.{10})", "$1 "))))
    tail = F.concat(F.lit("ORIGIN\n"), F.array_join(blocks, "\n"), F.lit("\n//"))
    return contigs.select("contig_id", F.lit(1 << 30).alias("place"), tail.alias("line"))


def gff3(calls: DataFrame, version: str = "3") -> DataFrame:
    """Nine columns a feature; the attributes carry an id and the score."""
    rows = _numbered(calls)
    attributes = F.concat(F.lit("ID="), F.col("contig_id"), F.lit("_"), F.col("gene"), F.lit("_"), F.col("place"), F.lit(";note=score:"), F.col("score_text"))
    if version != "3":
        attributes = F.concat(F.lit('gene_id "'), F.col("contig_id"), F.lit("_"), F.col("place"), F.lit('"'))
    line = F.concat_ws("\t", F.col("contig_id"), F.lit("orfweave"), F.col("gene"), F.col("left"), F.col("right"), F.col("score_text"), F.when(F.col("strand") < 0, "-").otherwise("+"), F.lit("0"), attributes)
    return rows.select("contig_id", "place", line.alias("line"))


def _header() -> Column:
    return F.concat(F.lit(">"), F.col("contig_id"), F.lit("_CDS_["), _location(), F.lit("] [note=score:"), F.col("score_text"), F.lit("]"))


def fna(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    rows = _with_sequence(_numbered(calls), contigs)
    return rows.select("contig_id", "place", F.concat(_header(), F.lit("\n"), F.col("dna")).alias("line"))


def faa(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    rows = _with_sequence(_numbered(calls), contigs)
    return rows.select("contig_id", "place", F.concat(_header(), F.lit("\n"), translate_codons(F.col("dna"))).alias("line"))


def text(calls: DataFrame, contigs: DataFrame, name: str = "tabular") -> DataFrame:
    name = output_format(name)
    if name == "tabular":
        return tabular(calls)
    if name in ("gff", "gff3"):
        return gff3(calls, "3" if name == "gff3" else "2")
    return {"genbank": genbank, "fna": fna, "faa": faa}[name](calls, contigs)


def write(calls: DataFrame, contigs: DataFrame, path: str, name: str = "tabular") -> None:
    """Text files in the order of contigs; a contig's lines stay together."""
    rows = text(calls, contigs, name).select("contig_id", "place", "line")
    if output_format(name) == "gff3":
        # nulls come first
        rows = rows.unionByName(rows.limit(1).select(F.lit(None).cast(rows.schema["contig_id"].dataType).alias("contig_id"), F.lit(0).alias("place"), F.lit(GFF3).alias("line")))
    rows.repartitionByRange("contig_id").sortWithinPartitions("contig_id", "place").select("line").write.text(path)


def partial_tabular(calls: DataFrame, contigs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The older table: genes that lack an end are marked <1 and >length, contigs without genes named."""
    open_left, open_right = _open_ends(params)
    rows = with_ends(_with_sequence(_numbered(calls), contigs), F.when(open_left, "<1"), F.when(open_right, F.concat(F.lit(">"), F.col("length"))))
    ahead, left, right = F.col("strand") > 0, F.col("left_text"), F.col("right_text")
    line = F.concat_ws("\t", F.when(ahead, left).otherwise(right), F.when(ahead, right).otherwise(left), F.when(ahead, "+").otherwise("-"), F.col("contig_id"), F.col("score_text"))
    named = rows.select("contig_id", "place", line.alias("line"))
    none = contigs.select("contig_id").join(rows.select("contig_id").distinct(), "contig_id", "left_anti")
    return named.unionByName(none.select("contig_id", F.lit(0).alias("place"), F.concat(F.lit("#id:\t"), F.col("contig_id"), F.lit(" NO ORFS FOUND")).alias("line")))


def partial_fasta(calls: DataFrame, contigs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The older nucleotide sequences: a gene that lacks an end goes on to the contig's edge and is marked there, <1 or
    >length. A gene that is whole is named by its last base; of a partial one, and of one without either codon, which
    keeps its own bases, the last codon's first base counts."""
    rows = _with_sequence(_numbered(calls), contigs)
    open_left, open_right = _open_ends(params)
    ahead, both = F.col("strand") > 0, open_left & open_right
    to_left, to_right = open_left & ~both, open_right & ~both
    left = F.when(to_left, F.lit("<1")).otherwise(F.col("left").cast("string"))
    last = F.when(open_left | open_right, F.col("right") - 2).otherwise(F.col("right"))
    right = F.when(to_right, F.concat(F.lit(">"), F.col("length"))).otherwise(last.cast("string"))
    begin, end = F.when(ahead, left).otherwise(right), F.when(ahead, right).otherwise(left)
    head, tail = F.when(to_left, F.col("head")).otherwise(""), F.when(to_right, F.col("tail")).otherwise("")
    bases = F.when(ahead, F.concat(head, "dna", tail)).otherwise(F.concat(revcomp(tail), "dna", revcomp(head)))
    line = F.concat(F.lit(">"), F.col("contig_id"), F.lit("."), end, F.lit(" [START="), begin, F.lit("] [SCORE="), F.col("score_text"), F.lit("]\n"), bases)
    return rows.select("contig_id", "place", line.alias("line"))


def _short(score_text: Column) -> Column:
    """Two decimals, and an exponent without leading zeros."""
    mantissa = F.format_string("%.2f", F.substring_index(score_text, "E", 1).cast("double"))
    over = F.abs(mantissa.cast("double")) >= 10
    power = F.substring_index(score_text, "E", -1).cast("int") + over.cast("int")
    digits = F.when(over, F.format_string("%.2f", mantissa.cast("double") / 10)).otherwise(mantissa)
    return F.concat(digits, F.lit("E"), F.when(power < 0, F.lit("-")).otherwise("+"), F.abs(power).cast("string"))


def partial_genbank(calls: DataFrame, contigs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The older flat file: with a definition and the source as a feature; genes that lack an end are marked, and weights
    have two decimals."""
    numbered = _numbered(calls)
    open_left, open_right = _open_ends(params)
    rows = with_ends(_with_sequence(numbered, contigs), F.when(open_left, "<1"), F.when(open_right, F.concat(F.lit(">"), F.col("length"))))
    left, right = F.col("left_text"), F.col("right_text")
    place = lambda a, b: F.when(F.col("strand") < 0, F.concat(F.lit("complement("), a, F.lit(".."), b, F.lit(")"))).otherwise(F.concat(a, F.lit(".."), b))
    name = F.concat(F.lit("     "), F.rpad("gene", 16, " "))
    genes = rows.select("contig_id", "place", F.concat(name, place(left, right), F.lit("\n" + " " * 21 + '/note="weight='), _short(F.col("score_text")), F.lit(';"')).alias("line"))
    other = numbered.where("gene <> 'CDS'").select("contig_id", "place", F.concat(name, place(F.col("left").cast("string"), (F.col("right") - 2).cast("string"))).alias("line"))
    bases = F.col("length").cast("string")
    top = F.concat(F.lit("LOCUS       "), F.col("contig_id"), F.lpad(bases, 10, " "), F.lit(" bp    DNA             PHG\nDEFINITION  "), F.col("contig_id"), F.lit("\nFEATURES             Location/Qualifiers\n     source          1.."), bases)
    head = contigs.select("contig_id", F.lit(0).alias("place"), top.alias("line"))
    return head.unionByName(genes).unionByName(other).unionByName(_origin(contigs))


def _named(n: Column) -> Column:
    return F.concat(F.lit("Node('"), n["gene"], F.lit("','"), n["type"], F.lit("',"), n["frame"], F.lit(","), n["position"], F.lit(")"))


def orf_texts(scored: DataFrame) -> DataFrame:
    """Each ORF's text form: start, stop, frame, weight of its motif and score."""
    return scored.select("contig_id", F.concat(F.lit("Orf("), F.concat_ws(",", "start", "stop", "frame", F.format_string("%.9f", "weight_rbs"), score_text(F.col("score"), F.col("ln_score"))), F.lit(")")).alias("line"))


def edge_texts(edges: DataFrame) -> DataFrame:
    """Each edge's text form: its nodes' and its weight."""
    return edges.select("contig_id", F.concat(F.lit("Edge("), F.concat_ws(", ", _named(F.col("source")), _named(F.col("target")), F.format_string("%E", "cost")), F.lit(")")).alias("line"))


def edge_dump(edges: DataFrame) -> DataFrame:
    """source, target and the weight times a thousand, tab-separated."""
    return edges.select("contig_id", F.concat_ws("\t", _named(F.col("source")), _named(F.col("target")), (F.col("cost") * 1000).cast("string")).alias("line"))
