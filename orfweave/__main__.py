"""The command line: genes of the sequences in a file.

    python -m orfweave genome.fasta -f gff3 -o genes.gff3

Runs in the session that spark-submit gives, or else in a local one.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave import __version__
from orfweave.params import ALIASES, FORMATS, Params, start_weights, stop_codons
from orfweave.plans.annotate import Annotation
from orfweave.sinks import formats
from orfweave.sources import readers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="orfweave", description="Calls genes in compact genomes.")
    out.add_argument("infile", help="sequences in FASTA format")
    out.add_argument("-o", "--outfile", help="where the calls go; standard output if unset")
    out.add_argument("-f", "--format", default="tabular", choices=[*FORMATS, *ALIASES], help="what the calls are written as")
    out.add_argument("-s", "--start_codons", default="atg:0.85,gtg:0.10,ttg:0.05", help="start codons and their weights")
    out.add_argument("-e", "--stop_codons", default="tag,tga,taa", help="stop codons")
    out.add_argument("-l", "--minlen", type=int, default=90, help="bases of the shortest open reading frame")
    out.add_argument("-t", "--trnas", help="a tool's finds of tRNAs, tab-separated or in brief; genes don't overlap them")
    out.add_argument("-d", "--dump", action="store_true", help="write the first sequence's graph instead")
    out.add_argument("-V", "--version", action="version", version=__version__)
    return out


def lines(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    """The output's lines, one partition in memory at a time."""
    contigs = readers.fasta(spark, readers.require_file(spark, args.infile))
    if contigs.isEmpty():
        yield "Error: no sequences found in infile"
        return
    params = Params(starts=start_weights(args.start_codons), stops=stop_codons(args.stop_codons), min_length=args.minlen)
    if args.dump:
        contigs = contigs.orderBy("place").limit(1)
    trnas = readers.trnas(spark, readers.require_file(spark, args.trnas)) if args.trnas else None
    run = Annotation(contigs.select("contig_id", "seq", "length"), trnas, params)
    try:
        if args.dump:
            rows: DataFrame = formats.edge_dump(run.edges)
        else:
            # contigs come in the order of the file
            order = contigs.select(F.col("contig_id").alias("own"), F.col("place").alias("contig_place"))
            text = formats.text(run.calls, run.contigs, args.format)
            rows = text.join(order, F.col("contig_id") == F.col("own")).orderBy("contig_place", "place")
        if args.format == "gff3" and not args.dump:
            yield formats.GFF3
        for row in rows.select("line").toLocalIterator():
            yield row["line"]
    finally:
        run.release()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("orfweave").getOrCreate()
    out = open(args.outfile, "w", encoding="utf-8") if args.outfile else sys.stdout
    try:
        for line in lines(spark, args):
            print(line, file=out)
    finally:
        if args.outfile:
            out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
