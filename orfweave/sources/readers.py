"""Sources: FASTA, tables of callers and counts, JSON maps, alignments, graphs, tRNA scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orfweave.plans.scratch import Scratch

# The letters of a text and the nucleotides that stand for them in derived contigs.
LETTERS, NUCLEOTIDES = "etaoinshrdlcumwfgypbvkjxqz", "acgtacgtacgtacgtacgtacgtac"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig_id (the header's first word), description, seq (lower case), length, place (which orders them). Text before a
    file's first header is dropped; of records with one name the last stays."""
    # each piece after a > that begins a line is a record; the piece before a file's first one has no header
    pieces = spark.read.option("lineSep", "\n>").text(path)
    pieces = pieces.select("value", F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("opens"))
    # a task may hold many files: what comes first is told for each file
    first = pieces.where("opens").groupBy("file").agg(F.min_by("value", "place").startswith(">").alias("headed"), F.min("place").alias("place"))
    records = pieces.join(first.where("NOT headed").select("place"), "place", "left_anti")
    value = F.when(F.startswith("value", F.lit(">")), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return records_to_contigs(records.select(value.alias("value"), "place"))


def records_to_contigs(records: DataFrame, *keys: str) -> DataFrame:
    """Records (value, without its >; place, which orders them) to contigs, apart for each of the keys."""
    header, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.regexp_replace("value", "^[^\n]*\n?", "")
    rows = records.select(*keys, F.split(F.trim(F.regexp_replace(header, "\r", "")), r"\s+", 2).alias("head"), F.lower(F.regexp_replace(body, r"\s", "")).alias("seq"), "place")
    rows = rows.where(F.col("head")[0] != "")
    last = Window.partitionBy(*keys, "contig_id").orderBy(F.col("place").desc())
    rows = rows.select(*keys, F.col("head")[0].alias("contig_id"), F.coalesce(F.get("head", F.lit(1)), F.lit("")).alias("description"), "seq", F.length("seq").alias("length"), "place")
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def fasta_pieces(spark: SparkSession, path: str, size: int, left: int, right: int) -> DataFrame:
    """What profile.chunks gives, of FASTA files: contig_id, length, first, before, context and chunk_length, for pieces of
    size bases with so many before and after them. No task sees a whole sequence.

    Files are read by lines in byte ranges. A range tells how many bases come before its first header, which header is its
    last, and how many bases follow that; summed up over a file's ranges these say which contig a range begins in, and
    at which base. Each line then knows its place and gives its bases to the pieces that they lie in or near.
    Text before a file's first header is dropped. Contigs of one name in several records are an error here.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.regexp_replace("value", "\\s+$", "").alias("line"))
    header = F.startswith("line", F.lit(">"))
    bases = F.lower(F.regexp_replace("line", r"\s", ""))
    lines = lines.select("file", "block", "k", F.when(header, F.split_part(F.regexp_replace("line", r"^>\s*|\s*$", ""), F.lit(" "), F.lit(1))).alias("name"), F.when(header, F.lit("")).otherwise(bases).alias("bases"))
    rows = Scratch(spark, "fasta").write(lines, "lines")
    # within a range: the header that a line follows, as its place in the range, and bases since then
    along = Window.partitionBy("file", "block").orderBy("k")
    rows = rows.withColumn("head", F.last(F.when(F.col("name").isNotNull(), F.struct("k", "name")), ignorenulls=True).over(along))
    since = Window.partitionBy("file", "block", "head.k").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("since", F.coalesce(F.sum(F.length("bases")).over(since), F.lit(0)))
    # a row a range
    totals = rows.groupBy("file", "block").agg(F.max_by("head", "k").alias("head"), F.max_by(F.col("since") + F.length("bases"), "k").alias("after"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("from", F.last(F.when(F.col("head").isNotNull(), F.struct("block", F.col("head.name").alias("name"))), ignorenulls=True).over(earlier))
    # bases after the header that is carried on: of its own range and of the ranges without headers since then
    group = Window.partitionBy("file", F.col("own_block")).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("own_block", F.when(F.col("head").isNotNull(), F.col("block")).otherwise(F.col("from.block")))
    carried = carried.withColumn("in_group", F.coalesce(F.sum("after").over(group), F.lit(0)))
    ends = carried.groupBy("file", "own_block").agg(F.sum("after").alias("group_bases"))
    carried = carried.join(ends.select(F.col("file").alias("_f"), F.col("own_block").alias("_b"), "group_bases"), (F.col("file") == F.col("_f")) & (F.col("from.block") == F.col("_b")), "left")
    # a range with a header ends the group before it: all of that group's bases come first
    offset = F.when(F.col("head").isNotNull(), F.col("group_bases")).otherwise(F.col("in_group"))
    starts = carried.select("file", "block", F.col("from.name").alias("begun"), F.coalesce(offset, F.lit(0)).alias("offset"))
    placed = rows.join(starts, ["file", "block"]).select("file", F.coalesce("head.name", "begun").alias("contig_id"), F.when(F.col("head").isNull(), F.col("offset") + F.col("since")).otherwise(F.col("since")).alias("at"), "bases")
    placed = placed.where((F.length("bases") > 0) & F.col("contig_id").isNotNull() & (F.col("contig_id") != ""))
    lengths = placed.groupBy("contig_id").agg(F.max(F.col("at") + F.length("bases")).cast("int").alias("length"), F.count_if(F.col("at") == 0).alias("records"))
    lengths = lengths.select("contig_id", F.when(F.assert_true(F.col("records") == 1, F.lit("a sequence's name comes twice")).isNull(), F.col("length")).alias("length"))
    # pieces whose bases, or those around them, a line has some of
    low, high = F.greatest(F.lit(0), F.floor((F.col("at") - right) / size)), F.floor((F.col("at") + F.length("bases") - 1 + left) / size)
    near = placed.select("contig_id", "at", "bases", F.explode(F.sequence(low, high)).alias("piece"))
    begin = F.greatest(F.lit(0), F.col("piece") * size - left)
    part_from, part_to = F.greatest(F.col("at"), begin), F.least(F.col("at") + F.length("bases"), (F.col("piece") + 1) * size + right)
    parts = near.select("contig_id", "piece", part_from.alias("from"), F.substring(F.col("bases"), (part_from - F.col("at") + 1).cast("int"), (part_to - part_from).cast("int")).alias("some")).where(part_to > part_from)
    whole = parts.groupBy("contig_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "some"))), lambda x: x["some"]), "").alias("context"))
    first = (F.col("piece") * size).cast("int")
    out = whole.join(lengths, "contig_id").where(F.col("piece") * size < F.col("length"))
    return out.select("contig_id", "length", first.alias("first"), F.least(first, F.lit(left)).alias("before"), "context", F.least(F.lit(size), F.col("length") - first).cast("int").alias("chunk_length"))


def contigs_from_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Contigs made of a text's letters, for tables that hold no sequences."""
    # else a filter by length would ask for it twice
    seq = F.pandas_udf(_bases_of, "string").asNondeterministic()(F.col(text_column))
    return docs.select(F.col(id_column).alias("contig_id"), seq.alias("seq")).withColumn("length", F.length("seq"))


_KNOWN = (LETTERS + LETTERS.upper()).encode()
_TO_BASES = bytes.maketrans(_KNOWN, (NUCLEOTIDES * 2).encode())
_NO_LETTERS = bytes(set(range(256)) - set(_KNOWN))


def _bases_of(texts: pd.Series) -> pd.Series:
    """Letters to nucleotides; all else goes. No byte of a character beyond ASCII is a letter's."""
    return pd.Series([None if t is None else t.encode("utf-8", "surrogatepass").translate(_TO_BASES, _NO_LETTERS).decode("ascii") for t in texts], dtype=object)


def require_contigs(contigs: DataFrame) -> DataFrame:
    if contigs.isEmpty():
        raise ValueError("no sequences found in infile")
    return contigs


def require_file(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"{path} does not exist")
    return path


def in_range(x: Column, start, end) -> Column:
    return x.between(start, end)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated source, peg, count; compressed or not."""
    return spark.read.schema("source string, peg string, count long").option("sep", "\t").csv(path)


def callers(spark: SparkSession, path: str) -> DataFrame:
    """genome, stop, length, callers of tab-separated lines; lines with fewer than four fields, or whose places aren't
    numbers, are left out."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 4)
    rows = parts.select(F.col("p")[0].alias("genome"), _number(F.col("p")[1]).alias("stop"), _number(F.col("p")[2]).alias("length"), F.col("p")[3].alias("callers"))
    return rows.where("stop IS NOT NULL AND length IS NOT NULL")


def _number(text: Column, kind: str = "long") -> Column:
    """Null where the text is no number of the kind."""
    return F.trim(text).try_cast(kind)


def explode_callers(rows: DataFrame) -> DataFrame:
    """A row for each caller of a list joined by hyphens, with how many there are."""
    parts = F.split("callers", "-")
    return rows.select("*", F.size(parts).alias("num_callers"), F.explode(parts).alias("caller"))


def length_map(spark: SparkSession, path: str) -> DataFrame:
    """name, value of a JSON object of number lists."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("name", "values"))
    return entries.select("name", F.explode("values").alias("value"))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """read, orf, e_value of tab-separated alignments, with the order of lines in files; comment lines, and lines without a
    number in the eleventh field, are left out."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).where(~F.startswith("value", F.lit("#")))
    p = F.split("value", "\t")
    found = rows.select("file", "line", p[0].alias("read"), F.get(p, F.lit(1)).alias("orf"), _number(F.get(p, F.lit(10)), "double").alias("e_value"))
    return found.where("e_value IS NOT NULL")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Edges (src, dst, weight; 1 where none is given) of an adjacency file, and whether it is directed."""
    lines = spark.read.text(path)
    directed = lines.where(F.col("value").rlike(r"(?i)^#\s*DIRECTED=\s*(True|1)")).count() > 0
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(p.alias("p"))
    return rows.where(F.size("p") >= 2).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"), F.coalesce(_number(F.get("p", F.lit(2)), "double"), F.lit(1.0)).alias("weight")), directed


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node: those of lines of one word, which have no edges."""
    lines = spark.read.text(path).select(F.trim("value").alias("node"))
    return lines.where(F.col("node").rlike(r"^[^#\s]\S*$"))


def graph_head(spark: SparkSession, path: str) -> dict[str, str]:
    """What an adjacency file's head says: NAME, DIRECTED, V and E."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^#\s*(NAME|DIRECTED|V|E)=\s*(.*)$", 1).alias("k"), F.regexp_extract("value", r"^#\s*(NAME|DIRECTED|V|E)=\s*(.*)$", 2).alias("v"))
    return {r["k"]: r["v"].strip() for r in lines.where("k <> ''").limit(4).collect()}


def aragorn(lines: DataFrame) -> DataFrame:
    """tRNAs of the tool's brief output (contig_id, value): start, stop; start > stop on the other strand. Lines without two
    places are left out."""
    rows = lines.where(~F.startswith("value", F.lit(">")) & ~F.endswith("value", F.lit("found")))
    place = F.get(F.split(F.trim("value"), r"\s+"), F.lit(2))
    a, b = (_number(F.regexp_extract(place, r"\[(-?\d+),(-?\d+)\]", k), "int") for k in (1, 2))
    back = F.contains(place, F.lit("c"))
    found = rows.select("contig_id", F.when(back, b).otherwise(a).alias("start"), F.when(back, a).otherwise(b).alias("stop"))
    return found.where("start IS NOT NULL AND stop IS NOT NULL")


def trnascan(lines: DataFrame) -> DataFrame:
    """tRNAs of the tool's tab-separated output (contig_id, value); lines without two places, as its heads, are left out."""
    p = F.split("value", "\t")
    found = lines.select("contig_id", _number(F.get(p, F.lit(2)), "int").alias("start"), _number(F.get(p, F.lit(3)), "int").alias("stop"))
    return found.where("start IS NOT NULL AND stop IS NOT NULL")


def trnas(spark: SparkSession, path: str) -> DataFrame:
    """contig_id, start, stop of a tool's output in a file: tab-separated lines that begin with the contig's name, or brief
    output, in which a line with > and the name comes before a contig's own lines."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place"))
    tabbed = F.size(F.split("value", "\t")) >= 4
    named = trnascan(lines.where(tabbed).select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("contig_id"), "value"))
    # the name carries over the lines that follow: a file of finds, far smaller than the sequences
    head = F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>\s*(\S+)", 1))
    brief = lines.where(~tabbed).withColumn("contig_id", F.last(head, ignorenulls=True).over(Window.orderBy("place")))
    return named.unionByName(aragorn(brief.where("contig_id IS NOT NULL").select("contig_id", "value")))
