r"""Operator 2, licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Compared are units of a file: runs of one to three lines (statements that are wrapped), its header (the leading comment,
across blank lines) and the whole file (licence files). Words are runs of a-z and 0-9, A-Z in lower case, so comment
marks don't count; a word weighs 1 + ln(count) times its rarity among the templates, words that no template has the
highest rarity. A unit's words are joined with a broadcast table of (word, template, weight), and what agrees is summed
up. A unit names the template of the highest cosine if that is THRESHOLD or more, and a file its best unit's licence
(ties: the first line, the shortest run, the first name). A file whose best unit holds SHARE of its words or more, or
that names a licence and is called LICENSE, COPYING or the like, is a licence file and speaks for its directory (the best
one, ties: the smallest path, then the first name). A file that names no licence takes that of the nearest ancestor
directory, its own included, that has one.

Only units that can reach the threshold are scored: a unit that lacks words which make up over 1 - THRESHOLD**2 of a
template's squared weights can't reach it, so each must hold one of a set of such words. Any such set drops no match; the
one that is taken has words that are rare among the first SAMPLE files, and files without any of them aren't looked at
further.

Null texts are empty, null paths lie in no directory and inherit nothing; each row gives one row, rows that repeat an id
or a path are files each, an empty table gives none. Columns other than those named aren't read, so they may have any
name. A very long text is split once; only units with one of those words become rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, whole_text
from .license_texts import TEMPLATES

THRESHOLD = 0.8
SHARE = 0.25
#: Lines of a run at most.
RUN = 3
#: Files by which the words that units must hold are chosen; what is found doesn't depend on them.
SAMPLE = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "[^a-z0-9]+"
_COMMENT = r"""^[ \t\r]*($|#|//|/\*|\*|--|;|%|<!--|"{3}|'{3})"""
#: How a comment of several lines begins and ends.
_SPANS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'))
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-_][^/]*)?$"
_UNIT = "array<struct<line:int,span:int>>"


class Model:
    """Weights of templates' words; templates may be several texts a licence, or one."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]] = TEMPLATES):
        texts = [(name, text) for name, own in sorted(templates.items()) for text in ([own] if isinstance(own, str) else own)]
        counts = [(name, Counter(w for w in re.split(_BREAK, text.lower()) if w)) for name, text in texts]
        found_in = Counter(w for _, c in counts for w in c)
        rarity = lambda df: math.log((1 + len(counts)) / (1 + df)) + 1
        self.rarity = {w: rarity(n) for w, n in sorted(found_in.items())}
        self.unknown = rarity(0)
        #: (template number, licence, word, weight)
        self.terms: list[tuple[int, str, str, float]] = []
        for k, (name, c) in enumerate(counts):
            raw = {w: (1 + math.log(n)) * self.rarity[w] for w, n in sorted(c.items())}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.terms += [(k, name, w, x / norm) for w, x in raw.items()]

    def anchors(self, threshold: float, often: dict[str, int] | None = None) -> list[str]:
        """Words of which each unit that reaches the threshold holds at least one; often says in how many files of a sample
        they are."""
        often = often or {}
        out: set[str] = set()
        own: dict[int, list[tuple[str, float]]] = {}
        for k, _, w, x in self.terms:
            own.setdefault(k, []).append((w, x))
        # short texts have no choice, so they come first; rare words, then those that serve already, then long ones
        for words in sorted(own.values(), key=lambda words: (len(words), words)):
            total = 0.0
            for w, x in sorted(words, key=lambda i: (often.get(i[0], 0), i[0] not in out, -len(i[0]), i[0])):
                if total > 1 - threshold**2 + 1e-9:
                    break
                out.add(w)
                total += x * x
        return sorted(out)


def scan(files: DataFrame, templates: dict[str, str | tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, share: float = SHARE, path_column: str = "path", text_column: str = "text", id_column: str | None = None) -> DataFrame:
    """Per file: the id (the path where no id is named), license (null: none), cosine of its own best unit, line (from 0) and
    span (lines) of that, and from_dir, the directory that it inherits from."""
    spark = files.sparkSession
    scratch = Scratch(spark, "license")
    model = Model(templates)
    path, text = F.col(path_column), whole_text(text_column)
    seen = files.limit(SAMPLE).select(F.explode(F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), _BREAK))).alias("word"))
    rarity = F.broadcast(spark.createDataFrame(list(model.rarity.items()), "word string, rarity double"))
    # as many rows as the templates have words
    anchors = model.anchors(threshold, {r["word"]: r["count"] for r in seen.join(rarity, "word").groupBy("word").count().collect()})
    directory = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))
    # wider than the words themselves, and quick: most files end here
    held = F.lower(text)
    hit = F.lit(False)
    for w in anchors:
        if not any(v in w for v in anchors if v != w):
            hit = hit | held.contains(w)
    listed = files.select(F.monotonically_increasing_id().alias("file"), F.col(id_column or path_column).alias("id"), path.alias("path"), directory.alias("dir"), F.when(hit, text).alias("text"))
    listed = scratch.write(listed, "files")
    own = scratch.write(_own(listed, model, anchors, threshold, scratch), "own")
    named = F.coalesce(F.col("path").rlike(_NAMED), F.lit(False))
    speaks = own.where("dir IS NOT NULL").where(named | (F.col("words") >= share * F.col("all_words")))
    best = F.min(F.struct((-F.col("cosine")).alias("far"), "path", "license"))
    speaking = scratch.write(speaks.groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("from_dir"), F.col("best.license").alias("inherited")), "speaking")
    rest = listed.drop("text").join(own.select("file"), "file", "left_anti")
    # directories, not files, look for their ancestors: a directory with many files does it once
    dirs = rest.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    upward = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("from_dir")))
    above = dirs.select("dir", F.inline(upward))
    nearest = above.join(speaking, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "inherited")).alias("near"))
    nearest = scratch.write(nearest.select("dir", "near.from_dir", "near.inherited"), "nearest")
    none = lambda kind: F.lit(None).cast(kind)
    rest = rest.join(nearest, "dir", "left").select("id", F.col("inherited").alias("license"), none("double").alias("cosine"), none("int").alias("line"), none("int").alias("span"), "from_dir")
    found = own.select("id", "license", "cosine", "line", "span", none("string").alias("from_dir"))
    return found.unionByName(rest).withColumnRenamed("id", id_column or path_column)


def _header(text: Column, lines: Column) -> Column:
    """How many lines the leading comment has."""
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT)), True)
    marked = F.when(code == 0, F.size(lines)).otherwise(code - 1)
    opened = F.regexp_replace(text, r"^[ \t\r\n]+", "")
    span = F.lit(0)
    for begin, end in _SPANS:
        # the end is looked for behind the beginning
        rest = F.expr(f"locate('{end}', text, locate('{begin}', text) + {len(begin)})")
        span = F.when(opened.startswith(begin) & (rest > 0), F.size(F.split(F.substring(text, F.lit(1), rest), "\n"))).otherwise(span)
    return F.greatest(marked, span).cast("int")


def _own(files: DataFrame, model: Model, anchors: list[str], threshold: float, scratch: Scratch) -> DataFrame:
    """The files that name a licence: file, id, path, dir, license, cosine, line, span, words (of the unit), all_words."""
    spark = files.sparkSession
    hint = f"(^|[^a-z0-9])({'|'.join(anchors)})([^a-z0-9]|$)"
    low = files.where("text IS NOT NULL").withColumn("text", F.translate("text", _UPPER, _LOWER))
    lines = low.select("file", "id", "path", "dir", "text", F.split("text", "\n").alias("lines"))
    lines = lines.withColumn("marks", F.transform("lines", lambda x: x.rlike(hint))).withColumn("header", _header(F.col("text"), F.col("lines")))
    size = F.size("lines")
    # runs that begin at a line with such a word or up to RUN - 1 lines before it
    marked = F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.get("marks", k))
    near = F.array_distinct(F.flatten(F.transform(marked, lambda k: F.sequence(F.greatest(F.lit(0), k - (RUN - 1)), k))))
    runs = F.flatten(F.transform(near, lambda k: F.transform(F.sequence(F.lit(1), F.lit(RUN)), lambda n: F.struct(k.alias("line"), n.alias("span")))))
    runs = F.filter(runs, lambda u: u["line"] + u["span"] <= size)
    long = F.filter(F.array(F.struct(F.lit(0).alias("line"), F.col("header").alias("span")), F.struct(F.lit(0).alias("line"), size.alias("span"))), lambda u: u["span"] > 0)
    units = lines.withColumn("unit", F.explode(F.array_distinct(F.concat(runs.cast(_UNIT), long.cast(_UNIT)))))
    unit = F.array_join(F.slice("lines", F.col("unit.line") + 1, F.col("unit.span")), " ")
    units = units.select("file", "unit.line", "unit.span", unit.alias("text")).where(F.col("text").rlike(hint))
    words = units.select("file", "line", "span", F.explode(F.split("text", _BREAK)).alias("word")).where("word <> ''")
    counts = words.groupBy("file", "line", "span", "word").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as the templates have words
    rarity = F.broadcast(spark.createDataFrame(list(model.rarity.items()), "word string, rarity double"))
    weighed = counts.join(rarity, "word", "left").withColumn("weight", (1 + F.log(F.col("n").cast("double"))) * F.coalesce("rarity", F.lit(model.unknown)))
    weighed = scratch.write(weighed.select("file", "line", "span", "word", "n", "weight"), "weighed")
    norms = weighed.groupBy("file", "line", "span").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum("n").alias("words"))
    terms = F.broadcast(spark.createDataFrame(model.terms, "template int, license string, word string, own double"))
    dots = weighed.join(terms, "word").groupBy("file", "line", "span", "template", "license").agg(F.sum(F.col("weight") * F.col("own")).alias("dot"))
    scored = dots.join(norms, ["file", "line", "span"]).withColumn("cosine", F.col("dot") / F.col("norm")).where(F.col("cosine") >= threshold - 1e-9)
    best = F.max(F.struct(F.round("cosine", 6).alias("cosine"), (-F.col("line")).alias("line"), (-F.col("span")).alias("span"), F.transform(F.split("license", ""), lambda c: -F.ascii(c)).alias("name"), "license", "words"))
    best = scored.groupBy("file").agg(best.alias("best"))
    whole = F.size(F.filter(F.split("text", _BREAK), lambda w: w != ""))
    found = low.select("file", "id", "path", "dir", whole.alias("all_words")).join(best, "file")
    return found.select("file", "id", "path", "dir", "best.license", "best.cosine", (-F.col("best.line")).alias("line"), (-F.col("best.span")).alias("span"), "best.words", "all_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the licence of every document. Documents have no paths; theirs are source, then two levels by id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.pmod(F.col("doc_id"), F.lit(10)).cast("string"), F.pmod(F.expr("doc_id div 10"), F.lit(10)).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"), id_column="doc_id")


def _oracle() -> str:
    model = Model()
    terms = ", ".join(f"({k}, '{n}', '{w}', {x!r})" for k, n, w, x in model.terms)
    rare = ", ".join(f"('{w}', {r!r})" for w, r in model.rarity.items())
    comment = _COMMENT.replace("'", "''")
    spans = " ".join(
        f"WHEN starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '{b}') AND strpos(substring(text, strpos(text, '{b}') + {len(b)}), '{e}') > 0 "
        f"THEN len(string_split(substring(text, 1, strpos(text, '{b}') + {len(b) - 1} + strpos(substring(text, strpos(text, '{b}') + {len(b)}), '{e}')), chr(10)))"
        for b, e in _SPANS
    )
    return f"""
WITH terms(template, license, word, own) AS (VALUES {terms}), rare(word, r) AS (VALUES {rare}),
f AS (
  SELECT doc_id, concat_ws('/', coalesce(source, ''), doc_id % 10, doc_id // 10 % 10) AS dir,
         concat_ws('/', coalesce(source, ''), doc_id % 10, doc_id // 10 % 10, doc_id) AS path,
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents
),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM f),
h AS (
  SELECT *, greatest(coalesce(list_position(list_transform(lines, lambda x: NOT regexp_matches(x, '{comment}')), true) - 1, len(lines)), CASE {spans} ELSE 0 END) AS header FROM l
),
u AS (
  SELECT DISTINCT doc_id, line, span, array_to_string(lines[line + 1:line + span], ' ') AS text FROM (
    SELECT doc_id, lines, line, unnest(range(1, {RUN + 1})) AS span FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS line FROM l)
    UNION ALL SELECT doc_id, lines, 0, header FROM h WHERE header > 0 UNION ALL SELECT doc_id, lines, 0, len(lines) FROM l
  ) WHERE line + span <= len(lines)
),
w AS (SELECT doc_id, line, span, unnest(string_split_regex(text, '{_BREAK}')) AS word FROM u),
c AS (SELECT doc_id, line, span, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
g AS (SELECT c.*, (1 + ln(n)) * coalesce(r, {model.unknown!r}) AS weight FROM c LEFT JOIN rare USING (word)),
norms AS (SELECT doc_id, line, span, sqrt(sum(weight * weight)) AS norm, sum(n) AS words FROM g GROUP BY ALL),
scores AS (
  SELECT doc_id, line, span, template, license, sum(weight * own) / any_value(norm) AS cosine, any_value(words) AS words
  FROM g JOIN terms USING (word) JOIN norms USING (doc_id, line, span) GROUP BY ALL HAVING sum(weight * own) / any_value(norm) >= {THRESHOLD} - 1e-9
),
own AS (SELECT * REPLACE (round(cosine, 6) AS cosine) FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 6) DESC, line, span, license) = 1),
total AS (SELECT doc_id, len(list_filter(string_split_regex(text, '{_BREAK}'), lambda x: x <> '')) AS all_words FROM f),
speaking AS (
  SELECT dir, first(license ORDER BY cosine DESC, path, license) AS inherited FROM own JOIN f USING (doc_id) JOIN total USING (doc_id) WHERE words >= {SHARE} * all_words GROUP BY dir
),
near AS (
  SELECT f.doc_id, s.dir AS from_dir, s.inherited FROM f ANTI JOIN own USING (doc_id) JOIN speaking s ON f.dir = s.dir OR starts_with(f.dir, s.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(s.dir) DESC) = 1
)
SELECT doc_id, coalesce(own.license, inherited) AS license, cosine, CAST(line AS INTEGER) AS line, CAST(span AS INTEGER) AS span, from_dir
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""


ORACLE_SQL = _oracle()
