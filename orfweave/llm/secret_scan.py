"""Operator 3, secret scan over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content. The ledger says which blobs were
scanned under which version of the rules and what was found; a run scans each blob that its rule version
hasn't seen once, however many paths and versions share it, appends that to the ledger, and joins the
findings back to all paths. Digests are compared first; texts are read again for unseen blobs only.

Rules are regular expressions that Java and RE2 read alike. A match's place comes from the lengths of what
stands between the matches, so no code outside the SQL functions is needed. Null texts are empty, each row
gives one row, rows that repeat and null ids too, an empty table gives none, and columns other than the path and the
text aren't read. A text is scanned whole in one task, whatever its length, and its matches are ordered there; matches
of several rules that begin at one place come in the rules' order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret. What counts as its value is a group of the pattern; matches with a shorter value are dropped
    after they have taken their place among the matches."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    """The pattern with each ASCII letter in either case, spelt out: engines differ on what folding reaches."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in words)


_NAMES = either_case("password|passwd|secret|token|api_?key")
#: In the order in which findings at the same place are listed.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is long enough is found whole: the repetition is greedy, and a shorter run has no long part
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    """A name that changes with the rules, so that edited rules scan all blobs again."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER_SCHEMA = f"blob string, spans {SPANS}"


class Ledger:
    """What was scanned: a folder of Parquet files in a folder for each rule version, a row for each blob; rows that two
    runs at the same time have both written count once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, version: str) -> str:
        return f"{self.path}/rules={version}"

    def read(self, version: str) -> DataFrame:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(version))
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self._folder(version)).dropDuplicates(["blob"])

    def append(self, rows: DataFrame, version: str) -> None:
        rows.select("blob", "spans").write.mode("append").parquet(self._folder(version))


def _matches(rule: Rule, number: int) -> Column:
    """A struct for each match: the rule's number, the characters before it since the last match, its own, its value's."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    found = F.transform(
        F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap")),
        lambda m: F.struct(F.lit(number).alias("rule"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("whole"), F.length(m["value"]).alias("value")),
    )
    none = F.array().cast("array<struct<rule:int,gap:int,whole:int,value:int>>")
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and text to blob and spans (code points, end exclusive), by start and then by the rules' order."""
    matches = blobs.select("blob", F.posexplode_outer(F.concat(*(_matches(r, k) for k, r in enumerate(rules)))).alias("place", "m"))
    matches = matches.select("blob", "place", "m.rule", "m.gap", "m.whole", "m.value")
    # what is summed up for one blob and rule is bounded by that blob's length
    upto = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(upto).cast("int"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule") + 1)
    span = F.when(F.col("value") >= least, F.struct((F.col("end") - F.col("whole")).alias("start"), F.col("rule"), kind.alias("kind"), F.col("end")))
    spans = placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))
    return spans.select("blob", F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPANS).alias("spans"))


#: Blobs whose digests are broadcast at most: some 20 MB.
FEW = 1 << 17


def _texts(addressed: DataFrame, unseen: DataFrame) -> DataFrame:
    """blob and text of the unseen blobs, once each. None need no text; up to FEW of them find their texts where these are
    read, so that known texts don't move; for more than that all texts meet them in one shuffle."""
    few = unseen.limit(FEW + 1).count()
    if not few:
        return addressed.select("blob", "text").limit(0)
    wanted = F.broadcast(unseen) if few <= FEW else unseen
    # copies fall together before the shuffle
    return addressed.select("blob", "text").join(wanted, "blob", "left_semi").dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, version: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per version: the id, blob and spans. Scans what the ledger lacks and appends it there."""
    scratch, version = Scratch(versions.sparkSession, "secrets"), version or rule_version(rules)
    text = whole_text(text_column)
    # digests only are written and moved; a row's number tells which row of a blob is read again
    addressed = versions.select(F.col(id_column).alias("id"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    paths = scratch.write(addressed.select("id", "blob"), "paths")
    unseen = scratch.write(paths.select("blob").join(ledger.read(version).select("blob"), "blob", "left_anti").distinct(), "unseen")
    ledger.append(scan_blobs(_texts(addressed, unseen), rules), version)
    found = paths.join(ledger.read(version), "blob")
    return found.select(F.col("id").alias(id_column), "blob", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: secrets in all documents, with a ledger that is empty at first."""
    found = scan(table(spark, sf_dir, "documents"), Ledger(spark, Scratch(spark, "ledger").path("ledger")))
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in RULES]
    text = listed(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _oracle_kind(number: int, rule: Rule) -> str:
    quote = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind, unnest(range(len(w))) AS i, w, v, g FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '{quote}', 0), lambda x: length(x)) AS w,
           list_transform(regexp_extract_all(text, '{quote}', {rule.group}), lambda x: length(x)) AS v,
           list_transform(string_split_regex(text, '{quote}'), lambda x: length(x)) AS g FROM t)"""


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_oracle_kind(k, r) for k, r in enumerate(RULES))}),
p AS (
  SELECT doc_id, rule, kind, w[i + 1] AS n, v[i + 1] AS value,
         list_sum(g[1:i + 1]) + coalesce(list_sum(w[1:i]), 0) AS start FROM m
),
s AS (
  SELECT doc_id, count_if(rule = 0) AS n_assign, count_if(rule = 1) AS n_access, count_if(rule = 2) AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rule) AS spans
  FROM p WHERE rule > 0 OR value >= {RULES[0].least} GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s USING (doc_id)
"""
