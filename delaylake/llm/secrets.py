"""Secret scans over every historical version, with an incremental ledger of blobs.

A version's text is addressed by its SHA-256; equal texts under any number of paths are one blob.
The ledger is two tables in a shared folder: ``findings`` (blob, rule, version, start, end) and
``scanned`` (blob, rule, version). A scan reads only the (blob, rule version) pairs that the
ledger does not have, appends what it found and then what it scanned, so a scan that is cut off
between the two is repeated and repeated findings fold when read. Findings are joined back to
all paths of their blob. Places are code points, ends are exclusive.

All of it is DataFrame functions: matches and the text between them come from the same pattern,
and running sums of their lengths give places. A null text is the empty blob. Repeated rows
each get their findings. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylake.llm._common import cut, private, shared_folder, text_or_empty


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str  # Java syntax; matches are leftmost and do not overlap
    group: int = 0  # the part whose length counts
    least: int = 1  # shorter matches are dropped, after they took their place


#: Longest runs: a minimum in the pattern selects the same runs as dropping shorter ones.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Portions over which the copies of one text are dealt.
SALTS = 16
SCANNED, FINDINGS = "blob binary, rule string, version int", "blob binary, rule string, version int, start long, end long"


class BlobLedger:
    """The two tables of a ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def append(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def _matches(text: Column, rule: Rule) -> Column:
    """For each match: its number, the text before it since the last one, its length, and whether it is long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(found, F.length)
    counted = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), F.length)
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("size"), counted.alias("part"))
    return F.transform(zipped, lambda m, i: F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), (m["part"] >= rule.least).alias("ok")))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text, todo) to findings, where todo holds the kinds to scan for."""
    none = F.array().cast("array<struct<rule: string, version: int, i: int, gap: int, size: int, ok: boolean>>")
    # one cheap test first: most texts have no match of any kind
    hit = None
    for rule in rules:
        one = F.array_contains("todo", rule.kind) & F.rlike("text", F.lit(rule.pattern))
        hit = one if hit is None else hit | one
    parts = [F.when(F.array_contains("todo", r.kind) & F.rlike("text", F.lit(r.pattern)), _matches(F.col("text"), r)).otherwise(none) for r in rules]
    matches = blobs.filter(hit).select("blob", F.explode(F.concat(*parts)).alias("m")).select("blob", "m.*")
    order = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(order)
    placed = matches.withColumn("end", end).filter("ok")
    return placed.select("blob", "rule", "version", (F.col("end") - F.col("size")).alias("start"), "end")


def scan_versions(versions: DataFrame, ledger: BlobLedger, path: str = "path", text: str = "text", rules=RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions``; (path, blob, rule, start, end) lists for every row.

    One row per input row: path, blob and findings, an array of (start, kind, rule, end) in the
    order of start and then of ``rules``; empty where nothing was found.
    """
    rows = private(versions, path=F.col(path), text=text_or_empty(text)).withColumn("blob", F.unhex(F.sha2("text", 256)))
    named = cut(rows.select("path", "blob"), "versions")
    own = named.select("blob").distinct()
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    seen = ledger.scanned()
    if seen.isEmpty():
        blobs = rows.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
        scanned = own.select("blob", F.inline(kinds))
    else:
        scanned = cut(own.select("blob", F.inline(kinds)).join(seen.distinct(), ["blob", "rule", "version"], "left_anti"), "unseen")
        # unseen blobs are selected before their texts travel, the copies of one in several portions
        todo = scanned.groupBy("blob").agg(F.collect_list("rule").alias("todo")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.hash("path"), F.lit(SALTS))).join(todo, ["blob", "salt"])
        blobs = salted.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("todo").alias("todo"))
    ledger.append(scan_blobs(blobs, rules), scanned)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.broadcast(versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int"))
    # of the ledger's findings only those in this scan's blobs are gathered
    found = ledger.findings().join(current, ["rule", "version"]).join(own, "blob", "left_semi")
    found = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", place[F.col("rule")].alias("kind"), "rule", "end"))).alias("findings"))
    found = cut(found, "by-blob")
    empty = F.array().cast(found.schema["findings"].dataType)
    return named.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", empty).alias("findings"))


def fresh_ledger(spark: SparkSession) -> BlobLedger:
    return BlobLedger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
