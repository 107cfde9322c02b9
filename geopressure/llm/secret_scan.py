"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. A blob is scanned once for each
version of the rules, however many rows or historical versions hold it: the ledger lists the pairs of
blob and rule version that were scanned, a run scans only pairs that are not in it, and findings are
joined back to every row that holds the blob.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopressure.llm.keys import without_keys
from geopressure.llm.store import Scratch

#: Kind, pattern, and the least length of the group that must be long enough (None: the whole match).
#: A run of a character class is maximal, so its least length can stand in the pattern itself.
RULES = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", None),
    ("hex", r"[0-9a-f]{24,}", None),
)
RULE_VERSION = "1"
#: Copies of each finding in the join back, so that one blob held by very many rows is spread.
SALTS = 16


class Scan(NamedTuple):
    """What a run leaves: the new ledger, all findings, and the rows with their blob."""

    ledger: DataFrame
    findings: DataFrame
    versions: DataFrame


def blob_id(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _find(texts: DataFrame) -> DataFrame:
    """``blob, kind, start, end`` of every match of every rule, in code points, end exclusive; one pass."""
    def parts(kind: str, pattern: str, least: int | None) -> Column:
        every = lambda group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        zipped = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), every(0).alias("match"), every(1 if least else 0).alias("part"))
        return F.struct(F.lit(kind).alias("kind"), F.lit(least or 0).alias("least"), zipped.alias("parts"))

    held = functools.reduce(lambda x, y: x | y, [F.col("text").rlike(pattern) for _, pattern, _ in RULES])
    # A holder's id can stand on several rows: of what holds a match, each blob is read once.
    rules = texts.where(held).dropDuplicates(["blob"]).select("blob", F.explode(F.array(*[parts(*rule) for rule in RULES])).alias("rule"))
    placed = rules.select("blob", "rule.kind", "rule.least", F.posexplode("rule.parts").alias("k", "x")).where("x.match is not null")
    before = Window.partitionBy("blob", "kind").orderBy("k")
    placed = placed.withColumn("end", F.sum(F.length("x.gap") + F.length("x.match")).over(before))
    placed = placed.where(F.length("x.part") >= F.col("least"))
    return placed.select("blob", "kind", (F.col("end") - F.length("x.match")).alias("start"), "end")


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> Scan:
    """Scan the blobs of ``docs(doc_id, text, ...)`` that ``ledger(blob, rule_version)`` does not list.

    ``findings(blob, kind, start, end)`` are those of earlier runs; they come back with the new ones.
    A null text counts as empty; rows that repeat, rows without doc_id and ids with several texts are scanned once for each
    blob; texts of any length are scanned whole; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select("doc_id", "text").withColumn("blob", blob_id(F.col("text")))
    versions = scratch.save(rows.select("doc_id", "blob"))
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    unseen = scratch.save(blobs)
    skipped = scratch.save(versions.select("doc_id").subtract(unseen.select(F.col("holder").alias("doc_id"))))
    texts = without_keys(rows, skipped, "doc_id").select("blob", "text")
    found = scratch.save(_find(texts).distinct())
    if findings is not None:
        found = findings.select("blob", "kind", "start", "end").unionByName(found).distinct()
    entries = unseen.select("blob", F.lit(RULE_VERSION).alias("rule_version"))
    if ledger is not None:
        entries = ledger.select("blob", "rule_version").unionByName(entries)
    return Scan(entries, found, versions)


def per_document(result: Scan) -> DataFrame:
    """One row for each row scanned: counts by kind, and all spans in order of start, then kind."""
    order = F.array_position(F.array(*[F.lit(k) for k, _, _ in RULES]), F.col("kind"))
    spans = F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "kind", "end")))
    blobs = result.findings.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, _, _ in RULES], spans.alias("s")
    )
    text = F.concat_ws(",", F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    blobs = blobs.select("blob", *[f"n_{k}" for k, _, _ in RULES], text.alias("spans")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    rows = result.versions.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(blobs, ["blob", "salt"], "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k, _, _ in RULES],
        F.sha2(F.coalesce("spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
