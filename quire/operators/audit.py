"""Kept, skipped and failed rows of one pass, with the reason of each and counts that come with it (HP1, HP2, AG7, AG12, FI13).

Rules are predicates in order of precedence.  A row that a failure predicate hits has failed, else the first rule that hits is why it is
skipped.  The pass writes each row once, into the folder of its outcome, and `observe` counts reasons as rows
stream by, so neither the split nor the counts scan the input again.

Defined cases: a null predicate doesn't hit; an input without rows has all counts 0; columns named like the audit's own are errors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.session import shared_folder

KEPT, SKIPPED, FAILED = "kept", "skipped", "failed"


@dataclass
class Audited:
    """What a pass left: its rows by outcome, and how many had each reason; `counts` has `kept` beside the reasons."""

    path: str
    schema: object
    counts: dict[str, int]
    spark: object

    def rows(self, outcome: str) -> DataFrame:
        """Rows of one outcome; only its folder is read."""
        whole = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("outcome") == outcome)
        return whole.drop("outcome", "reason") if outcome == KEPT else whole.drop("outcome")

    def exit_code(self) -> int:
        """1 if any row failed (AG12)."""
        return int(any(n for r, n in self.counts.items() if r.startswith("failed:")))


def with_reasons(rows: DataFrame, rules: dict[str, Column], failures: dict[str, Column] | None = None) -> DataFrame:
    """rows with outcome and reason, the first that hits; a failure's reason begins with `failed:`."""
    if {"outcome", "reason"} & set(rows.columns):
        raise ValueError("the input has a column outcome or reason")
    named = [(f"failed:{n}", c) for n, c in (failures or {}).items()] + list(rules.items())
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named], F.lit(None).cast("string")) if named else F.lit(None).cast("string")
    out = rows.withColumn("reason", reason)
    return out.withColumn("outcome", F.when(F.col("reason").isNull(), KEPT).when(F.col("reason").startswith("failed:"), FAILED).otherwise(SKIPPED))


def audited(rows: DataFrame, rules: dict[str, Column], failures: dict[str, Column] | None = None) -> Audited:
    """Run the pass; rules may use any column of rows."""
    spark = rows.sparkSession
    marked = with_reasons(rows, rules, failures)
    reasons = [*[f"failed:{n}" for n in failures or {}], *rules]
    seen = Observation(f"audit-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in reasons]
    path = f"{shared_folder(spark)}/quire-audit-{uuid.uuid4().hex}"
    marked.observe(seen, F.count_if(F.col("outcome") == KEPT).alias(KEPT), *counts).write.partitionBy("outcome").parquet(path)
    return Audited(path, marked.schema, dict(seen.get), spark)


def duplicate(rows: DataFrame, key: Column, order: str, wanted: Column | None = None, out: str = "duplicate") -> DataFrame:
    """Adds whether an earlier row of the same key is there, by a unique order; rows that aren't wanted neither count nor are duplicates (WI1).

    The first place of each key is combined before the shuffle, so a hot key is one row of each task.
    """
    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    marked = rows.withColumns({"__key": key, "__wanted": wanted})
    first = marked.where("__wanted AND __key IS NOT NULL").groupBy("__key").agg(F.min(order).alias("__first"))
    joined = marked.join(first, "__key", "left")
    return joined.withColumn(out, F.coalesce(F.col("__wanted") & (F.col(order) > F.col("__first")), F.lit(False))).drop("__key", "__wanted", "__first")


def page_files(pages: DataFrame, garbage: Column, path: str = "path", order: str = "place") -> Audited:
    """Picture files without garbage, then the first of each path, others with their reason (HP1, FI6, WI1)."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(^|/)(\./)+", "$1"), "/{2,}", "/"))
    bad = pages.withColumn("__garbage", garbage)
    marked = duplicate(bad, key, order, F.col("__garbage").isNull())
    out = audited(marked, {"garbage-image": F.col("__garbage").isNotNull(), "duplicate": F.col("duplicate")})
    return out


def skip_line(reason: Column, path: Column) -> Column:
    """The log line of a skipped file (HP2)."""
    return F.concat(F.lit("  - skip ["), reason, F.lit("] "), F.regexp_extract(path, r"([^/\\]*)$", 1))


def rebuilds(targets: DataFrame, covers: DataFrame, blank: DataFrame) -> DataFrame:
    """targets (archive, there) with `action`: build, skip, or rebuild where the archive's cover is missing, can't be read or is blank (FI13).

    covers: (archive, name) as archives.cover_entries gives them, without a row where the archive can't be read; blank: (archive, blank) of the
    covers that could be decoded.
    """
    judged = targets.join(covers.select("archive", F.col("name").alias("__cover")), "archive", "left").join(blank.select("archive", F.col("blank").alias("__blank")), "archive", "left")
    poor = F.col("__cover").isNull() | F.coalesce("__blank", F.lit(True))
    return judged.withColumn("action", F.when(~F.coalesce("there", F.lit(False)), "build").when(poor, "rebuild").otherwise("skip")).drop("__cover", "__blank")
