"""Which files a question is about: versions, active snapshots, filters, and module rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import has_at_most, small_side
from docstrata.functions.text import glob_regex
from docstrata.operators.snapshot_changes import snapshot_order

#: Module rules become one expression; more rules than this are refused.
RULES = 5_000


def latest_snapshots(snapshots: DataFrame, back: int = 0) -> DataFrame:
    """``source_id, snapshot_id``: of each source the latest snapshot, or the one ``back`` places before it."""
    order = snapshot_order(snapshots)
    return order.where(F.col("idx") == F.col("last") - back).select("source_id", "snapshot_id")


def first_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshot_order(snapshots).where("idx = 0").select("source_id", "snapshot_id")


def current_files(files: DataFrame) -> DataFrame:
    """One row per file of a snapshot: of rows delivered more than once the latest loaded (an upsert, last one wins)."""
    columns = [c for c in files.columns if c != "file_id"]
    return files.groupBy("file_id").agg(F.max_by(F.struct(*columns), F.struct("loaded_at", *columns)).alias("f")).select("file_id", "f.*")


def in_scope(
    files: DataFrame,
    scope: DataFrame,
    module_id: str | None = None,
    role: str | None = None,
    board: str | None = None,
    revision: str | None = None,
) -> DataFrame:
    """The files of the snapshots in ``scope`` that meet every given filter."""
    given = {"module_id": module_id, "role": role, "board": board, "revision": revision}
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, given.items(), files)
    return kept.join(small_side(scope.select("snapshot_id").distinct()), "snapshot_id", "left_semi")


def files_of(files: DataFrame, scope: DataFrame, **given: str | None) -> DataFrame:
    """The current files of the snapshots in ``scope`` that meet every given filter.

    A file id names its snapshot, so the scope cuts the rows where they are read, before rows delivered twice are shuffled
    together; the other filters hold for what was loaded last.
    """
    kept = current_files(in_scope(files, scope))
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, given.items(), kept)


def coverage(files: DataFrame, snapshots: DataFrame, scope: DataFrame) -> DataFrame:
    """``source_id, documents, failed``: files in scope and diagnostics of its snapshots, per source."""
    errors = snapshots.dropDuplicates(["snapshot_id"]).select("snapshot_id", F.coalesce(F.size("errors"), F.lit(0)).alias("failed"))
    counts = files_of(files, scope).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("documents"))
    return (
        scope.join(errors, "snapshot_id", "left")
        .join(counts, "snapshot_id", "left")
        .groupBy("source_id")
        .agg(
            F.sum(F.coalesce("documents", F.lit(0))).alias("documents"),
            F.sum(F.greatest(F.coalesce("failed", F.lit(0)), F.lit(0))).cast("long").alias("failed"),
        )
    )


def first_rule(rules: DataFrame, path: Column, source: Column) -> Column:
    """``struct<module_id, role>`` of the first rule, in order of registration, that fits a path of a source; else null.

    Rules are settings, not data: they are read to the driver (up to RULES) and become one chain of conditions, so that
    files are mapped in a single narrow pass.
    """
    if not has_at_most(rules, RULES):
        raise ValueError(f"more than {RULES} module rules")
    chain = F.lit(None).cast("struct<module_id:string,role:string>")
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    for r in reversed(rules.orderBy("module_ord", "rule_ord").collect()):
        fits = p.rlike(glob_regex(r.pattern))
        fits = fits if r.source_id is None else fits & (source == r.source_id)
        chain = F.when(fits, F.struct(F.lit(r.module_id).alias("module_id"), F.lit(r.role).cast("string").alias("role"))).otherwise(chain)
    return chain


def inherited_keys(now: DataFrame, before: DataFrame, source: str = "source_id") -> DataFrame:
    """``now`` with ``inherited_key``: the logical key of the same path in the previous snapshot, else of the only file
    there with the same content, else a new one from source and path.

    A path copied to a new name inherits the key of its original, even if that still exists. Null hashes match nothing.
    """
    by_path = before.select(source, "path", F.col("logical_key").alias("path_key"))
    by_hash = (
        before.where("raw_hash IS NOT NULL")
        .groupBy(source, "raw_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("logical_key").alias("hash_key"))
        .where("n = 1")
        .drop("n")
    )
    return (
        now.join(by_path, [source, "path"], "left")
        .join(by_hash, [source, "raw_hash"], "left")
        .withColumn("inherited_key", F.coalesce("path_key", "hash_key", F.concat(source, F.lit(":"), "path")))
        .drop("path_key", "hash_key")
    )


def keep_latest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
