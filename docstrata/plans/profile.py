"""Counts and health of sources, contents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.common import small_side, table
from docstrata.functions import text as tx
from docstrata.plans.register import query
from docstrata.streaming.watch import quiet_periods


@query(
    "source_counts",
    """
SELECT s.source_id, trim(s.name, ' ') AS name, coalesce(d.n, 0) AS documents, coalesce(k.n, 0) AS files
FROM sources s LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d ON d.source = s.source_id
LEFT JOIN (SELECT source_id, count(DISTINCT path) AS n FROM kb_files GROUP BY source_id) k ON k.source_id = s.source_id
""",
)
def source_counts(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    files = table(spark, directory, "kb_files").select("source_id", "path").distinct().groupBy("source_id").agg(F.count("path").alias("files"))
    return (
        table(spark, directory, "sources")
        .select("source_id", F.trim("name").alias("name"))
        .join(documents, F.col("source") == F.col("source_id"), "left")
        .join(files, "source_id", "left")
        .select("source_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "files")])
    )


@query(
    "global_counts",
    "SELECT 'sources' AS what, count(*) AS n FROM sources UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks",
)
def global_counts(spark: SparkSession, directory: str) -> DataFrame:
    counted = [
        table(spark, directory, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n") for t in ("sources", "documents", "chunks")
    ]
    return counted[0].union(counted[1]).union(counted[2])


@query(
    "boards_and_revisions",
    "SELECT DISTINCT 'board' AS kind, board AS value FROM documents WHERE board <> '' UNION SELECT DISTINCT 'revision', revision FROM documents WHERE revision <> ''",
)
def boards_and_revisions(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("board", "revision")]))
    return documents.select(kinds.alias("k")).select("k.kind", "k.value").where("value <> ''").distinct()


@query(
    "source_health",
    """
SELECT lower(status) AS status, count(*) AS sources, CAST(count(*) FILTER (paused) AS BIGINT) AS paused,
       CAST(sum(coalesce(len(errors), 0)) AS BIGINT) AS errors FROM sources GROUP BY lower(status)
""",
)
def source_health(spark: SparkSession, directory: str) -> DataFrame:
    return (
        table(spark, directory, "sources")
        .groupBy(F.lower("status").alias("status"))
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.count_if("paused").alias("paused"),
            F.sum(F.greatest(F.coalesce(F.size("errors"), F.lit(0)), F.lit(0))).cast("long").alias("errors"),
        )
    )


@query("sources_by_status", "SELECT source_id, name FROM sources WHERE lower(status) IN ('ready', 'stale')")
def sources_by_status(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "sources").where(F.lower("status").isin("ready", "stale")).select("source_id", "name")


@query(
    "source_defaults",
    "SELECT source_id, trim(name, ' ') AS name, coalesce(upper(nullif(trim(board), '')), '-') AS board, coalesce(project_id, 'default') AS project_id, "
    "coalesce(role, 'spec') AS role, coalesce(paused, false) AS paused FROM sources",
)
def source_defaults(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "sources").select(
        "source_id",
        F.trim("name").alias("name"),
        F.coalesce(F.upper(F.nullif(F.trim("board"), F.lit(""))), F.lit("-")).alias("board"),
        F.coalesce("project_id", F.lit("default")).alias("project_id"),
        F.coalesce("role", F.lit("spec")).alias("role"),
        F.coalesce("paused", F.lit(False)).alias("paused"),
    )


@query("files_without_paused_sources", "SELECT DISTINCT source_id, path FROM kb_files WHERE source_id NOT IN (SELECT source_id FROM sources WHERE paused)")
def files_without_paused_sources(spark: SparkSession, directory: str) -> DataFrame:
    paused = table(spark, directory, "sources").where("paused").select("source_id")
    return table(spark, directory, "kb_files").join(small_side(paused), "source_id", "left_anti").select("source_id", "path").distinct()


@query(
    "content_sharing",
    """
SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(DISTINCT raw_hash) AS BIGINT) AS contents, CAST(sum(b) AS BIGINT) AS bytes,
  (SELECT CAST(sum(b) AS BIGINT) FROM (SELECT raw_hash, max(octet_length(encode(text))) AS b FROM documents WHERE text IS NOT NULL GROUP BY raw_hash)) AS shared_bytes
FROM (SELECT raw_hash, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL)
""",
)
def content_sharing(spark: SparkSession, directory: str) -> DataFrame:
    sized = table(spark, directory, "documents").where("text IS NOT NULL").select("raw_hash", F.octet_length("text").alias("b"))
    per_content = sized.groupBy("raw_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("all"), F.max("b").alias("one"))
    return per_content.agg(
        F.sum("n").alias("files"),
        F.count("raw_hash").alias("contents"),
        F.sum("all").cast("long").alias("bytes"),
        F.sum("one").cast("long").alias("shared_bytes"),
    )


SUPPORTED_SQL = (
    "(lower(string_split(path, '/')[-1]) IN ('makefile', 'cmakelists.txt') OR "
    "lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^.]+)$', 1)) IN (" + ", ".join(f"'{x}'" for x in tx.SUPPORTED) + ")) "
    "AND NOT list_has_any(list_transform(string_split(path, '/')[:-2], lambda x: lower(x)), [" + ", ".join(f"'{x}'" for x in tx.EXCLUDED) + "]) "
    "AND NOT starts_with(string_split(path, '/')[-1], '~$')"
)


@query("supported_files", f"SELECT DISTINCT source_id, path FROM kb_files WHERE {SUPPORTED_SQL}")
def supported_files(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "kb_files").where(tx.is_supported(F.col("path"))).select("source_id", "path").distinct()


@query(
    "glob_matches",
    "SELECT source_id, CAST(count(DISTINCT path) AS BIGINT) AS files FROM kb_files WHERE regexp_matches(path, '^src/.*/[^/]*\\.c$', 'is') GROUP BY source_id",
)
def glob_matches(spark: SparkSession, directory: str) -> DataFrame:
    kept = table(spark, directory, "kb_files").where(F.col("path").rlike(tx.glob_regex("src/**/*.c")))
    return kept.select("source_id", "path").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("files"))


@query(
    "debounced_changes",
    """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS source_id, min(ts) AS began, max(ts) AS last_change, count(*) AS changes FROM g GROUP BY user_id, k
""",
)
def debounced_changes(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))
    found = quiet_periods(events, "1 hour")
    return found.select("source_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("began", "last_change")], "changes")


@query(
    "pending_embeddings",
    "SELECT lang, count(DISTINCT doc_id) AS pending FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang",
)
def pending_embeddings(spark: SparkSession, directory: str) -> DataFrame:
    """How many texts of each language wait for their vector."""
    done = table(spark, directory, "embeddings").select(F.col("vec_id").alias("doc_id"))
    waiting = table(spark, directory, "documents").where("text <> ''").select("doc_id", "lang").join(done, "doc_id", "left_anti")
    return waiting.groupBy("lang").agg(F.count_distinct("doc_id").alias("pending"))


@query(
    "source_checks",
    """
WITH s AS (SELECT DISTINCT snapshot_id, source_id, created_at, complete FROM snapshots)
SELECT sources.source_id, count(s.snapshot_id) AS snapshots, count(*) FILTER (s.complete = false) AS incomplete, epoch_us(max(s.created_at)) AS latest_us
FROM sources LEFT JOIN s USING (source_id) GROUP BY sources.source_id
""",
)
def source_checks(spark: SparkSession, directory: str) -> DataFrame:
    """Each source's snapshots, how many of them are incomplete, and when it was last looked at."""
    once = table(spark, directory, "snapshots").select("snapshot_id", "source_id", "created_at", "complete").distinct()
    held = once.groupBy("source_id").agg(
        F.count("snapshot_id").alias("snapshots"), F.count_if(~F.col("complete")).alias("incomplete"), F.unix_micros(F.max("created_at")).alias("latest_us")
    )
    return table(spark, directory, "sources").select("source_id").join(held, "source_id", "left").select(
        "source_id", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), F.coalesce("incomplete", F.lit(0)).alias("incomplete"), "latest_us"
    )
