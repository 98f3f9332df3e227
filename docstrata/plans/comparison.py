"""Queries that join the parts: versions compared to the line, documents fetched, snapshots reused, versions frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.common import table
from docstrata.functions.diff import diff_pairs
from docstrata.functions.text import tag_regex
from docstrata.operators import scope as sc
from docstrata.operators import versions as ve
from docstrata.operators.snapshot_changes import snapshot_order
from docstrata.plans.register import query
from docstrata.plans.versions import ORDER, STATUS, compare_status


def _modified(spark: SparkSession, directory: str) -> DataFrame:
    """``logical_key, before_key, after_key``: the parsed contents of each modified file, first against latest snapshot."""
    files = table(spark, directory, "kb_files").select("file_id", "parsed_key").where("parsed_key IS NOT NULL").distinct()
    changed = compare_status(spark, directory).where("status = 'modified'").select("logical_key", "before_id", "after_id")
    old = files.select(F.col("file_id").alias("before_id"), F.col("parsed_key").alias("before_key"))
    new = files.select(F.col("file_id").alias("after_id"), F.col("parsed_key").alias("after_key"))
    return changed.join(old, "before_id").join(new, "after_id").select("logical_key", "before_key", "after_key")


MODIFIED = (
    STATUS
    + """, pk AS (SELECT DISTINCT file_id, parsed_key FROM kb_files WHERE parsed_key IS NOT NULL),
mo AS (SELECT r.logical_key, x.parsed_key AS before_key, y.parsed_key AS after_key FROM r JOIN pk x ON x.file_id = before_id JOIN pk y ON y.file_id = after_id WHERE status = 'modified'),
t AS (SELECT parsed_key, string_agg(text, chr(10) ORDER BY ordinal, text) AS text FROM chunks GROUP BY parsed_key)
"""
)


@query(
    "compared_chunks",
    MODIFIED
    + """, o1 AS (SELECT DISTINCT logical_key, after_key AS other, chunk_id, ordinal, text, 'removed' AS side FROM mo JOIN chunks ON parsed_key = before_key),
n1 AS (SELECT DISTINCT logical_key, before_key AS other, chunk_id, ordinal, text, 'added' AS side FROM mo JOIN chunks ON parsed_key = after_key)
SELECT logical_key, side, chunk_id, CAST(ordinal AS INTEGER) AS ordinal FROM (SELECT * FROM o1 UNION ALL SELECT * FROM n1) c
WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE parsed_key = c.other AND chunks.text = c.text)
""",
)
def compared_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Two versions compared end to end: of each modified file the chunks whose text only one side has."""
    chunks = table(spark, directory, "chunks").select("parsed_key", "chunk_id", "ordinal", "text")
    both = _modified(spark, directory)
    sides = [
        both.select("logical_key", F.col(mine).alias("parsed_key"), F.col(other).alias("other"), F.lit(side).alias("side"))
        for mine, other, side in (("before_key", "after_key", "removed"), ("after_key", "before_key", "added"))
    ]
    mine = sides[0].union(sides[1]).join(chunks, "parsed_key").distinct()
    other = chunks.select(F.col("parsed_key").alias("other"), "text").where("text IS NOT NULL")
    return mine.join(other, ["other", "text"], "left_anti").select("logical_key", "side", "chunk_id", "ordinal")


@query("version_hunks")
def version_hunks(spark: SparkSession, directory: str) -> DataFrame:
    """The line differences of each modified file, with the chunk of the new side that each hunk is cited by.

    Texts are the chunks of a document in order. A hunk is cited by the chunks whose lines it touches; one that only
    deletes by the chunk that holds the line before it, and if no chunk does, by the first of the document.
    """
    chunks = table(spark, directory, "chunks").where("text IS NOT NULL").select("parsed_key", "chunk_id", "ordinal", "text")
    both = _modified(spark, directory)
    wanted = both.select(F.explode(F.array("before_key", "after_key")).alias("parsed_key")).distinct()
    placed = ve.placed_chunks(chunks.join(wanted, "parsed_key", "left_semi"))
    texts = ve.joined_texts(placed)
    pairs = both.join(texts.select(F.col("parsed_key").alias("before_key"), F.col("text").alias("before")), "before_key").join(
        texts.select(F.col("parsed_key").alias("after_key"), F.col("text").alias("after")), "after_key"
    )
    found = diff_pairs(pairs.select(F.struct("logical_key", "after_key").alias("id"), "before", "after")).select("id.*", F.explode("hunks").alias("h"))
    return ve.cited_hunks(found, placed).select("logical_key", "before_start", "after_start", "removed", "added", "chunk_id")


@query(
    "document_fetch",
    f"""
WITH {ORDER}, h AS (SELECT snapshot_id, max(commit_hash) AS commit_hash FROM snapshots GROUP BY snapshot_id),
t AS (SELECT parsed_key, count(*) AS chunks, md5(string_agg(text, chr(10) ORDER BY ordinal, text)) AS digest FROM chunks GROUP BY parsed_key)
SELECT c.file_id, c.path, o.source_id, c.board, c.revision, commit_hash, chunks, digest
FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last JOIN t USING (parsed_key) LEFT JOIN h ON h.snapshot_id = c.snapshot_id
""",
)
def document_fetch(spark: SparkSession, directory: str) -> DataFrame:
    """Each parsed document of the latest snapshots with its whole text in order (here by its digest) and where it is from."""
    snapshots = table(spark, directory, "snapshots")
    latest = sc.latest_snapshots(snapshots)
    files = sc.files_of(table(spark, directory, "kb_files"), latest).select("file_id", "snapshot_id", "path", "board", "revision", "parsed_key")
    commits = snapshots.groupBy("snapshot_id").agg(F.max("commit_hash").alias("commit_hash"))
    texts = ve.joined_texts(table(spark, directory, "chunks"))
    return (
        files.join(texts, "parsed_key")
        .join(latest, "snapshot_id")
        .join(commits, "snapshot_id", "left")
        .select("file_id", "path", "source_id", "board", "revision", "commit_hash", "chunks", F.md5("text").alias("digest"))
    )


@query(
    "reused_snapshots",
    f"""
WITH {ORDER}, n AS (SELECT o.source_id, o.snapshot_id, o.idx, count(c.file_id) AS files FROM o LEFT JOIN c ON c.snapshot_id = o.snapshot_id GROUP BY ALL),
p AS (SELECT a.snapshot_id, b.snapshot_id AS before, a.files FROM n a JOIN n b ON a.source_id = b.source_id AND b.idx = a.idx - 1 AND a.files = b.files),
e AS (SELECT p.snapshot_id, count(*) AS same FROM p JOIN c x ON x.snapshot_id = p.snapshot_id JOIN c y ON y.snapshot_id = p.before AND y.path = x.path
      AND y.raw_hash IS NOT DISTINCT FROM x.raw_hash AND y.logical_key IS NOT DISTINCT FROM x.logical_key GROUP BY p.snapshot_id)
SELECT p.snapshot_id, p.before AS reuses FROM p LEFT JOIN e USING (snapshot_id) WHERE coalesce(same, 0) = files
""",
)
def reused_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """Snapshots with the same listing as the one before: it is kept once and referred to."""
    return ve.reusable(sc.current_files(table(spark, directory, "kb_files")), snapshot_order(table(spark, directory, "snapshots")))


@query(
    "frozen_version",
    """
WITH s AS (SELECT snapshot_id, min(source_id) AS source_id, min(created_at) AS created_at, bool_and(complete) AS complete FROM snapshots WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id),
m AS (SELECT to_timestamp(floor((epoch(min(created_at)) + epoch(max(created_at))) / 2)) AS cut FROM s),
k AS (SELECT s.*, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, snapshot_id DESC) AS n FROM s, m WHERE complete AND created_at <= cut)
SELECT k.source_id, k.snapshot_id, count(f.file_id) AS files FROM k LEFT JOIN (SELECT DISTINCT file_id, snapshot_id FROM kb_files) f USING (snapshot_id) WHERE n = 1 GROUP BY ALL
""",
)
def frozen_version(spark: SparkSession, directory: str) -> DataFrame:
    """A version frozen half way between the first and the last snapshot: each source's latest complete listing by then."""
    snapshots = table(spark, directory, "snapshots")
    span = snapshots.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).select(
        F.timestamp_seconds(F.floor((F.unix_micros("a") / 1e6 + F.unix_micros("b") / 1e6) / 2)).alias("at")
    )
    version = ve.frozen(snapshots, span.first()["at"])
    files = sc.in_scope(table(spark, directory, "kb_files"), version).groupBy("snapshot_id").agg(F.count_distinct("file_id").alias("files"))
    return version.join(files, "snapshot_id", "left").select("source_id", "snapshot_id", F.coalesce("files", F.lit(0)).alias("files"))


@query(
    "vector_changes",
    f"""
WITH {ORDER}, now AS (SELECT DISTINCT parsed_key FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last),
old AS (SELECT DISTINCT parsed_key FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last - 1)
SELECT chunk_id, CASE WHEN now.parsed_key IS NULL THEN 'delete' ELSE 'upsert' END AS action
FROM chunks LEFT JOIN now USING (parsed_key) LEFT JOIN old ON old.parsed_key = chunks.parsed_key WHERE (now.parsed_key IS NULL) <> (old.parsed_key IS NULL)
""",
)
def vector_changes(spark: SparkSession, directory: str) -> DataFrame:
    """What a vector store has to learn from the latest snapshots: chunks to add, and tombstones of those no file holds now."""
    files, snapshots = table(spark, directory, "kb_files"), table(spark, directory, "snapshots")
    now, old = (sc.files_of(files, sc.latest_snapshots(snapshots, back)) for back in (0, 1))
    return ve.vector_changes(old, now, table(spark, directory, "chunks"))


@query(
    "snapshot_ancestors",
    f"WITH {ORDER} SELECT x.snapshot_id AS a, y.snapshot_id AS b FROM o x JOIN o y ON x.source_id = y.source_id AND y.idx < x.idx",
)
def snapshot_ancestors(spark: SparkSession, directory: str) -> DataFrame:
    """All earlier snapshots of each snapshot, as the closure of the links from one to the one before."""
    order = snapshot_order(table(spark, directory, "snapshots"))
    before = order.select("source_id", (F.col("idx") + 1).alias("idx"), F.col("snapshot_id").alias("b"))
    return ve.closure(order.join(before, ["source_id", "idx"]).select(F.col("snapshot_id").alias("a"), "b"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


TAGS = ["b??t*", "*-?", "third*"]


@query(
    "tags_by_glob",
    "SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) AS tag FROM kb_files WHERE regexp_matches(regexp_extract(path, '^([^/]*)/', 1), '^(?:b..t.*|.*-.|third.*)$')",
)
def tags_by_glob(spark: SparkSession, directory: str) -> DataFrame:
    """Names (here of top folders) that meet a tag glob."""
    tags = table(spark, directory, "kb_files").select(F.regexp_extract("path", "^([^/]*)/", 1).alias("tag")).distinct()
    return tags.where(F.col("tag").rlike("|".join(map(tag_regex, TAGS))))
