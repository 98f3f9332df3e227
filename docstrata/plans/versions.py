"""Queries on snapshots and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.common import table
from docstrata.functions.text import content_id, joined
from docstrata.operators import scope as sc
from docstrata.operators import versions as ve
from docstrata.operators.snapshot_changes import snapshot_changes, snapshot_order
from docstrata.plans.register import query

#: Each snapshot once with its place in its source; current files: each file once, as loaded last.
ORDER = """
s AS (SELECT snapshot_id, min(source_id) AS source_id, min(created_at) AS created_at FROM snapshots
      WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at, snapshot_id) - 1 AS idx,
             count(*) OVER (PARTITION BY source_id) - 1 AS last FROM s),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC) AS nth FROM kb_files) WHERE nth = 1)
"""


@query(
    "p5_found",
    """
WITH s AS (SELECT snapshot_id, min(source_id) AS source_id, min(created_at) AS created_at FROM snapshots
           WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id),
     o AS (SELECT *, lag(snapshot_id) OVER (PARTITION BY source_id ORDER BY created_at, snapshot_id) AS before FROM s),
     f AS (SELECT snapshot_id, path, arg_max(coalesce(raw_hash, '-'), loaded_at) AS raw_hash FROM kb_files
           GROUP BY snapshot_id, path),
     now AS (SELECT o.snapshot_id, f.path, f.raw_hash FROM o JOIN f USING (snapshot_id) WHERE o.before IS NOT NULL),
     old AS (SELECT o.snapshot_id, f.path, f.raw_hash FROM o JOIN f ON f.snapshot_id = o.before)
SELECT coalesce(now.snapshot_id, old.snapshot_id) AS snapshot_id, coalesce(now.path, old.path) AS path,
       CASE WHEN old.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now FULL JOIN old ON now.snapshot_id = old.snapshot_id AND now.path = old.path
WHERE old.path IS NULL OR now.path IS NULL OR now.raw_hash <> old.raw_hash
""",
)
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return snapshot_changes(table(spark, directory, "kb_files"), table(spark, directory, "snapshots"))



def _now_and_before(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    files, snapshots = table(spark, directory, "kb_files"), table(spark, directory, "snapshots")
    return sc.files_of(files, sc.latest_snapshots(snapshots)), sc.files_of(files, sc.latest_snapshots(snapshots, 1))


@query(
    "content_ids",
    """
SELECT DISTINCT snapshot_id, path, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-a'||substr(h,18,3)||'-'||substr(h,21,12) AS id
FROM (SELECT snapshot_id, path, sha256(coalesce(snapshot_id,'')||chr(0)||coalesce(path,'')) AS h FROM kb_files)
""",
)
def content_ids(spark: SparkSession, directory: str) -> DataFrame:
    files = table(spark, directory, "kb_files").select("snapshot_id", "path").distinct()
    return files.withColumn("id", content_id(joined(F.col("snapshot_id"), F.col("path"))))


@query("latest_loaded_files", f"WITH {ORDER} SELECT file_id, path, raw_hash, epoch_us(loaded_at) AS loaded_us FROM c")
def latest_loaded_files(spark: SparkSession, directory: str) -> DataFrame:
    return sc.current_files(table(spark, directory, "kb_files")).select(
        "file_id", "path", "raw_hash", F.unix_micros("loaded_at").alias("loaded_us")
    )


@query(
    "scope_coverage",
    f"""
WITH {ORDER}, e AS (SELECT snapshot_id, max(coalesce(len(errors), 0)) AS failed FROM snapshots GROUP BY snapshot_id),
n AS (SELECT snapshot_id, count(*) AS documents FROM c GROUP BY snapshot_id)
SELECT source_id, CAST(sum(coalesce(documents, 0)) AS BIGINT) AS documents, CAST(sum(coalesce(failed, 0)) AS BIGINT) AS failed
FROM o LEFT JOIN e USING (snapshot_id) LEFT JOIN n USING (snapshot_id) WHERE idx = last GROUP BY source_id
""",
)
def scope_coverage(spark: SparkSession, directory: str) -> DataFrame:
    snapshots = table(spark, directory, "snapshots")
    return sc.coverage(table(spark, directory, "kb_files"), snapshots, sc.latest_snapshots(snapshots))


@query(
    "scope_filter",
    f"""
WITH {ORDER} SELECT c.file_id, c.path FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last
WHERE c.role = 'spec' AND c.board = 'NX-A' AND c.module_id = 'M_SPEC'
""",
)
def scope_filter(spark: SparkSession, directory: str) -> DataFrame:
    latest = sc.latest_snapshots(table(spark, directory, "snapshots"))
    return sc.files_of(table(spark, directory, "kb_files"), latest, module_id="M_SPEC", role="spec", board="NX-A").select("file_id", "path")


@query(
    "module_rule_first_match",
    r"""
WITH p AS (SELECT DISTINCT source_id, path FROM kb_files WHERE path IS NOT NULL),
r AS (SELECT *, '^(?:' || replace(replace(replace(regexp_replace(pattern, '([.+?()\[\]{}|^$])', '\\\1', 'g'), '**', '~~'), '*', '[^/]*'), '~~', '.*') || ')$' AS rx
      FROM module_rules)
SELECT source_id, path, module_id, role FROM (
  SELECT p.source_id, p.path, r.module_id, r.role, row_number() OVER (PARTITION BY p.source_id, p.path ORDER BY module_ord, rule_ord) AS n
  FROM p LEFT JOIN r ON (r.source_id IS NULL OR r.source_id = p.source_id) AND regexp_matches(p.path, r.rx, 'is')) WHERE n = 1
""",
)
def module_rule_first_match(spark: SparkSession, directory: str) -> DataFrame:
    rules = table(spark, directory, "module_rules")
    paths = table(spark, directory, "kb_files").where("path IS NOT NULL").select("source_id", "path").distinct()
    found = paths.withColumn("rule", sc.first_rule(rules, F.col("path"), F.col("source_id")))
    return found.select("source_id", "path", "rule.module_id", "rule.role")


@query(
    "logical_key_inheritance",
    f"""
WITH {ORDER}, now AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last),
old AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last - 1),
h AS (SELECT source_id, raw_hash, min(logical_key) AS k FROM old WHERE raw_hash IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
SELECT now.source_id, now.path, coalesce(old.logical_key, h.k, now.source_id || ':' || now.path) AS inherited_key
FROM now LEFT JOIN old ON now.source_id = old.source_id AND now.path = old.path
LEFT JOIN h ON now.source_id = h.source_id AND now.raw_hash = h.raw_hash
""",
)
def logical_key_inheritance(spark: SparkSession, directory: str) -> DataFrame:
    now, before = _now_and_before(spark, directory)
    return sc.inherited_keys(now, before).select("source_id", "path", "inherited_key")


@query(
    "snapshot_signatures",
    f"""
WITH {ORDER} SELECT snapshot_id, count(*) AS files,
  CAST(sum(CAST('0x' || substr(md5(path || chr(0) || coalesce(raw_hash, '-') || chr(0) || coalesce(logical_key, '')), 1, 8) AS BIGINT)) AS BIGINT) AS signature
FROM c GROUP BY snapshot_id
""",
)
def snapshot_signatures(spark: SparkSession, directory: str) -> DataFrame:
    return ve.signatures(sc.current_files(table(spark, directory, "kb_files")))


@query(
    "current_projection",
    f"""
WITH {ORDER}, now AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last),
old AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last - 1)
SELECT coalesce(now.source_id, old.source_id) AS source_id, coalesce(now.path, old.path) AS path,
  CASE WHEN old.path IS NULL THEN 'insert' WHEN now.path IS NULL THEN 'delete'
       WHEN now.raw_hash IS NOT DISTINCT FROM old.raw_hash THEN 'unchanged' ELSE 'update' END AS action
FROM now FULL JOIN old ON now.source_id = old.source_id AND now.path = old.path
""",
)
def current_projection(spark: SparkSession, directory: str) -> DataFrame:
    now, before = _now_and_before(spark, directory)
    return ve.projection_changes(before, now)


@query(
    "removed_files",
    f"""
WITH {ORDER}, now AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last),
old AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last - 1)
SELECT source_id, path FROM old WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.source_id = old.source_id AND now.path = old.path)
""",
)
def removed_files(spark: SparkSession, directory: str) -> DataFrame:
    now, before = _now_and_before(spark, directory)
    return before.select("source_id", "path").join(now.select("source_id", "path"), ["source_id", "path"], "left_anti")


@query(
    "carried_forward_files",
    f"""
WITH {ORDER}, now AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last),
old AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last - 1),
i AS (SELECT DISTINCT now.source_id FROM now JOIN snapshots USING (snapshot_id) WHERE NOT complete)
SELECT source_id, path, raw_hash FROM now UNION ALL
SELECT source_id, path, raw_hash FROM old WHERE source_id IN (SELECT source_id FROM i)
  AND NOT EXISTS (SELECT 1 FROM now WHERE now.source_id = old.source_id AND now.path = old.path)
""",
)
def carried_forward_files(spark: SparkSession, directory: str) -> DataFrame:
    now, before = _now_and_before(spark, directory)
    return ve.carried_forward(now, before, table(spark, directory, "snapshots"))


RETAINED = 5


@query("retained_snapshots", f"WITH {ORDER} SELECT snapshot_id FROM o WHERE last - idx < {RETAINED}")
def retained_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    return ve.retained(table(spark, directory, "snapshots"), RETAINED)


@query(
    "orphans_after_retention",
    f"""
WITH {ORDER}, k AS (SELECT parsed_key FROM c JOIN o ON c.snapshot_id = o.snapshot_id WHERE last - idx < {RETAINED})
SELECT DISTINCT parsed_key FROM chunks WHERE parsed_key NOT IN (SELECT parsed_key FROM k WHERE parsed_key IS NOT NULL)
""",
)
def orphans_after_retention(spark: SparkSession, directory: str) -> DataFrame:
    kept = ve.retained(table(spark, directory, "snapshots"), RETAINED)
    files = ve.pruned(table(spark, directory, "kb_files"), kept)
    return ve.orphans(table(spark, directory, "chunks").select("parsed_key").distinct(), files)


STATUS = f"""
WITH {ORDER}, a AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = 0),
b AS (SELECT c.* FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last),
x AS (SELECT logical_key, count(*) AS n, min(file_id) AS id, min(raw_hash) AS h FROM a GROUP BY logical_key),
y AS (SELECT logical_key, count(*) AS n, min(file_id) AS id, min(raw_hash) AS h FROM b GROUP BY logical_key),
z AS (SELECT coalesce(x.logical_key, y.logical_key) AS logical_key, x.id AS before_id, y.id AS after_id, x.n AS xn, y.n AS yn, x.h AS xh, y.h AS yh
      FROM x FULL JOIN y ON x.logical_key IS NOT DISTINCT FROM y.logical_key),
r AS (SELECT logical_key, before_id, after_id, CASE WHEN xn IS NULL THEN 'added' WHEN yn IS NULL THEN 'removed'
             WHEN xh IS NOT DISTINCT FROM yh THEN 'unchanged' ELSE 'modified' END AS status
      FROM z WHERE coalesce(xn, 0) <= 1 AND coalesce(yn, 0) <= 1
      UNION ALL SELECT a.logical_key, a.file_id, NULL, 'ambiguous' FROM a JOIN z ON a.logical_key IS NOT DISTINCT FROM z.logical_key AND (coalesce(xn, 0) > 1 OR coalesce(yn, 0) > 1)
      UNION ALL SELECT b.logical_key, NULL, b.file_id, 'ambiguous' FROM b JOIN z ON b.logical_key IS NOT DISTINCT FROM z.logical_key AND (coalesce(xn, 0) > 1 OR coalesce(yn, 0) > 1))
"""


@query("compare_status", STATUS + "SELECT logical_key, before_id, after_id, status FROM r")
def compare_status(spark: SparkSession, directory: str) -> DataFrame:
    files, snapshots = table(spark, directory, "kb_files"), table(spark, directory, "snapshots")
    return ve.aligned(sc.files_of(files, sc.first_snapshots(snapshots)), sc.files_of(files, sc.latest_snapshots(snapshots)))


@query("compare_status_counts", STATUS + "SELECT status, count(*) AS files FROM r GROUP BY status")
def compare_status_counts(spark: SparkSession, directory: str) -> DataFrame:
    return compare_status(spark, directory).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query(
    "moved_commits",
    f"""
WITH {ORDER}, h AS (SELECT snapshot_id, min(commit_hash) AS commit_hash FROM snapshots GROUP BY snapshot_id),
l AS (SELECT source_id, snapshot_id, idx, commit_hash, lag(commit_hash) OVER (PARTITION BY source_id ORDER BY idx) AS known FROM o JOIN h USING (snapshot_id))
SELECT source_id, snapshot_id, commit_hash, known FROM l WHERE commit_hash IS NOT NULL AND idx > 0 AND commit_hash IS DISTINCT FROM known
""",
)
def moved_commits(spark: SparkSession, directory: str) -> DataFrame:
    from pyspark.sql import Window

    snapshots = table(spark, directory, "snapshots")
    commits = snapshots.groupBy("snapshot_id").agg(F.min("commit_hash").alias("commit_hash"))
    known = F.lag("commit_hash").over(Window.partitionBy("source_id").orderBy("idx"))
    return (
        snapshot_order(snapshots)
        .join(commits, "snapshot_id")
        .withColumn("known", known)
        .where("commit_hash IS NOT NULL AND idx > 0 AND NOT commit_hash <=> known")
        .select("source_id", "snapshot_id", "commit_hash", "known")
    )


@query(
    "latest_100_snapshots",
    "SELECT DISTINCT snapshot_id, source_id, epoch_us(created_at) AS created_us FROM snapshots ORDER BY created_us DESC, snapshot_id LIMIT 100",
)
def latest_100_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    snapshots = table(spark, directory, "snapshots")
    rows = snapshots.select("snapshot_id", "source_id", F.unix_micros("created_at").alias("created_us")).distinct()
    return rows.orderBy(F.desc("created_us"), "snapshot_id").limit(100)


@query(
    "preview_200",
    f"""
WITH {ORDER}, f AS (SELECT c.path, c.file_id FROM c JOIN o ON c.snapshot_id = o.snapshot_id AND idx = last WHERE o.source_id = 'src1')
SELECT path, file_id, (SELECT count(*) FROM f) AS total, (SELECT count(*) > 200 FROM f) AS truncated FROM f ORDER BY path, file_id LIMIT 200
""",
)
def preview_200(spark: SparkSession, directory: str) -> DataFrame:
    snapshots = table(spark, directory, "snapshots")
    latest = sc.latest_snapshots(snapshots).where("source_id = 'src1'")
    files = sc.files_of(table(spark, directory, "kb_files"), latest)
    total = files.agg(F.count(F.lit(1)).alias("n")).first().n
    first = files.select("path", "file_id").orderBy("path", "file_id").limit(200)
    return first.withColumn("total", F.lit(total).cast("long")).withColumn("truncated", F.lit(total > 200))


@query(
    "membership_sets",
    f"""
WITH {ORDER} SELECT chunk_id, string_agg(DISTINCT snapshot_id, ',' ORDER BY snapshot_id) AS snapshots, string_agg(DISTINCT role, ',' ORDER BY role) AS roles
FROM chunks JOIN c USING (parsed_key) GROUP BY chunk_id
""",
)
def membership_sets(spark: SparkSession, directory: str) -> DataFrame:
    files = table(spark, directory, "kb_files").select("parsed_key", "snapshot_id", "role").distinct()
    per_key = files.groupBy("parsed_key").agg(
        F.array_join(F.sort_array(F.collect_set("snapshot_id")), ",").alias("snapshots"),
        F.nullif(F.array_join(F.sort_array(F.collect_set("role")), ","), F.lit("")).alias("roles"),
    )
    return table(spark, directory, "chunks").select("chunk_id", "parsed_key").join(per_key, "parsed_key").drop("parsed_key")


@query("orphan_chunks", "SELECT chunk_id FROM chunks WHERE parsed_key NOT IN (SELECT parsed_key FROM kb_files WHERE parsed_key IS NOT NULL)")
def orphan_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return ve.orphans(table(spark, directory, "chunks"), table(spark, directory, "kb_files")).select("chunk_id")
