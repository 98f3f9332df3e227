"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.common import cut_lineage, table
from docstrata.llm import near_duplicates as nd
from docstrata.llm.encoding import damaged_pieces, damaged_records, restored
from docstrata.llm.handwritten import not_handwritten_paths, not_handwritten_texts, train
from docstrata.llm.leakage import leaked_items
from docstrata.llm.packing import pack, token_counts
from docstrata.llm.personal import personal_data, without_personal_data
from docstrata.llm.syntax import syntax_errors, syntax_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    chunks = table(spark, directory, "chunks")
    return documents.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("id"), "text").union(
        chunks.select(F.concat(F.lit("chunks/"), F.col("chunk_id")), "text")
    )


@query
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    texts = _texts(spark, directory)
    records = damaged_records(texts, cut_lineage(damaged_pieces(texts))).select("id").distinct()
    return records.select(F.substring_index("id", "/", 1).alias("rel"), F.expr("substring(id, instr(id, '/') + 1)").alias("rec_key"))


@query
def p1_restored(spark: SparkSession, directory: str) -> DataFrame:
    texts = _texts(spark, directory)
    return restored(texts, cut_lineage(damaged_pieces(texts))).select(
        F.substring_index("id", "/", 1).alias("rel"), F.expr("substring(id, instr(id, '/') + 1)").alias("rec_key"), "text", "lost"
    )


@query
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repo"), "path", "text", F.col("file_lang").alias("lang")
    )
    files = table(spark, directory, "kb_files").select(F.col("file_id").alias("id"), F.col("source_id").alias("repo"), "path")
    models = train(files.select("repo", "path").union(documents.select("repo", "path")), documents)
    found = not_handwritten_paths(documents, models).union(not_handwritten_texts(documents, models))
    return (
        found.withColumn("rel", F.lit("documents"))
        .union(not_handwritten_paths(files, models).withColumn("rel", F.lit("kb_files")))
        .select("rel", F.col("id").alias("rec_key"))
        .distinct()
    )


@query
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return syntax_errors(table(spark, directory, "documents")).select("doc_id").distinct()


@query
def p3_rates(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return syntax_rates(documents, syntax_errors(documents))


CHUNK_LIKENESS = nd.Likeness("word", 3, 0.6, rows=4, name="chunks")
TITLE_LIKENESS = nd.Likeness("char", 3, 0.6, rows=7, name="documents")


@query
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """All pairs of a group, as the statement of the problem wants them; ``nd.near_duplicates`` gives one row a record."""
    chunks = table(spark, directory, "chunks").select(F.col("chunk_id").alias("id"), "text")
    titles = table(spark, directory, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("text"))
    found = nd.components(nd.links(chunks, CHUNK_LIKENESS).union(nd.links(titles, TITLE_LIKENESS)))
    members = (
        nd.nodes(chunks, CHUNK_LIKENESS)
        .withColumn("rel", F.lit("chunks"))
        .union(nd.nodes(titles, TITLE_LIKENESS).withColumn("rel", F.lit("documents")))
        .join(found, "node", "left")
        .select("rel", "id", F.coalesce("group", "node").alias("group"))
    )
    a, b = (members.select("rel", "group", F.col("id").alias(f"key_{x}")) for x in "ab")
    return a.join(b, ["rel", "group"]).where("key_a < key_b").select("rel", "key_a", "key_b")


#: The row of the table containers whose capacity p6 packs for.
CONTAINER = 4


@query
def p6_packed(spark: SparkSession, directory: str) -> DataFrame:
    capacity = table(spark, directory, "containers").where(F.col("container_id") == CONTAINER).first().capacity_tokens
    return pack(token_counts(table(spark, directory, "documents")), capacity)


@query
def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


@query
def p7_parts(spark: SparkSession, directory: str) -> DataFrame:
    """What of each item leaked: its question, its passage, or both."""
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


@query
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return personal_data(table(spark, directory, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


@query
def p8_masked(spark: SparkSession, directory: str) -> DataFrame:
    return without_personal_data(table(spark, directory, "documents")).select("doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
