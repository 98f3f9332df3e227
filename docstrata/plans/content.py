"""Queries on the content of documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.common import table
from docstrata.functions import text as tx
from docstrata.functions.chunking import chunked
from docstrata.functions.diff import diff_pairs, patched
from docstrata.operators import versions as ve
from docstrata.plans.register import query

WORDS = rf"regexp_extract_all(translate(lower(coalesce({{0}}, '')), '{tx.FOLD_FROM}', '{tx.FOLD_TO}'), '[\p{{{{L}}}}\p{{{{N}}}}_]+')"
WHITE = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(column: str) -> str:
    """The SQL of ``text.tokens``."""
    return WORDS.format(column).replace("{{", "{").replace("}}", "}")


@query("token_count", f"SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS tokens FROM documents")
def token_count(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens"))


@query(
    "lexical_query_terms",
    r"""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS l FROM eval_items),
d AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM w)
SELECT item_id, array_to_string(list_filter(l[1:24], lambda x: length(x) > 1 OR regexp_matches(x, '^[A-Za-z0-9]$')), ' ') AS terms FROM d
""",
)
def lexical_query_terms(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "eval_items").select("item_id", F.array_join(tx.query_words(F.col("text")), " ").alias("terms"))


@query(
    "number_tokens",
    f"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '{tx.NUMBER}') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS numbers FROM n
""",
)
def number_tokens(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").where("text IS NOT NULL")
    return documents.select("doc_id", F.array_join(tx.numbers(F.col("text")), "|").alias("numbers"))


@query(
    "unix_lines",
    r"SELECT doc_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS digest FROM documents WHERE contains(text, chr(13))",
)
def unix_lines(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").where(F.col("text").contains("\r"))
    return documents.select("doc_id", F.md5(tx.unix_lines(F.col("text"))).alias("digest"))


@query(
    "line_lengths",
    "SELECT doc_id, CAST(count(*) AS BIGINT) AS line_count, CAST(max(length(line)) AS BIGINT) AS longest FROM "
    "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id",
)
def line_lengths(spark: SparkSession, directory: str) -> DataFrame:
    lines = F.split(F.col("text"), "\n", -1)
    documents = table(spark, directory, "documents").where("text IS NOT NULL")
    return documents.select(
        "doc_id",
        F.size(lines).cast("long").alias("line_count"),
        F.array_max(F.transform(lines, lambda x: F.length(x))).cast("long").alias("longest"),
    )


@query(
    "markdown_titles",
    r"""
SELECT doc_id, coalesce(CASE WHEN regexp_matches(path, '\.(md|markdown)$', 'i') THEN
  nullif(trim(regexp_extract(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^#[ \t]+(.+)$', 1), ' '), '') END, string_split(path, '/')[-1]) AS title
FROM documents
""",
)
def markdown_titles(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", tx.markdown_title(F.col("text"), F.col("path")).alias("title"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _either(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


#: The SQL of ``text.is_build_document``, as the column ``build`` of the relation ``b``.
BUILD = rf"""
b0 AS (SELECT doc_id, role, lower(path) AS p, lower(string_split(replace(path, '', '/'), '/')[-1]) AS name, lower(coalesce(text, '')) AS t FROM documents),
b1 AS (SELECT *, string_split_regex(p, '[/\_.-]') AS parts, regexp_extract_all(t, '[a-z0-9_]+') AS words, regexp_replace(t, '\s+', ' ', 'g') AS spaced,
  regexp_replace(t, '배포\s+', '배포', 'g') AS close, regexp_extract_all(t, '{tx.SETTING.replace("'", "''")}', 1) AS sn, regexp_extract_all(t, '{tx.SETTING.replace("'", "''")}', 2) AS sv,
  regexp_extract_all(t, '{tx.CALL}', 1) AS cn, regexp_extract_all(t, '{tx.CALL}', 2) AS ca, regexp_extract_all(t, '{tx.CALL}', 3) AS cb FROM b0),
b AS (SELECT doc_id, role, coalesce(CASE
  WHEN name IN {tuple(tx.BUILD_NAMES)} OR {_either([f"starts_with(name, '{x}')" for x in tx.BUILD_BEGINNINGS] + [f"ends_with(name, '{x}')" for x in tx.BUILD_ENDINGS])} THEN true
  WHEN regexp_extract(name, '(\.[^.]+)$', 1) IN {tuple(tx.IMPLEMENTATION)} THEN false
  ELSE list_has_any(parts, {_list(tx.BUILD_PATH_WORDS)})
    OR len(list_filter(range(1, len(sn) + 1), lambda i: (starts_with(sn[i], '{tx.SETTING_BEGINNING}') OR {_either([f"ends_with(sn[i], '{x}')" for x in tx.SETTING_ENDINGS])}) AND list_contains({_list(tx.SETTING_VALUES)}, sv[i]))) > 0
    OR len(list_filter(range(1, len(cn) + 1), lambda i: list_contains({_list(tx.TARGET_CALLS)}, cn[i]) OR (list_contains({_list(tx.SWITCHES)}, cn[i]) AND ca[i] <> '' AND list_contains({_list(tx.SWITCH_VALUES)}, cb[i])))) > 0
    OR ((list_has_any(words, {_list(tx.BUILD_WORDS)}) OR {_either([f"contains(spaced, '{x}')" for x in tx.BUILD_PHRASES] + [f"contains(close, '{x}')" for x in tx.BUILD_KOREAN])})
      AND (list_has_any(words, {_list(tx.DISPOSITION_WORDS)}) OR {_either([f"contains(t, '{x}')" for x in tx.DISPOSITION_KOREAN])}))
  END, false) AS build FROM b1)
"""


@query("build_documents", f"WITH {BUILD} SELECT doc_id FROM b WHERE build")
def build_documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").where(tx.is_build_document(F.col("path"), F.col("text"))).select("doc_id")


@query(
    "feature_candidates",
    f"WITH {BUILD} SELECT DISTINCT doc_id, CASE WHEN build THEN 'build' ELSE 'code' END AS kind FROM b "
    "WHERE (role = 'code' AND NOT build) OR (role IN ('code', 'reference') AND build)",
)
def feature_candidates(spark: SparkSession, directory: str) -> DataFrame:
    build = tx.is_build_document(F.col("path"), F.col("text"))
    documents = table(spark, directory, "documents").withColumn("kind", F.when(build, "build").otherwise("code"))
    kept = documents.where("(kind = 'code' AND role = 'code') OR (kind = 'build' AND role IN ('code', 'reference'))")
    return kept.select("doc_id", "kind").distinct()


IDENTIFIERS = ["uint32_t", "struct", "opts"]


@query(
    "identifier_filter",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])(?:uint32_t|struct|opts)(?:$|[^A-Za-z0-9_])')",
)
def identifier_filter(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").where(tx.holds_identifier(F.col("text"), IDENTIFIERS)).select("doc_id")


@query(
    "evidence_states",
    rf"""
WITH e AS (SELECT parsed_key, text, CASE WHEN ordinal % 3 = 2 THEN text || 'x' ELSE substr(text, 5, 4 + ordinal * 7) END AS quote,
                  CASE WHEN ordinal % 2 = 0 THEN 'present' ELSE 'absent' END AS support FROM chunks),
n AS (SELECT *, trim(regexp_replace(quote, '{WHITE}', ' ', 'g'), ' ') AS q, trim(regexp_replace(text, '{WHITE}', ' ', 'g'), ' ') AS t FROM e),
v AS (SELECT *, coalesce(length(q) >= 5 AND contains(t, q), false) AS ok FROM n)
SELECT parsed_key, CASE WHEN bool_or(ok AND support = 'present') AND bool_or(ok AND support = 'absent') THEN 'conflict'
  WHEN bool_or(ok AND support = 'present') THEN 'supported' WHEN bool_or(ok AND support = 'absent') THEN 'absent' ELSE 'unknown' END AS state
FROM v GROUP BY parsed_key
""",
)
def evidence_states(spark: SparkSession, directory: str) -> DataFrame:
    """Evidence derived from the chunks themselves: some quotes are in their text, some are not, some are too short."""
    chunks = table(spark, directory, "chunks")
    quote = F.when(F.col("ordinal") % 3 == 2, F.concat("text", F.lit("x"))).otherwise(
        F.substring(F.col("text"), F.lit(5), F.lit(4) + F.col("ordinal") * 7)
    )
    evidence = chunks.select(
        "parsed_key", "text", quote.alias("quote"), F.when(F.col("ordinal") % 2 == 0, "present").otherwise("absent").alias("support")
    )
    return ve.evidence_states(evidence, ["parsed_key"])


@query(
    "table_texts",
    "SELECT parsed_key, CAST(table_no AS INTEGER) AS table_no, string_agg(text, chr(10) ORDER BY ordinal, text) AS text FROM chunks "
    "WHERE table_no IS NOT NULL GROUP BY parsed_key, table_no",
)
def table_texts(spark: SparkSession, directory: str) -> DataFrame:
    return ve.table_texts(table(spark, directory, "chunks"))


@query(
    "cited_chunks",
    "SELECT c.chunk_id, h.start_line AS hunk_start FROM chunks c JOIN chunks h ON c.parsed_key = h.parsed_key "
    "AND c.start_line <= h.start_line + 3 AND c.end_line >= h.start_line WHERE h.start_line IS NOT NULL",
)
def cited_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Hunks of four lines from the start of every chunk, and the chunks they touch."""
    chunks = table(spark, directory, "chunks")
    hunks = chunks.where("start_line IS NOT NULL").select(
        "parsed_key", F.col("start_line").alias("start"), (F.col("start_line") + 3).alias("end")
    )
    return ve.cited_chunks(hunks, chunks).select("chunk_id", "hunk_start")


@query(
    "embedding_inputs",
    "SELECT chunk_id, md5('title: ' || coalesce(title, '') || ' | text: ' || text) AS input, "
    "CAST(greatest(1, ceil(length('title: ' || coalesce(title, '') || ' | text: ' || text) / 3.0)) AS BIGINT) AS tokens FROM chunks",
)
def embedding_inputs(spark: SparkSession, directory: str) -> DataFrame:
    made = tx.embedding_input(F.col("title"), F.col("text"))
    return table(spark, directory, "chunks").select("chunk_id", F.md5(made).alias("input"), tx.token_estimate(made).alias("tokens"))


@query(
    "location_labels",
    "SELECT chunk_id, concat_ws(' · ', CASE WHEN page IS NOT NULL THEN 'Page ' || CAST(page AS INTEGER) END, CASE WHEN start_line IS NOT NULL THEN "
    "CASE WHEN start_line = end_line THEN 'Line ' || CAST(start_line AS INTEGER) ELSE 'Lines ' || CAST(start_line AS INTEGER) || '–' || CAST(end_line AS INTEGER) END END) AS label FROM chunks",
)
def location_labels(spark: SparkSession, directory: str) -> DataFrame:
    chunks = table(spark, directory, "chunks")
    return chunks.select("chunk_id", tx.location_label(F.col("page"), F.col("start_line"), F.col("end_line")).alias("label"))


LINE_CHUNKS = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, CASE WHEN length(regexp_replace(substr(text, 1, 16384), '[^\x{3000}-\x{9fff}\x{ac00}-\x{d7af}]', '', 'g'))
    / greatest(length(substr(text, 1, 16384)), 1) >= 0.15 THEN 600 ELSE 1400 END AS target FROM documents WHERE text <> ''),
l AS (SELECT doc_id, target, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n,
      len(string_split(text, chr(10))) AS lines FROM d),
m AS (SELECT doc_id, target, n, CASE WHEN n < lines THEN line || chr(10) ELSE line END AS line FROM l WHERE n < lines OR line <> ''),
u AS (SELECT doc_id, target, n, k, substr(line, k * target + 1, target) AS piece, k = 0 AS b, (k + 1) * target >= length(line) AS e
      FROM (SELECT *, unnest(range((length(line) + target - 1) // target)) AS k FROM m)),
g AS (SELECT doc_id, any_value(target) AS target, any_value(CASE target WHEN 600 THEN 700 ELSE 1800 END) AS most, list(n ORDER BY n, k) AS ln,
        list(length(piece) ORDER BY n, k) AS le, list(b ORDER BY n, k) AS b, list(e ORDER BY n, k) AS e,
        list(regexp_matches(piece, '[^\x1c-\x1f@WHITE@]') ORDER BY n, k) AS inked, count(*) AS c FROM u GROUP BY doc_id),
h AS (SELECT *, list_transform(range(c + 1), lambda i: coalesce(list_sum(le[1:i]), 0)) AS cum FROM g),
s AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS a FROM h
  UNION ALL
  SELECT doc_id, CASE WHEN back > a AND b[back] AND e[z] AND z < c AND cum[z + 1] - cum[back] < target
      AND cum[z + 1] - cum[back] + le[z + 1] <= most THEN back ELSE z + 1 END
  FROM (SELECT *, list_filter(range(a, z + 1), lambda j: ln[j] >= ln[z] - 1)[1] AS back FROM (
    SELECT h.*, s.a, coalesce(list_filter(range(s.a + 1, h.c + 1), lambda x: cum[x + 1] - cum[s.a] > most OR cum[x] - cum[s.a] >= target)[1] - 1, h.c) AS z
    FROM s JOIN h USING (doc_id) WHERE s.a <= h.c))
),
r AS (SELECT h.*, s.a, coalesce(list_filter(range(s.a + 1, h.c + 1), lambda x: cum[x + 1] - cum[s.a] > most OR cum[x] - cum[s.a] >= target)[1] - 1, h.c) AS z
      FROM s JOIN h USING (doc_id) WHERE s.a <= h.c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS ordinal, CAST(ln[a] AS INTEGER) AS start_line,
  CAST(ln[z] AS INTEGER) AS end_line, CAST(cum[z + 1] - cum[a] AS INTEGER) AS length
FROM r WHERE list_bool_or(inked[a:z])
""".replace("@WHITE@", WHITE[1:-2])


@query("line_chunks", LINE_CHUNKS)
def line_chunks(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").withColumn("file_lang", F.lit(None).cast("string"))
    return chunked(documents).select("doc_id", "ordinal", "start_line", "end_line", F.length("text").alias("length"))


@query("chunk_text")
def chunk_text(spark: SparkSession, directory: str) -> DataFrame:
    found = chunked(table(spark, directory, "documents"))
    return found.select("doc_id", "ordinal", "start_line", "end_line", "symbol", F.length("text").alias("length"))


AFTER_SQL = "replace(replace(text, ' the ', ' THE '), 'return', chr(10) || 'return') || chr(10) || 'LIMIT = ' || doc_id || ' mA'"


def _edited(documents: DataFrame) -> DataFrame:
    after = F.concat(
        F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" THE ")), F.lit("return"), F.lit("\nreturn")), F.lit("\nLIMIT = "), F.col("doc_id"), F.lit(" mA")
    )
    return documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("before"), after.alias("after"))


@query("diff_roundtrip", f"SELECT doc_id, sha256({AFTER_SQL}) AS digest FROM documents WHERE text IS NOT NULL")
def diff_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Every text against an edited copy of it; the hunks, applied to the text, must give the copy."""
    pairs = _edited(table(spark, directory, "documents"))
    # The text rides along in the id, so that hunks meet their text without a join.
    found = diff_pairs(pairs.select(F.struct("id", "before").alias("id"), "before", "after"))
    done = patched(found.select("id.id", "id.before", "hunks"))
    return done.select(F.col("id").alias("doc_id"), F.sha2("after", 256).alias("digest"))


@query("diff_hunks")
def diff_hunks(spark: SparkSession, directory: str) -> DataFrame:
    found = diff_pairs(_edited(table(spark, directory, "documents"))).select("id", F.explode("hunks").alias("h"), "method")
    return found.select(
        F.col("id").alias("doc_id"),
        "h.before_start",
        "h.after_start",
        F.size("h.removed").alias("removed"),
        F.size("h.added").alias("added"),
        F.array_join("h.numbers_after", "|").alias("numbers_after"),
        "method",
    )
