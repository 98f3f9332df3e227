"""Comparing, materialising and retaining versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import cut_lineage, small_side
from docstrata.operators.snapshot_changes import snapshot_order


def aligned(before: DataFrame, after: DataFrame, key: str = "logical_key", content: str = "raw_hash") -> DataFrame:
    """``key, before_id, after_id, status`` of two sets of files (``file_id``, key, content).

    Files with a key that either side holds more than once are ``ambiguous``, each in a row of its own; the others are
    ``added``, ``removed``, ``modified`` or ``unchanged``. Null contents are equal to each other only. Null keys align
    with each other as one key. Both sides are counted in one partial aggregation, so a hot key costs no more than another.
    """

    sides = [files.select(F.col(key).alias("_key"), "file_id", F.col(content).alias("_content"), F.lit(i).alias("_side")) for i, files in enumerate((before, after))]
    rows = cut_lineage(sides[0].union(sides[1]))
    of = lambda side, value: F.min(F.when(F.col("_side") == side, F.col(value)))
    keys = rows.groupBy("_key").agg(
        F.count_if(F.col("_side") == 0).alias("a"), F.count_if(F.col("_side") == 1).alias("b"),
        of(0, "file_id").alias("before_id"), of(1, "file_id").alias("after_id"), of(0, "_content").alias("old"), of(1, "_content").alias("new"),
    )
    clear = (F.col("a") <= 1) & (F.col("b") <= 1)
    status = F.when(F.col("a") == 0, "added").when(F.col("b") == 0, "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    plain = keys.where(clear).select(F.col("_key").alias(key), "before_id", "after_id", status.alias("status"))
    unclear = keys.where(~clear).select(F.col("_key").alias("_unclear"))
    ambiguous = rows.join(unclear, F.col("_key").eqNullSafe(F.col("_unclear")), "left_semi").select(
        F.col("_key").alias(key),
        F.when(F.col("_side") == 0, F.col("file_id")).alias("before_id"),
        F.when(F.col("_side") == 1, F.col("file_id")).alias("after_id"),
        F.lit("ambiguous").alias("status"),
    )
    return plain.unionByName(ambiguous)


def table_texts(chunks: DataFrame) -> DataFrame:
    """``parsed_key, table_no, text``: the chunks of each table of a document, joined in order. A table fits a row."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return (
        chunks.where("table_no IS NOT NULL")
        .groupBy("parsed_key", "table_no")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    )


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """``parsed_key, chunk_id, ordinal, text, first, last``: the lines that each chunk takes in its document's joined text.

    Chunks of one document are windowed in order; a document's chunks fit a task.
    """
    along = Window.partitionBy("parsed_key").orderBy("ordinal", "text")
    lines = F.size(F.split("text", "\n", -1))
    last = F.sum("lines").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return chunks.withColumn("lines", lines).withColumn("last", last).withColumn("first", F.col("last") - F.col("lines") + 1).drop("lines")


def joined_texts(chunks: DataFrame) -> DataFrame:
    """``parsed_key, text, chunks``: each document's chunks in order, one after the other. A document fits a row."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return chunks.groupBy("parsed_key").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("chunks")
    )


def cited_hunks(hunks: DataFrame, placed: DataFrame) -> DataFrame:
    """Hunks (``after_key`` and ``h`` as ``diff_pairs`` gives it) with the chunks of the new text they are cited by.

    A hunk that adds lines is cited by every chunk it touches, one that only deletes by the chunk of the line before it;
    where no chunk holds that line, by the document's first chunk.
    """
    rows = hunks.select("*", F.col("h.after_start").alias("after_start"), F.col("h.before_start").alias("before_start"), F.size("h.removed").alias("removed"), F.size("h.added").alias("added"))
    rows = rows.withColumn("from", F.when(F.col("added") > 0, F.col("after_start")).otherwise(F.greatest(F.lit(1), F.col("after_start") - 1)))
    rows = rows.withColumn("to", F.when(F.col("added") > 0, F.col("after_start") + F.col("added") - 1).otherwise(F.col("from")))
    places = placed.select(F.col("parsed_key").alias("after_key"), "chunk_id", "first", "last")
    start = placed.groupBy("parsed_key").agg(F.min_by("chunk_id", F.struct("ordinal", "text")).alias("start")).withColumnRenamed("parsed_key", "after_key")
    found = rows.alias("r").join(places.alias("p"), (F.col("r.after_key") == F.col("p.after_key")) & (F.col("first") <= F.col("to")) & (F.col("last") >= F.col("from")), "left")
    return found.select("r.*", "chunk_id").join(start, "after_key", "left").withColumn("chunk_id", F.coalesce("chunk_id", "start")).drop("start")


def reusable(files: DataFrame, order: DataFrame) -> DataFrame:
    """``snapshot_id, reuses``: snapshots whose files equal those of the one before in their source, path by path.

    Two independent sums of 64-bit hashes, aggregated partially, find the candidates; their files are then joined, so the
    sums never decide. Snapshots without files equal each other.
    """
    held = files.select("snapshot_id", "path", "raw_hash", "logical_key")
    hashed = [F.sum(F.xxhash64(F.lit(seed), "path", F.coalesce("raw_hash", F.lit("-")), F.coalesce("logical_key", F.lit("-"))).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    sums = order.select("snapshot_id", "source_id", "idx").join(held.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), *hashed), "snapshot_id", "left")
    along = Window.partitionBy("source_id").orderBy("idx")
    values = F.struct("n", "s1", "s2")
    pairs = sums.withColumn("reuses", F.when(F.lag(values).over(along).eqNullSafe(values), F.lag("snapshot_id").over(along))).where("reuses IS NOT NULL").select("snapshot_id", "reuses", "n")
    pairs = cut_lineage(pairs)
    old = held.select(F.col("snapshot_id").alias("reuses"), "path", F.col("raw_hash").alias("old_hash"), F.col("logical_key").alias("old_key"))
    same = (
        held.join(small_side(pairs.select("snapshot_id", "reuses")), "snapshot_id")
        .join(old, ["reuses", "path"])
        .where(F.col("raw_hash").eqNullSafe(F.col("old_hash")) & F.col("logical_key").eqNullSafe(F.col("old_key")))
        .groupBy("snapshot_id")
        .agg(F.count(F.lit(1)).alias("same"))
    )
    return pairs.join(same, "snapshot_id", "left").where("coalesce(same, 0) = coalesce(n, 0)").select("snapshot_id", "reuses")


def frozen(snapshots: DataFrame, at: object) -> DataFrame:
    """``source_id, snapshot_id``: of each source the latest complete snapshot created by ``at``; sources without one have none.

    A snapshot delivered twice is complete only if all its rows say so.
    """
    once = snapshots.where("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(
        F.min("source_id").alias("source_id"), F.min("created_at").alias("created_at"), F.min("complete").alias("complete")
    )
    kept = once.where(F.col("complete") & (F.col("created_at") <= F.lit(at)))
    return kept.groupBy("source_id").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))


def vector_changes(before: DataFrame, now: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, action``: chunks of contents that only ``now`` holds (``upsert``) or only ``before`` held (``delete``).

    Contents are compared, not files: a content that moved or is still held by another file needs nothing.
    """
    keys = [files.select("parsed_key").where("parsed_key IS NOT NULL").distinct().withColumn("has", F.lit(name)) for name, files in (("delete", before), ("upsert", now))]
    one = keys[0].union(keys[1]).groupBy("parsed_key").agg(F.count(F.lit(1)).alias("sides"), F.min("has").alias("action")).where("sides = 1")
    return chunks.select("chunk_id", "parsed_key").join(one, "parsed_key").select("chunk_id", "action")


def cited_chunks(hunks: DataFrame, chunks: DataFrame, key: str = "parsed_key") -> DataFrame:
    """The chunks whose lines overlap a hunk's (``key, start, end``): an equi-join on the document with a range condition."""
    h = hunks.select(key, F.col("start").alias("hunk_start"), F.col("end").alias("hunk_end"))
    return chunks.join(h, key).where("start_line <= hunk_end AND end_line >= hunk_start")


def projection_changes(current: DataFrame, new: DataFrame) -> DataFrame:
    """``source_id, path, action``: what brings a projection (``source_id, path, raw_hash``) to a new listing."""
    a = current.select("source_id", "path", F.col("raw_hash").alias("old"), F.lit(True).alias("had"))
    b = new.select("source_id", "path", F.col("raw_hash").alias("now"), F.lit(True).alias("has"))
    action = (
        F.when(F.col("had").isNull(), "insert")
        .when(F.col("has").isNull(), "delete")
        .when(F.col("old").eqNullSafe(F.col("now")), "unchanged")
        .otherwise("update")
    )
    return a.join(b, ["source_id", "path"], "full_outer").select("source_id", "path", action.alias("action"))


def signatures(files: DataFrame) -> DataFrame:
    """``snapshot_id, files, signature``: equal for equal listings whatever their order.

    The signature sums 32 bits of each file's hash, so it is aggregated partially and a large snapshot needs no sort and
    no list; use it to find candidates for reuse, equal up to one in some billions.
    """
    each = F.conv(F.substring(F.md5(F.concat_ws("\0", F.col("path"), F.coalesce("raw_hash", F.lit("-")), F.coalesce("logical_key", F.lit("")))), 1, 8), 16, 10)
    return files.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum(each.cast("long")).alias("signature"))


def closure(links: DataFrame) -> DataFrame:
    """``a, b`` for every ``b`` reachable from ``a`` over ``links``: pointer doubling, lineage cut each round."""
    reach = cut_lineage(links.select("a", "b").distinct())
    size = reach.count()
    while True:
        step = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        reach = cut_lineage(reach.union(step).distinct())
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def retained(snapshots: DataFrame, keep: int = 30, pinned: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """``snapshot_id`` of the snapshots to keep: the latest ``keep`` of each source, those pinned, and their aliases."""
    latest = snapshot_order(snapshots).where(F.col("last") - F.col("idx") < keep).select("snapshot_id")
    kept = latest if pinned is None else latest.union(pinned.select("snapshot_id"))
    if aliases is not None:
        kept = kept.union(closure(aliases).join(kept.withColumnRenamed("snapshot_id", "a"), "a", "left_semi").select("b"))
    return kept.distinct()


def pruned(files: DataFrame, kept: DataFrame) -> DataFrame:
    """The files of kept snapshots: a cascade of the deletion of all others."""
    return files.join(small_side(kept), "snapshot_id", "left_semi")


def orphans(parsed: DataFrame, files: DataFrame, key: str = "parsed_key") -> DataFrame:
    """Rows of ``parsed`` that no file refers to any more."""
    return parsed.join(files.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def carried_forward(now: DataFrame, before: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``now`` and, for sources whose snapshot there is incomplete, the files of ``before`` that it has not seen."""
    incomplete = snapshots.where("NOT complete").select("snapshot_id").distinct()
    sources = now.join(small_side(incomplete), "snapshot_id", "left_semi").select("source_id").distinct()
    unseen = before.join(small_side(sources), "source_id", "left_semi").join(now.select("source_id", "path"), ["source_id", "path"], "left_anti")
    return now.select("source_id", "path", "raw_hash").union(unseen.select("source_id", "path", "raw_hash"))


def evidence_states(evidence: DataFrame, by: list[str]) -> DataFrame:
    """``by, state`` from items ``support`` (present or absent) with ``quote`` and the cited ``text``.

    Items whose quote is shorter than five characters or isn't in the text count for nothing, and nothing found never
    means absent: the state is then ``unknown``.
    """
    from docstrata.functions.text import normalized

    quote, text = normalized(F.col("quote")), normalized(F.col("text"))
    valid = F.coalesce((F.length(quote) >= 5) & text.contains(quote), F.lit(False))
    yes = F.max(valid & (F.col("support") == "present"))
    no = F.max(valid & (F.col("support") == "absent"))
    state = F.when(yes & no, "conflict").when(yes, "supported").when(no, "absent").otherwise("unknown")
    return evidence.groupBy(*by).agg(state.alias("state"))


def ordinals(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
