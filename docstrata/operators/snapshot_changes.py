"""What changed between consecutive full listings of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import small_side


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, source_id, idx, last``: each snapshot's 0-based place in its source, and the source's last place.

    Rows delivered twice count once (the earliest ``created_at`` holds). Order is by ``created_at``, nulls first, ties by
    ``snapshot_id``. Snapshots with a null id are dropped: no file row can name them.
    """
    once = (
        snapshots.where("snapshot_id IS NOT NULL")
        .groupBy("snapshot_id")
        .agg(F.min("created_at").alias("created_at"), F.min("source_id").alias("source_id"))
    )
    by_source = Window.partitionBy("source_id")
    return once.select(
        "snapshot_id",
        "source_id",
        (F.row_number().over(by_source.orderBy("created_at", "snapshot_id")) - 1).alias("idx"),
        (F.count(F.lit(1)).over(by_source) - 1).cast("int").alias("last"),
    )


def snapshot_changes(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, path, change`` for each snapshot but the first of its source.

    ``files`` needs ``snapshot_id, path, raw_hash, loaded_at``; ``snapshots`` needs ``snapshot_id, source_id,
    created_at``; other columns are ignored. One pass over the file rows: they are reduced to one row per path and
    snapshot (the latest loaded wins; partial aggregation also absorbs rows delivered many times), then every path of a
    source is windowed by snapshot place. A lagged hash at the preceding place tells ``changed``; a gap before a row
    tells ``added``; a gap behind it tells ``removed`` at the first snapshot that lacks the path, so snapshots without
    any file row need no special treatment. Window groups hold one path of one source, at most a row per snapshot.

    Null hashes equal each other and differ from any hash. Null paths count as one path named null. File rows of
    unknown snapshots are ignored. Empty inputs give an empty result.
    """
    order = small_side(snapshot_order(snapshots))
    rows = (
        files.select("snapshot_id", "path", "raw_hash", "loaded_at")
        .join(order, "snapshot_id")
        .groupBy("source_id", "path", "idx", "last")
        .agg(F.max(F.struct("loaded_at", "raw_hash"))["raw_hash"].alias("raw_hash"))
    )
    along = Window.partitionBy("source_id", "path").orderBy("idx")
    near = rows.select(
        "source_id",
        "path",
        "idx",
        F.when(F.lag("idx").over(along).isNull() | (F.lag("idx").over(along) < F.col("idx") - 1), F.lit("added"))
        .when(~F.lag("raw_hash").over(along).eqNullSafe(F.col("raw_hash")), F.lit("changed"))
        .alias("here"),
        ((F.coalesce(F.lead("idx").over(along), F.col("last") + 1)) > F.col("idx") + 1).alias("gone_next"),
        "last",
    )
    changes = near.select(
        "source_id",
        "path",
        F.explode(
            F.array_compact(
                F.array(
                    F.when((F.col("idx") > 0) & F.col("here").isNotNull(), F.struct("idx", F.col("here").alias("change"))),
                    F.when(
                        F.col("gone_next") & (F.col("idx") < F.col("last")),
                        F.struct((F.col("idx") + 1).alias("idx"), F.lit("removed").alias("change")),
                    ),
                )
            )
        ).alias("c"),
    ).select("source_id", "path", "c.idx", "c.change")
    named = order.select("snapshot_id", F.col("source_id").alias("of_source"), F.col("idx").alias("at"))
    return changes.join(
        small_side(named), changes.source_id.eqNullSafe(F.col("of_source")) & (changes.idx == F.col("at"))
    ).select("snapshot_id", "path", "change")
