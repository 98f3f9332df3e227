"""Table access and the few helpers every operator shares."""

from __future__ import annotations

import functools
import re
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after a count shows at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


@functools.cache
def _package_archive() -> str:
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(), "docstrata.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    return str(archive)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors of ``spark`` (once), so that their Python workers can import it."""
    context = spark.sparkContext
    if not any(f.endswith("/docstrata.zip") for f in context.listFiles):
        context.addPyFile(_package_archive())


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows and bytes permit it, else unmarked: Spark then shuffles (with AQE's
    skew join). Arrays and structs count by their JSON text."""
    width = [F.lit(8) if t in ("bigint", "int", "double", "timestamp", "boolean", "smallint", "date") else _width(c, t) for c, t in df.dtypes]
    held = df.limit(rows + 1).select(sum(width, F.lit(0)).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    return F.broadcast(df) if held.n <= rows and (held.w or 0) <= BROADCAST_BYTES else df


def _width(column: str, kind: str) -> Column:
    text = F.col(f"`{column}`") if kind in ("string", "binary") else F.to_json(F.array(F.col(f"`{column}`")))
    return F.coalesce(F.octet_length(text), F.lit(0)) + 8


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the reliable checkpoint folder and continues from there.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where none is set on one machine (tests, a
    laptop) a folder below the warehouse directory is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``; where it is unset, an error unless Spark runs on one
    machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def written_once(df: DataFrame, name: str, write: Callable[[str], None]) -> str:
    """The path below the shared folder where ``write`` has put what is derived from the files that ``df`` reads.

    The path is named by the number, sizes and times of those files, so a changed table is derived anew, and each later
    question of any session finds what is there. A write that was not finished has no ``_DONE`` table and is done again.
    """
    spark = df.sparkSession
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum("file_size"), F.max("file_modification_time"), F.sum(F.xxhash64("file_path").cast("decimal(38,0)"))).first()
    path = f"{shared_folder(spark).rstrip('/')}/derived/{name}-{zlib.crc32(repr((state, df.columns)).encode()):08x}"
    try:
        spark.read.parquet(f"{path}/_DONE.parquet")
    except AnalysisException:
        write(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/_DONE.parquet")
    return path


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
