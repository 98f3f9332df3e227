"""Files of a folder, and of uploads, as tables of bytes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.decode import PROFILE
from docstrata.functions.text import basename, is_supported, joined

#: Files beyond this size are reported, not read.
LARGEST = 20 << 20
_RESERVED = re.compile(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)(\..*)?$")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, length, modified, error_code``: the supported files below ``root``, by path relative to it.

    Directories that hold no sources (builds, vendored code, repositories) and office lock files are left out; files
    over LARGEST come without content, as TOO_LARGE. Links are not followed beyond what the file system lists.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.when(at.startswith(root.rstrip("/") + "/"), F.substring(at, F.lit(len(root.rstrip("/")) + 2), F.length(at))).otherwise(at)
    large = F.col("length") > LARGEST
    return (
        files.withColumn("path", relative)
        .where(is_supported(F.col("path")))
        .select(
            "path",
            F.when(~large, F.col("content")).alias("content"),
            "length",
            F.col("modificationTime").alias("modified"),
            F.when(large, F.lit("TOO_LARGE")).alias("error_code"),
        )
    )


def check_upload_names(names: list[str]) -> list[str]:
    """Names under which uploaded files are kept: numbered, so that equal names stay apart. At most 100, no paths."""
    if len(names) > 100:
        raise ValueError("at most 100 files")
    for name in names:
        if not name or re.search(r"[/\\\0:]", name) or name in (".", "..") or _RESERVED.match(name):
            raise ValueError(f"not a file name: {name!r}")
    return [f"{i:03d}-{name}" for i, name in enumerate(names)]


def hashed(files: DataFrame) -> DataFrame:
    """``files`` with ``raw_hash`` of the content and the ``parsed_key`` of content, parser and file name."""
    with_hash = files.withColumn("raw_hash", F.sha2(F.col("content"), 256))
    return with_hash.withColumn("parsed_key", F.sha2(joined(F.col("raw_hash"), F.lit(PROFILE), basename(F.col("path"))), 256))


def unparsed(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """The distinct contents of ``files`` that ``parsed`` doesn't hold yet: only these need a parser."""
    return files.dropDuplicates(["parsed_key"]).join(parsed.select("parsed_key"), "parsed_key", "left_anti")
