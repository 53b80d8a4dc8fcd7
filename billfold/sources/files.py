"""Reading folders of billing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions.text import is_blank

# Largest file read into one row; Spark's own limit for binary values is 2 GB.
MAX_FILE_BYTES = 2**31 - 1024
SPLIT_LINES = 1 << 14  # of a part of a file that is read in parts
FAILURE_COLUMNS = ("file", "error")


def extension_glob() -> str:
    """Every supported extension, all lower or all upper case."""
    names = [e.lstrip(".") for e in K.SUPPORTED_EXTENSIONS]
    return "*.{" + ",".join([*names, *(n.upper() for n in names)]) + "}"


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content.cast("binary"), 256)


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; all line ends become '\\n'."""
    as_text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(decoded, "\r\n?", "\n")


def file_columns(path: Column) -> list[Column]:
    """doc_id, file_name, file_path, file_stem and ext of a path."""
    name = F.substring_index(path, "/", -1)
    return [
        path.alias("doc_id"),
        name.alias("file_name"),
        path.alias("file_path"),
        F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "").alias("file_stem"),
        F.lower(F.regexp_extract(name, r".(\.[^.]+)\z", 1)).alias("ext"),
    ]


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """The supported files of one folder, not of its sub-folders, with their bytes.

    Out: doc_id, file_name, file_path, file_stem, ext, length, content. Files too large
    for one value come without content, the length filter being pushed to the listing;
    such a file is a failure with a reason of its own and is never stored.
    """
    return file_rows(spark.read.format("binaryFile").load(folder_glob(path)))


def folder_glob(path: str) -> str:
    """The supported files right in a folder; what lies in its sub-folders does not match."""
    return f"{path.rstrip('/')}/{extension_glob()}"


def file_rows(files: DataFrame) -> DataFrame:
    fits = F.col("length") <= MAX_FILE_BYTES
    columns = [*file_columns(F.col("path")), "length"]
    small = files.where(fits).select(*columns, "content")
    large = files.where(~fits).select(*columns, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def read_documents(files: DataFrame) -> DataFrame:
    """Hash and text of scanned files; the text of PDF and image files stays null."""
    is_text = F.col("ext").isin(*K.TEXT_EXTENSIONS)
    return files.select(
        "doc_id", "file_name", "file_path", "file_stem", "ext",
        content_hash(F.col("content")).alias("file_hash"),
        F.when(is_text, decode_text(F.col("content"))).alias("text"),
    )


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Text files of any size in parts of whole lines: the file columns, split_no, text.

    Spark reads a large file in blocks; the lines of a block, at most ``SPLIT_LINES`` at a time, are a
    part, told by where the block begins. A file whose lines are not all valid UTF-8 is Latin-1 as a
    whole. Lines end in a line feed; what else ends lines stays inside them.
    """
    line, at = F.col("value"), F.monotonically_increasing_id()
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), at.alias("at")
    )
    is_utf8 = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"))
    decoded = F.when(F.col("is_utf8"), line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1"))
    part = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / SPLIT_LINES)
    placed = F.array_sort(F.collect_list(F.struct("at", "line")))
    text = F.array_join(F.transform(placed, lambda x: x["line"]), "\n")
    return (
        lines.join(is_utf8, "path")
        .select("path", "at", (F.col("block") + part).alias("split_no"), F.regexp_replace(decoded, "\r", "\n").alias("line"))
        .groupBy("path", "split_no")
        .agg(text.alias("text"))
        .select(*file_columns(F.col("path")), "split_no", "text")
    )


def failure_reason(ext: Column, text: Column, unread: Column | None = None) -> Column:
    """Why a document cannot be processed, or null. ``unread``: its bytes were too many for one value."""
    reason = F.when(~ext.isin(*K.SUPPORTED_EXTENSIONS), F.concat(F.lit("Unsupported extension "), ext))
    if unread is not None:
        reason = reason.when(unread, "File too large to be read")
    return reason.when(is_blank(text), "No text extracted")


def is_unread(docs: DataFrame) -> Column:
    """Whether a document came without its bytes and so without a hash."""
    return F.col("file_hash").isNull() if "file_hash" in docs.columns else F.lit(False)


def split_failures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to process, failures with file and error)."""
    reason = failure_reason(F.col("ext"), F.col("text"), is_unread(docs))
    failed = docs.select(F.col("file_path").alias("file"), reason.alias("error")).where(F.col("error").isNotNull())
    return docs.where(reason.isNull()), failed


def sorted_paths(files: DataFrame) -> DataFrame:
    """The distinct file paths in order."""
    return files.select("file_path").distinct().orderBy("file_path")
