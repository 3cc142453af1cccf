"""Text sources: folders of files, tables of texts, their hashes and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_DEPTH = 4 * 1024 * 1024, 6
# The kinds of files that are texts.
KINDS = ("txt", "md", "markdown", "csv")


def folder(spark: SparkSession, root: str, depth: int = MOST_DEPTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, name, hash, text) of the text files below a folder; the table files hold are read as plain text.

    Hidden files and folders, files that are deeper or larger, and other kinds (in any case) are left out.
    """
    kinds = ",".join("".join(f"[{c}{c.upper()}]" for c in kind) for kind in KINDS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + kinds + "}").load(root)
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    f = files.where(F.col("length") <= most_bytes).select(name.alias("name"), F.decode("content", "UTF-8").alias("text"))
    f = f.where((F.size(F.split("name", "/")) <= depth + 1) & ~F.col("name").rlike(r"(^|/)\."))
    return f.select(F.concat(F.lit("src:"), F.substring(F.sha2("name", 256), 1, 16)).alias("id"), "name", F.sha2("text", 256).alias("hash"), "text")


def bundled(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, hash, text) of one flat folder of samples; ids begin with ``sample:``."""
    f = spark.read.text(root, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return f.select(F.concat(F.lit("sample:"), F.col("name")).alias("id"), "name", F.sha2("text", 256).alias("hash"), "text")


def table_texts(docs: DataFrame, id: str, name: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("string").alias("id"), F.col(name).alias("name"), F.sha2(text, 256).alias("hash"), F.col(text).alias("text"))


def listing(texts: DataFrame) -> DataFrame:
    """(id, name, hash) without the texts."""
    return texts.select("id", "name", "hash")


def union(*texts: DataFrame) -> DataFrame:
    """Several sources as one; ids tell where a text came from."""
    out = texts[0]
    for t in texts[1:]:
        out = out.unionByName(t)
    return out


def read(texts: DataFrame, id: str) -> DataFrame:
    return texts.where(F.col("id") == id).select("text")


def changed(listed: DataFrame, recorded: DataFrame) -> DataFrame:
    """(id, hash, name) of sources whose content differs from what was recorded last, or was never recorded."""
    old = recorded.select(F.col("source").alias("id"), F.col("hash").alias("old"))
    return listed.join(old, "id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("id", "hash", "name")


def duplicates(texts: DataFrame) -> DataFrame:
    """(hash, n, first): texts by content, with how many sources hold each."""
    return texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def model_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256, ok): model files, and whether they begin as such a file does."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"GGUF")).alias("ok"))
