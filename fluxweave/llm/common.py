"""Shared helpers: the cluster's shared folder, lineage cuts, word splitting and doc tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this package: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_words = re.compile(WORD).findall

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def words_of(text: str | None) -> list[str]:
    return _words(text) if text else []


def word_count(text: Column) -> Column:
    """Number of words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where that is unset, one of our own. A
    cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='fluxweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/fluxweave/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: computed once, and no lost executor takes it along."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: str, n: int, *cols: Column, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hash of `key` (all, if there are fewer), as (h, *cols).

    Rows are first held against a bound that twice as many pass on average, so that a task hands on a few rows, not n.
    """
    total, whole = df.count(), 1 << 40
    h = F.xxhash64(F.lit(seed), F.col(key))
    low = F.pmod(h, F.lit(whole))
    bound = whole if total <= 2 * n + 200 else whole * (2 * n + 200) // total
    return df.select(low.alias("h"), *cols).filter(F.col("h") < bound).orderBy("h").limit(n)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_of(df: DataFrame) -> Column:
    """The whole row as one column named `row`, so that no name of its own can clash; rows_of() takes it apart again."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def rows_of(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
