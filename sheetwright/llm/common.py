"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java/RE2 character class.
WS = r"[ \x09-\x0D]+"
#: A word.
WORD = r"[^ \x09-\x0D]+"
#: Rows up to which a small table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset a local folder is
    made and set, but only if the driver and its executors are one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sheetwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage and survives lost executors; a table that several
    later steps read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows.

    ``df`` must be a materialised table, as it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def plain(text: Column, kept: str = "") -> Column:
    """The text with a blank for each white space but ``kept``."""
    for c in "\t\n\x0b\x0c\r":
        text = text if c in kept else F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """The words of a text as an array. Byte searches and one plain split are far cheaper than a regex."""
    return F.array_remove(F.split(plain(text), " "), "")


def row_key(*columns: Column) -> Column:
    """A key of a row's content that is equal in every scan of the table.

    Whether each value is null goes into it too, as the hash skips nulls.
    """
    return F.xxhash64(*[c for x in columns for c in (x.isNull(), x)])


def trigram_hashes(words: Column) -> Column:
    """Hashes of the 3-word windows in order; empty below three words.

    ``words`` must be a column of a table below, as it is used many times.
    """
    each = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(each, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def join_hot(rows: DataFrame, one: DataFrame, key: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one``, which has one row a key, where a key may have any number of rows.

    Each key's rows are dealt over ``salts`` groups by a hash of the whole
    row, and its row of ``one`` goes to each of these. Both sides are plain
    shuffles, so adaptive execution can split what is still large.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(one, [key, "_salt"], how).drop("_salt")


def release() -> None:
    """Hands memory that a Python worker no longer needs back to the system, as workers live on."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass
