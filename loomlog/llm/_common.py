"""Helpers shared by the operators: reading tables, scratch space, files, words and hashes.

Words split on white space are bytes: `bytes.split()` splits on exactly
[\\x20\\x09-\\x0D], and `bytes.lower()` lower-cases exactly A-Z, so both follow
the contracts without a regular expression.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling word hash, and of the splitmix finaliser.
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Only where the setting is absent (a local test session) a temporary
    folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/loomlog-scratch"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet and rereads it: cuts the lineage with copies that survive a lost executor."""
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a scratch or output folder, and the folder's path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, chunks: Iterator[bytes]) -> int:
    """Writes one file under a temporary name and renames it; a repeated attempt replaces it by the same bytes."""
    files, folder = filesystem(uri)
    files.create_dir(folder, recursive=True)
    hidden, size = f"{folder}/_tmp-{name}-{uuid.uuid4().hex}", 0
    with files.open_output_stream(hidden, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(hidden, f"{folder}/{name}")
    return size


def release() -> None:
    """Gives freed memory back to the system: a Python worker stays for later tasks, and should not keep what a large group took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes, by doubling; empty for fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, span = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        rest = k
        while rest:
            if rest & 1:
                out = power if out is None else out[: len(power) - have] * _power(span) + power[have:]
                have += span
            rest >>= 1
            if rest:
                power = power[: len(power) - span] * _power(span) + power[span:]
                span *= 2
        return mix(out[:n])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(MULT), n, 1 << 64))


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of the column's text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(n))
