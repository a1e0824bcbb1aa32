"""What the operators share: the shared folder, tables that cut lineage, worker caches."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TOKENIZER_FILE = "word_bpe_49k.json"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset (tests, one machine) an own one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch on its way to Python, and the session's default.
BATCH_BYTES, DEFAULT_BYTES = "4194304", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Lets batches of long texts end by their bytes, well under Spark's default; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many keys are sent to all workers; more are joined by a shuffle.
SENT_KEYS = 500_000


def sent(keys: DataFrame) -> DataFrame:
    """A written table of keys for a join: sent to all workers where its counted rows are few."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The keys of more than one row, written down."""
    return sent(table(df.groupBy(key).agg(F.count(F.lit(1)).alias("__times")).where("__times > 1").select(key), "repeated"))


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key. Rows whose key is theirs alone, mostly nearly all, are neither moved nor sorted. df must read the same rows on every pass."""
    many = repeated(df, key)
    return df.join(many, key, "left_anti").unionByName(df.join(many, key, "left_semi").dropDuplicates([key]).select(*df.columns))


def drop_table(df: DataFrame) -> None:
    """Removes the files behind a frame that table() returned."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def revived(kind: type, state: dict):
    """An object of this kind from its attributes: a broadcast holds these, which workers can read without a copy of the package."""
    out = object.__new__(kind)
    out.__dict__ = state
    return out


def worker_cache(owner: str | None = None) -> dict:
    """A dictionary that lives in the Python worker over its tasks, until tasks of another owner begin."""
    kept = sys.modules.setdefault("_tessella_cache", types.ModuleType("_tessella_cache")).__dict__
    if owner is not None and kept.setdefault("owner", owner) != owner:
        kept.clear()
        kept["owner"] = owner
    return kept


#: Rows that are Python objects at a time.
SLICE = 2048


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], Iterator[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over Python lists: fn gets an iterator of {column: list} and yields the same; arrays may stand for lists."""
    bounded_batches(df.sparkSession)
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow, owner = to_arrow_schema(kind), fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)

        def lists() -> Iterator[dict[str, list]]:
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    part = b.slice(at, SLICE)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                pa.default_memory_pool().release_unused()

        for out in fn(lists()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_STEPS = np.cumprod(np.full(1 << 12, _POWER[-1], np.uint64), dtype=np.uint64)  # for places beyond, by two digits


def powers(at: np.ndarray) -> np.ndarray:
    """A fixed odd multiplier's power of at + 1, whatever the place."""
    out = _POWER[at & 4095]
    far = np.flatnonzero(at > 4095)
    if len(far):
        high = (at[far] >> 12) - 1
        out[far] *= _STEPS[high & 4095]
        turns = high >> 12
        for k in range(int(turns.max())):  # places beyond 16 million
            out[far[turns > k]] *= _STEPS[-1]
    return out


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n: the folds of the contracts. Null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
