"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: ASCII white space that separates words in every operator here: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tributary-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage: what follows neither repeats the work nor depends on the executors that did it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tributary/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _STEPS:
        _STEPS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that steps in progress have written.
_STEPS: list[list[str]] = []


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*settled: DataFrame) -> None:
    """Delete what ``settle`` wrote for these; nothing lazy may still need them."""
    for df in settled:
        _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def settled_alone(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``make``, whose result is written as a table; all that was written on the way to it is deleted then."""

    @wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        _STEPS.append([])
        try:
            result = make(*args, **kwargs)
        except BaseException:
            _STEPS.pop()
            raise
        folders = _STEPS.pop()
        out = settle(result)
        _delete(out.sparkSession, folders)
        return out

    return run


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, to be broadcast in a join while it has at most ``rows`` rows; give rows of tens of bytes. It is counted, so settle it."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows and bytes of text that one Arrow batch holds, where the session leaves Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let whole texts travel to Python in small batches, of few rows and, as texts may be long, of few bytes."""
    for name, default, least in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, str(least))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        return


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow and the like, that gives memory back when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_id: str = "doc_id") -> DataFrame:
    """Only (id, text) with a null text as the empty one, so that no other column can clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(out_id), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def public_vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def widened(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with more columns."""
    return StructType([*df.schema.fields, *(StructField(name, _parse(kind)) for name, kind in columns.items())])


def _parse(kind: str) -> DataType:
    return StructType.fromDDL(f"x {kind}")["x"].dataType


def words_of(text: Column) -> Column:
    """Array of the words of a text, split at ASCII white space; empty for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
