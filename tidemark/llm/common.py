"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: \x20 and \x09-\x0D, which is what bytes.split() splits at.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a local session has one of its own, and a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark, "_tidemark_shared", None)
        if where is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark._tidemark_shared = where
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns that an operator needs, so that extra columns can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


#: Keys that may each hold more than one in so many of all rows: fewer than this, so that they can be broadcast.
HOT = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows, `total` at most, with a table of one row a key that counts the rows of its key as n.

    Keys with more than total / HOT rows are fewer than HOT; they are broadcast and their rows stay where they are. All
    others meet by a shuffle, in which no key has more than total / HOT rows.
    """
    hot = F.col("n") * HOT > total
    few, many = table.filter(hot).drop("n"), table.filter(~hot).drop("n")
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys)
    return rows.join(F.broadcast(few), keys).unionByName(cold)


def first_tag() -> int:
    """The first of the numbers by which a task marks its rows; the same when the task is run again."""
    return TaskContext.get().partitionId() << 33


def utf8(column: pa.ChunkedArray | pa.Array):
    """The UTF-8 bytes of each string, b"" for null, without making Python strings. Bytes that aren't UTF-8 are read as U+FFFD, as decoders do."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        yield from ((value.as_py() or b"").decode("utf-8", "replace").encode() for value in column.cast(pa.binary()))
        return
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


#: Bytes that are white space in ASCII.
WHITE = np.zeros(256, dtype=bool)
WHITE[[*range(9, 14), 32]] = True


def word_arrays(texts: list[bytes], between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of texts: their bytes in a row, the words' bounds in them, and each text's first word (and the end). Words are split at bytes that are `between`, a line feed among them."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    white = between[data]
    begins = ~white
    begins[1:] &= white[:-1]
    first = np.flatnonzero(begins)
    length = np.flatnonzero(white & ~np.append(True, white[:-1])) - first
    return data[~white], np.concatenate(([0], np.cumsum(length))), np.concatenate(([0], np.searchsorted(first, ends)))


def dictionary(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The distinct ones of data's stretches between bounds, and the number of each stretch's among them."""
    at = pa.py_buffer((bounds - bounds[0]).astype(np.int32))
    told = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(data[bounds[0] : bounds[-1]]))]).dictionary_encode()
    return told.dictionary, told.indices.to_numpy()


def numbered(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """As dictionary(), with the distinct ones as a list."""
    told, which = dictionary(data, bounds)
    return told.to_numpy(zero_copy_only=False).tolist(), which


def portions(texts, size: int = 2_000_000):
    """Lists of texts of at most that many bytes together, or of one text."""
    out, n = [], 0
    for x in texts:
        if out and n + len(x) > size:
            yield out
            out, n = [], 0
        out.append(x)
        n += len(x)
    if out:
        yield out


def fold_of(id_column, n: int):
    """crc32 of the id's decimal text modulo n; a null id counts as empty text, so as 0."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def runs(batches, keys: list[str]):
    """Tables that each hold all rows of one or more keys, from batches sorted by them. Only the last key's rows wait for the next batch."""
    rest = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        n = table.num_rows
        change = np.zeros(n, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        if rest:
            change[0] = any(table.column(k)[0].as_py() != rest[-1].column(k)[0].as_py() for k in keys)
        else:
            change[0] = True
        at = np.flatnonzero(change)
        if len(at) == 0:
            rest.append(table)
            continue
        if rest or at[0] > 0:
            head = [*rest, table.slice(0, int(at[0]))]
            yield pa.concat_tables([t for t in head if t.num_rows])
            rest = []
        last = int(at[-1])
        if last > at[0]:
            yield table.slice(int(at[0]), last - int(at[0]))
        rest = [table.slice(last)]
    if rest:
        yield pa.concat_tables(rest)


def bounds(table: pa.Table, keys: list[str]):
    """Where each key's rows start in a table of runs(), with the end at last."""
    n = table.num_rows
    change = np.zeros(n + 1, dtype=bool)
    change[0] = change[n] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:n] |= column[1:] != column[:-1]
    return np.flatnonzero(change)
