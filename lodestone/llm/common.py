"""Small helpers shared by the training-data operators.

Conventions of the subpackage
-----------------------------
* An operator takes and returns DataFrames; an ``opN_<name>(spark, sf_dir)`` query applies it to its
  whole table.  Operators select the columns they need first, so further columns of a table, whatever
  their names, never get in the way.
* A *word* is ``[^\\x20\\x09-\\x0D]+``; lower case means A-Z only, so that Spark, SQL and Python agree.
* A null text is treated as an empty one; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a batch that are Python objects at a time, and their bytes (a longer row is on its own).
ROWS, BYTES = 500, 4 << 20
#: What a Python worker keeps for its later tasks, at most this many things at a time.
KEPT = 2
_kept: dict[tuple[str, int], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: on bytes, lower() changes A-Z only and split() cuts at the six blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column, lower: Callable[[Column], Column] = lower_ascii, bare: bool = True) -> Column:
    """The words of a text as an array; null and blank texts give an empty one.  Without ``bare`` there
    may be empty words among them.

    Blanks are made one kind first, as splitting at a single character is far cheaper than at a pattern.
    """
    out = lower(F.coalesce(text, F.lit("")))
    for blank in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(out, " "), "") if bare else F.split(out, " ")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fold as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def drawn(what: str, *columns: str) -> Column:
    """A number from 0 to 1 that hangs on the columns alone; rows with one below a rate are a sample."""
    return F.xxhash64(F.lit(what), *columns) / F.lit(2.0**64) + 0.5


def kept(what: str, contents: int, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once by a Python worker; contents: a hash of all that it hangs on.

    Tasks get this function by its name, so all of them in a worker share one store, while the globals of a
    function made inside of another one travel with it and are new in every task."""
    key = (what, contents)
    if key not in _kept:
        while len(_kept) >= KEPT:
            del _kept[next(iter(_kept))]
        _kept[key] = make()
    return _kept[key]


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, ``ROWS`` and ``BYTES`` at most at a time."""
    todo = [batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)][::-1]
    while todo:
        part = todo.pop()
        if part.nbytes > BYTES and part.num_rows > 1:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``fn`` on the rows of ``df``, a part of an Arrow batch at a time; narrow, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                out = fn(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    The folder is the cluster's ``spark.checkpoint.dir``; only where none is set (tests, a laptop) one
    is made next to the warehouse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return df.checkpoint()
