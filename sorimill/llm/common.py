"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a Python worker turns into Python objects at a time; bounds its memory
#: whatever the size of Spark's Arrow batches.
SLICE_ROWS = 1000

#: Java regex of the white space that separates words.
SPACE = r"[ \t-\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text) -> "F.Column":
    """Words of a text column as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Only where that is unset, as in a bare
    local session, the warehouse folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/sorimill-{uuid.uuid4().hex}"


def cut(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what stands
    before, and later uses of the table don't repeat its work.
    """
    path = shared_dir(df.sparkSession)
    df = df.select(*columns) if columns else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lower_names(names) -> set[str]:
    return {n.lower() for n in names}


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed in Python over Arrow batches.

    ``make()`` runs once in each task and returns a function that takes one
    ``pyarrow.Array`` for each of ``inputs`` and returns one for each of
    ``fields``. It sees at most SLICE_ROWS rows at a time. ``keep`` names the
    columns to carry (all if None). A carried column whose name clashes with a
    new one, in any case, gives way to it.
    """
    taken = _lower_names(f.name for f in fields)
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    hidden = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"`{c}`").alias(h) for c, h in zip(inputs, hidden)])
    schema = T.StructType([df.schema[c] for c in carried] + list(fields))
    n_carried = len(carried)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                made = f(*[part.column(n_carried + i) for i in range(len(inputs))])
                columns = [part.column(i) for i in range(n_carried)] + [
                    x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n_carried + i).type) for i, x in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def null_first_less(a, b):
    """a < b where null is the smallest value; never null."""
    return F.when(b.isNull(), F.lit(False)).when(a.isNull(), F.lit(True)).otherwise(a < b)


#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``limit`` rows of ``most`` bytes in all.

    Meant for written tables of a few short columns, where counting is cheap. Columns
    of no fixed width are measured as text. Beyond the limits the plain join shuffles;
    the rows are the same.
    """
    loose = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    width = 16 * len(df.columns)
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in loose])))) if loose else F.lit(0)
    n, measured = df.limit(limit + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= limit and n * width + (measured or 0) <= most else df
