"""Helpers the text operators share."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space as the contracts define it: space and \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


_held: dict[str, object] = {}


def held(content: str, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept by this worker for later tasks of the same ``content``.

    ``content`` is a digest of all that ``make`` depends on.  Nested functions travel to
    the workers with copies of their module's variables; this function is imported there,
    so that its dictionary is the worker's own.  Only the last one built is kept.
    """
    if content not in _held:
        _held.clear()
        _held[content] = make()
    return _held[content]


def digest_of(*parts: object) -> str:
    return hashlib.sha256(pickle.dumps(parts)).hexdigest()


def large_text(parts: Iterable[pa.Array]) -> pa.Array:
    """String arrays in a row, with offsets of their own that start at 0.

    A cast slice shares its offsets with what it was cut from, which some of Arrow's
    string functions don't expect.
    """
    return pa.concat_arrays([part.cast(pa.large_string()) for part in parts])


def per_text(
    df: DataFrame,
    id_column: str,
    text: Column,
    fields: str,
    make: Callable[[], Callable[[object], tuple]],
    keep: str = "",
) -> DataFrame:
    """One row per input row: the id (as ``doc_id``), the columns named in ``keep``
    and the ``fields`` that a plain function derives from one text.

    ``make`` runs once per task and returns that function; tables it needs are
    built there.  Rows arrive in Arrow batches and leave in batches of the same
    size, so a task holds one batch of texts.
    """
    kept = keep.split()
    source = df.select(F.col(id_column).alias("doc_id"), *kept, text.alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    extra = "".join(f"{k} {source.schema[k].dataType.simpleString()}, " for k in kept)
    schema = f"doc_id {id_type}, {extra}{fields}"
    made = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [function(t) for t in batch.column("_text").to_pylist()]
            columns = [pa.array(list(values), field.type) for values, field in zip(zip(*rows), made)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("doc_id", *kept)] + columns, ["doc_id", *kept, *made.names]
            )

    return source.mapInArrow(run, schema)
