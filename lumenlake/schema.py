"""The catalogue row, its defaults and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA_FILE = T.StructType([
    T.StructField("pos", T.LongType(), False),
    T.StructField("id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("extension", T.StringType()),
    T.StructField("md5_hash", T.StringType()),
    T.StructField("sha256_hash", T.StringType()),
    T.StructField("perceptual_hash", T.LongType()),
    T.StructField("date_taken", T.TimestampType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("camera_model", T.StringType()),
    T.StructField("is_blurry", T.BooleanType()),
    T.StructField("is_burst_leader", T.BooleanType()),
    T.StructField("indexed_at", T.TimestampType()),
])

_EMPTY_TEXT = ("id", "path", "file_name", "extension")
_FALSE = ("is_blurry", "is_burst_leader")

# RFC 3339 with a zone, microseconds kept.
_JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "ignoreNullFields": "false",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Full catalogue rows: given columns kept, missing ones set to defaults.

    ``pos`` has no default: it is the row's place in the input order and only
    the caller knows it.
    """
    if "pos" not in df.columns:
        raise ValueError("a catalogue needs a unique pos column")
    columns = []
    for field in MEDIA_FILE.fields:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name in _EMPTY_TEXT:
            value = F.lit("")
        elif field.name == "file_size":
            value = F.lit(0)
        elif field.name in _FALSE:
            value = F.lit(False)
        elif field.name == "indexed_at":
            value = F.current_timestamp()
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def unsigned64(value: Column) -> Column:
    """The unsigned reading of a 64-bit hash kept in a signed long."""
    wide = value.cast(T.DecimalType(20, 0))
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast(T.DecimalType(20, 0))) \
        .otherwise(wide).cast(T.DecimalType(20, 0))


def signed64(value: Column) -> Column:
    limit = F.lit("9223372036854775807").cast(T.DecimalType(20, 0))
    span = F.lit("18446744073709551616").cast(T.DecimalType(20, 0))
    return F.when(value > limit, value - span).otherwise(value).cast("long")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, keys in camel case, nulls written out.

    Works for catalogues, groups, plans and progress alike; perceptual hashes
    are written as unsigned numbers.
    """
    fields = [
        (unsigned64(F.col(c)) if c == "perceptual_hash" else F.col(c)).alias(camel(c))
        for c in df.columns
    ]
    return df.select(F.to_json(F.struct(*fields), _JSON_OPTIONS).alias("json"))


def from_json_rows(rows: DataFrame, schema: T.StructType = MEDIA_FILE) -> DataFrame:
    """Inverse of :func:`to_json_rows` for a known row type."""
    wire = T.StructType([
        T.StructField(
            camel(f.name),
            T.DecimalType(20, 0) if f.name == "perceptual_hash" else f.dataType,
        )
        for f in schema.fields
    ])
    doc = rows.select(F.from_json("json", wire, _JSON_OPTIONS).alias("doc"))
    out = []
    for f in schema.fields:
        value = F.col("doc").getField(camel(f.name))
        if f.name == "perceptual_hash":
            value = signed64(value)
        out.append(value.alias(f.name))
    return doc.select(*out)
