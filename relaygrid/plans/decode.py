"""Decoding log values to message rows: one decoder for all plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid import schemas
from relaygrid.functions.identity import CLOCK

_BROKEN = "_broken"


def _parsed(value: Column, model: str) -> Column:
    """The value by its model's schema; NULL unless it is exactly one object and every field fits."""
    schema = T.StructType([*schemas.BY_MODEL[model].fields, T.StructField(_BROKEN, T.StringType())])
    # in brackets, text after the object shows; counting builds no texts, so what it does not know is listed
    bracketed = F.concat(F.lit("["), value, F.lit("]"))
    listed = F.from_json(bracketed, T.ArrayType(T.StringType()))
    whole = F.when(F.coalesce(F.json_array_length(bracketed) == 1, F.lit(False)), value).when(F.size(listed) == 1, value)
    return F.from_json(whole, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})


def decode_messages(log: DataFrame, model: Column) -> DataFrame:
    """Values decoded by the model of their topic, as message rows.

    One scan for all models: each value is parsed with its own schema only, and
    corrupt values are left out.  Binary fields stand at the top level, other
    payloads in a column named after their model, and ``source_clock`` holds the
    submission time as written.  Values of models without a schema pass
    undecoded.
    """
    names = tuple(schemas.BY_MODEL)
    typed = log.withColumn("model", model)
    parses = F.struct(*[_parsed(F.when(F.col("model") == m, F.col("value")), m).alias(f"_{m}") for m in names])
    # out of a generator the parsed struct is read, not parsed again for every field
    decoded = typed.select("*", F.inline(F.array(parses)))
    good = F.lit(False)
    for m in names:
        good = good | (F.col(f"_{m}").isNotNull() & F.col(f"_{m}.{_BROKEN}").isNull())
    decoded = decoded.where(~F.col("model").isin(*names) | good)

    def merged(field: str) -> Column:
        return F.coalesce(*[F.col(f"_{m}.{field}") for m in names if field in schemas.BY_MODEL[m].fieldNames()])

    own = [f for f in schemas.BINARY.fieldNames() if f not in ("entity",)]
    clock = F.when(F.col("model").isin("binary", "download"), F.get_json_object("value", "$.source.timestamp"))
    return decoded.select(
        *typed.columns, *[merged(f).alias(f) for f in own], F.col("_binary.entity").alias("entity"),
        *[F.col(f"_{m}.entity").alias(m) for m in schemas.MESSAGE_PAYLOADS], clock.alias(CLOCK),
    )
