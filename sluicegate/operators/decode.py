"""Decoding framed payloads: a broadcast lookup of the schema, JSON in Catalyst, Avro and Protobuf in one Arrow UDF."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate.functions import avro, protobuf

HEADER = 5
#: Schemas in the lookup at most; the table is broadcast.
SCHEMAS = 50_000


def is_framed(value: Column) -> Column:
    return (F.length(value) >= HEADER) & (F.substring(value, 1, 1) == F.lit(b"\0"))


def schema_id(value: Column) -> Column:
    """The big-endian signed number behind the first byte."""
    raw = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _binary_to_json(kind: pd.Series, schema: pd.Series, imports: pd.Series, body: pd.Series) -> pd.DataFrame:
    readers, out = {}, []
    for k, s, i, b in zip(kind, schema, imports, body, strict=True):
        if k not in ("AVRO", "PROTOBUF") or b is None:
            out.append((None, None))
            continue
        try:
            if (k, s) not in readers:
                readers[k, s] = avro.Reader(s) if k == "AVRO" else protobuf.Schema(s, json.loads(i or "{}"))
            value = readers[k, s].read(bytes(b)) if k == "AVRO" else readers[k, s].decode_framed(bytes(b))
            out.append((json.dumps(value, ensure_ascii=False), None))
        except Exception as e:  # noqa: BLE001  any broken body is the record's fault
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["text", "error"])


def decode(records: DataFrame, schemas: DataFrame | None, framing: bool = True, registry_up: bool = True) -> DataFrame:
    """records with: text (JSON of the payload), schema_id, kind, schema, undecoded, reject (reason and detail).

    Frames with an unknown id are rejected when the registry answers; while it is away their body is taken as JSON or
    the record stays undecoded."""
    if schemas is None or not framing:
        return records.select("*", F.col("value").cast("string").alias("text"), F.lit(None).cast("int").alias("schema_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("schema"), F.lit(False).alias("undecoded"), F.lit(None).cast("struct<reason:string,detail:string>").alias("reject"))
    if schemas.limit(SCHEMAS + 1).count() > SCHEMAS:
        raise ValueError(f"more than {SCHEMAS} schemas; give those in use only")
    framed = records.withColumn("schema_id", F.when(is_framed(F.col("value")), schema_id(F.col("value")))).join(F.broadcast(schemas), "schema_id", "left")
    body = F.expr(f"substring(value, {HEADER + 1})")
    binary = framed.withColumn("_b", _binary_to_json("kind", "schema", "imports", F.when(F.col("kind").isin("AVRO", "PROTOBUF"), body)))
    plain = F.when(F.col("schema_id").isNull(), F.col("value")).otherwise(body).cast("string")
    text = F.when(F.col("kind").isin("AVRO", "PROTOBUF"), F.col("_b.text")).otherwise(plain)
    unknown = F.col("schema_id").isNotNull() & F.col("kind").isNull()
    undecoded = unknown & F.lit(not registry_up) & F.try_parse_json(plain).isNull()
    issue = lambda when, reason, more: F.when(when, F.struct(reason.alias("reason"), more.alias("detail")))
    reject = F.coalesce(
        issue(unknown & F.lit(registry_up), F.lit("unknown_schema_id"), F.concat(F.lit("schema id "), F.col("schema_id"), F.lit(" is not registered"))),
        issue(~F.col("kind").isin("JSON", "AVRO", "PROTOBUF"), F.lit("unsupported_format"), F.concat(F.col("kind"), F.lit(" payloads are not supported"))),
        issue(F.col("_b.error").isNotNull(), F.concat(F.lower("kind"), F.lit("_decode_failed")), F.substring("_b.error", 1, 200)),
    )
    return binary.withColumns({"text": text, "undecoded": undecoded, "reject": reject}).drop("_b", "imports")
