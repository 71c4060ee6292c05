"""OTLP protobuf export requests (ExportTraceServiceRequest) → OTLP/JSON.

Archived protobuf payloads are read with the ``binaryFile`` source and decoded
per file inside ``mapInPandas`` (Arrow batches); the result is the JSON shape
the rest of the OTLP path already handles (hex ids, integer-nanosecond text,
AnyValue wrappers), so classification, mapping and folding stay in Spark.

Field numbers (public OTLP trace proto): request.resource_spans=1;
ResourceSpans.resource=1, scope_spans=2; ScopeSpans.scope=1, spans=2;
Span.trace_id=1, span_id=2, parent_span_id=4, name=5, start=7, end=8,
attributes=9; KeyValue.key=1, value=2; AnyValue string=1, bool=2, int=3,
double=4, array=5, kvlist=6, bytes=7; ArrayValue.values=1; KeyValueList.values=1.
"""

from __future__ import annotations

import base64
import gzip
import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(buf: bytes):
    """Yield (field number, wire type, value) of one message.

    A value that reaches beyond the message's end is an error: the payload is cut off.
    """
    i, n = 0, len(buf)
    while i < n:
        key, i = _varint(buf, i)
        num, wt = key >> 3, key & 7
        if wt == 0:
            v, i = _varint(buf, i)
        elif wt == 1:
            v = buf[i : i + 8]
            i += 8
        elif wt == 2:
            ln, i = _varint(buf, i)
            v = buf[i : i + ln]
            i += ln
        elif wt == 5:
            v = buf[i : i + 4]
            i += 4
        else:
            raise ValueError(f"unsupported wire type {wt}")
        if i > n:
            raise ValueError("a field is longer than the rest of the message")
        yield num, wt, v


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    out, shift = 0, 0
    while True:
        if i >= len(buf):
            raise ValueError("the message ends within a number")
        b = buf[i]
        i += 1
        out |= (b & 0x7F) << shift
        if not b & 0x80:
            return out, i
        shift += 7


def _any_value(buf: bytes) -> dict:
    for num, wt, v in _fields(buf):
        if num == 1:
            return {"stringValue": v.decode("utf-8", "replace")}
        if num == 2:
            return {"boolValue": bool(v)}
        if num == 3:
            return {"intValue": str(v - (1 << 64) if v >= 1 << 63 else v)}
        if num == 4:
            return {"doubleValue": struct.unpack("<d", v)[0]}
        if num == 5:
            return {"arrayValue": {"values": [_any_value(x) for n2, _, x in _fields(v) if n2 == 1]}}
        if num == 6:
            return {"kvlistValue": {"values": [_key_value(x) for n2, _, x in _fields(v) if n2 == 1]}}
        if num == 7:
            return {"bytesValue": base64.b64encode(v).decode()}
    return {}


def _key_value(buf: bytes) -> dict:
    out: dict = {}
    for num, _, v in _fields(buf):
        if num == 1:
            out["key"] = v.decode("utf-8", "replace")
        elif num == 2:
            out["value"] = _any_value(v)
    return out


def _span(buf: bytes) -> dict:
    out: dict = {"attributes": []}
    for num, _, v in _fields(buf):
        if num == 1:
            out["traceId"] = v.hex()
        elif num == 2:
            out["spanId"] = v.hex()
        elif num == 4 and v:
            out["parentSpanId"] = v.hex()
        elif num == 5:
            out["name"] = v.decode("utf-8", "replace")
        elif num == 7:
            out["startTimeUnixNano"] = str(struct.unpack("<Q", v)[0])
        elif num == 8:
            out["endTimeUnixNano"] = str(struct.unpack("<Q", v)[0])
        elif num == 9:
            out["attributes"].append(_key_value(v))
    return out


def decode_request(payload: bytes) -> list:
    """ExportTraceServiceRequest bytes (optionally gzipped) → resourceSpans list."""
    if payload[:2] == b"\x1f\x8b":
        payload = gzip.decompress(payload)
    resource_spans = []
    for num, _, rs in _fields(payload):
        if num != 1:
            continue
        scopes = []
        for n2, _, ss in _fields(rs):
            if n2 == 2:
                spans = [_span(sp) for n3, _, sp in _fields(ss) if n3 == 2]
                scopes.append({"spans": spans})
        resource_spans.append({"scopeSpans": scopes})
    return resource_spans


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, content in zip(pdf["object_key"], pdf["content"]):
            try:
                out.append(json.dumps(decode_request(bytes(content))))
            except (ValueError, TypeError, AttributeError, IndexError, struct.error, EOFError, OSError, zlib.error) as e:
                raise ValueError(f"unreadable OTLP payload: {key}: {e}") from e
        yield pd.DataFrame({"object_key": pdf["object_key"], "modified": pdf["modified"], "json": out})


def read_otlp_protobuf(spark: SparkSession, root: str) -> DataFrame:
    """(object_key, modified, resource_spans VARIANT) for protobuf payload files.
    A payload that is malformed or cut off fails the job."""
    from spanlake.sources.files import relative_key

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(relative_key(F.col("path"), root).alias("object_key"), F.col("modificationTime").alias("modified"), "content")
    decoded = files.mapInPandas(_decode_batches, "object_key string, modified timestamp, json string")
    return decoded.select("object_key", "modified", F.try_parse_json("json").alias("resource_spans")).where(
        F.col("resource_spans").isNotNull()
    )
