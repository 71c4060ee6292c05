"""OTLP protobuf payloads decode to the same events as their JSON form."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from spanlake.operators import otlp
from spanlake.sources import otlp_proto


def _varint(n):
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _ld(num, payload):
    return _varint(num << 3 | 2) + _varint(len(payload)) + payload


def _fixed64(num, v):
    return _varint(num << 3 | 1) + struct.pack("<Q", v)


def _kv(key, any_value):
    return _ld(1, key.encode()) + _ld(2, any_value)


def _request():
    attrs = (
        _ld(9, _kv("gen_ai.operation.name", _ld(1, b"chat")))
        + _ld(9, _kv("gen_ai.usage.output_tokens", _varint(3 << 3 | 0) + _varint(42)))
        + _ld(9, _kv("user.id", _ld(1, b"u1")))
    )
    span = (
        _ld(1, bytes.fromhex("0102030405060708090a0b0c0d0e0f10"))
        + _ld(2, bytes.fromhex("1112131415161718"))
        + _ld(5, b"chat span")
        + _fixed64(7, 1704067200123000000)
        + _fixed64(8, 1704067201123000000)
        + attrs
    )
    return _ld(1, _ld(2, _ld(2, span)))


def test_protobuf_request_maps_like_json(spark, scratch):
    d = os.path.join(scratch, "pb")
    os.makedirs(d)
    with open(os.path.join(d, "req.pb"), "wb") as f:
        f.write(_request())
    objs = otlp_proto.read_otlp_protobuf(spark, d)
    mapped = otlp.map_spans(otlp.decode_spans(otlp.flatten_spans(objs))).first()
    assert mapped.trace_id == "0102030405060708090a0b0c0d0e0f10" and mapped.span_id == "1112131415161718"
    assert mapped.observation_type == "generation-create" and str(mapped.start_time).startswith("2024-01-01 00:00:00.123")
    ev = otlp.otlp_events(objs)
    assert ev.where(F.col("type") == "trace-create").count() == 1 and ev.count() == 2


@pytest.mark.parametrize("cut", [1, 3, 20, 60])
def test_damaged_payload_is_an_error(spark, scratch, cut):
    """A payload that is cut off, or is none, never counts as read."""
    d = os.path.join(scratch, "pb")
    os.makedirs(d)
    with open(os.path.join(d, "req.pb"), "wb") as f:
        f.write(_request()[:-cut])
    with pytest.raises(Exception, match="unreadable OTLP payload: req.pb"):
        otlp_proto.read_otlp_protobuf(spark, d).collect()


def test_empty_payload_is_an_empty_request(spark, scratch):
    d = os.path.join(scratch, "pb")
    os.makedirs(d)
    open(os.path.join(d, "req.pb"), "wb").close()
    assert otlp.otlp_events(otlp_proto.read_otlp_protobuf(spark, d)).count() == 0
