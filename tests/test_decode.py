"""Hand-made Avro and Protobuf bodies, framing, and the registry's states."""

import json
import struct
import urllib.error

import pytest

from sluicegate.functions import avro, protobuf
from sluicegate.operators.decode import decode
from sluicegate.sources.registry import AWAY, FOUND, MISSING, ApicurioClient, Breaker, ConfluentClient, Schemas, schema_table

PARCEL = """syntax = "proto3";
package post;
import "places.proto";
/* One parcel on its way. */
message Parcel {
  message Stop { string hub = 1; sfixed64 at = 2; repeated string staff = 3; }
  uint32 grams = 1;
  repeated Stop route = 2;
  map<int32, string> stickers = 3;
  Speed speed = 5;
  places.Spot origin = 6;
  bytes seal = 7;
  float insured = 8;
  optional sint64 dock = 9;
  bool fragile = 14;
  reserved 20 to 30;
}
enum Speed { SLOW = 0; EXPRESS = 3; OVERNIGHT = 7; }
message Scan { repeated sint32 shifts = 1; fixed64 chip = 2; oneof outcome { string failure = 3; int64 shelf = 4; } repeated float heat = 5; } // packed
"""
PLACES = 'syntax = "proto3"; package places; message Spot { double lat = 1; double lon = 2; }'
SHIPMENT = json.dumps({"type": "record", "name": "Shipment", "namespace": "post", "fields": [
    {"name": "code", "type": "long"}, {"name": "weights", "type": {"type": "map", "values": "float"}}, {"name": "legs", "type": {"type": "array", "items": {"type": "record", "name": "Leg", "fields": [{"name": "hub", "type": "string"}, {"name": "late", "type": "boolean"}]}}},
    {"name": "note", "type": ["string", "null"]}, {"name": "state", "type": {"type": "enum", "name": "State", "symbols": ["OPEN", "SENT", "LOST"]}}, {"name": "mac", "type": {"type": "fixed", "name": "Mac", "size": 3}}, {"name": "last", "type": ["null", "Leg"]}]})


def varint(v):
    out = b""
    v &= (1 << 64) - 1
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def part(n, b):
    return varint(n << 3 | 2) + varint(len(b)) + b


def num(n, v):
    return varint(n << 3) + varint(v)


zz = lambda v: varint((v << 1) ^ (v >> 63))
text = lambda s: zz(len(s.encode())) + s.encode()
f32 = lambda n, x: varint(n << 3 | 5) + struct.pack("<f", x)
f64 = lambda n, kind, x: varint(n << 3 | 1) + struct.pack(kind, x)


def shipment(code, weights, legs, note, state, mac, last):
    """An Avro body of SHIPMENT; the legs come in two blocks, the first with its size in bytes."""
    leg = lambda hub, late: text(hub) + bytes([late])
    head, tail = b"".join(leg(*x) for x in legs[:1]), b"".join(leg(*x) for x in legs[1:])
    blocks = (zz(-1) + zz(len(head)) + head if head else b"") + (zz(len(legs) - 1) + tail if tail else b"") + zz(0)
    entries = (zz(len(weights)) + b"".join(text(k) + struct.pack("<f", v) for k, v in weights.items()) if weights else b"") + zz(0)
    return zz(code) + entries + blocks + (zz(1) if note is None else zz(0) + text(note)) + zz(state) + mac + (zz(0) if last is None else zz(1) + leg(*last))


SENT = shipment(-77, {"net": 1.5, "gross": 2.25}, [("AMS", 1), ("CPH", 0), ("HEL", 1)], None, 1, b"\xff\x00\x10", ("OSL", 0))


def test_avro_kinds():
    leg = lambda hub, late: {"hub": hub, "late": late}
    assert avro.Reader(SHIPMENT).read(SENT) == {"code": -77, "weights": {"net": 1.5, "gross": 2.25}, "legs": [leg("AMS", True), leg("CPH", False), leg("HEL", True)], "note": None, "state": "SENT", "mac": "/wAQ", "last": leg("OSL", False)}
    assert avro.Reader(SHIPMENT).read(shipment(1 << 40, {}, [], "é", 2, b"abc", None)) == {"code": 1 << 40, "weights": {}, "legs": [], "note": "é", "state": "LOST", "mac": "YWJj", "last": None}
    for cut in (0, 3, len(SENT) - 1):
        with pytest.raises(ValueError):
            avro.Reader(SHIPMENT).read(SENT[:cut])


def test_protobuf_kinds():
    s = protobuf.Schema(PARCEL, {"places.proto": PLACES})
    stop = lambda hub, at, *staff: part(1, hub.encode()) + f64(2, "<q", at) + b"".join(part(3, x.encode()) for x in staff)
    body = num(1, 1250) + part(2, stop("RTM", -5)) + part(2, stop("LYS", 1 << 50, "ann", "bo")) + part(3, num(1, -3) + part(2, b"top")) + part(3, num(1, 8)) + num(5, 7) + part(6, f64(1, "<d", 52.5)) + part(7, b"\0\xfe") + f32(8, 0.75) + num(9, 13) + num(14, 1) + num(19, 4) + part(25, b"later")
    want = {"grams": 1250, "route": [{"hub": "RTM", "at": -5}, {"hub": "LYS", "at": 1 << 50, "staff": ["ann", "bo"]}], "stickers": {"-3": "top", "8": ""}, "speed": "OVERNIGHT", "origin": {"lat": 52.5, "lon": 0.0}, "seal": "AP4=", "insured": 0.75, "dock": -7, "fragile": True}
    assert s.decode_framed(b"\0" + body) == want == s.decode_framed(zz(1) + zz(0) + body)
    assert s.decode_framed(b"\0") == {"grams": 0, "speed": "SLOW", "seal": "", "insured": 0.0, "fragile": False}
    assert s.decode_framed(b"\0" + num(5, 4))["speed"] == "4"
    assert s.decode_framed(zz(2) + zz(0) + zz(0) + stop("BGO", 3)) == {"hub": "BGO", "at": 3}
    packed = part(1, b"".join(varint((v << 1) ^ (v >> 63)) for v in (4, -9))) + num(1, 1) + f64(2, "<Q", 1 << 63) + num(4, 6) + part(5, struct.pack("<ff", 1.0, -0.5))
    assert s.decode_framed(zz(1) + zz(1) + packed) == {"shifts": [4, -9, -1], "chip": 1 << 63, "shelf": 6, "heat": [1.0, -0.5]}
    assert s.decode_framed(zz(1) + zz(1) + part(3, b"torn")) == {"chip": 0, "failure": "torn"}
    for broken in (b"\0" + part(7, b"seal")[:-2], zz(1) + zz(2), zz(2) + zz(0) + zz(1), b"\0" + bytes([1 << 3 | 3]), b"\0" + b"\x08" + b"\xff" * 11, zz(1) + zz(1) + part(5, b"abc")):
        with pytest.raises(ValueError):
            s.decode_framed(broken)


def test_frames_in_spark(spark):
    schemas = schema_table(spark, [(21, "JSON", "{}", None), (22, "AVRO", SHIPMENT, None), (23, "PROTOBUF", PARCEL, json.dumps({"places.proto": PLACES})), (24, "THRIFT", "", None)])
    frame = lambda i, b: bytearray(b"\0" + i.to_bytes(4, "big") + b)
    values = {"plain": bytearray(b'{"grams":5}'), "json": frame(21, b'{"grams":6}'), "avro": frame(22, SENT), "proto": frame(23, b"\0" + num(1, 7)), "odd": frame(24, b""), "lost": frame(99, b'{"grams":8}'), "torn": frame(22, SENT[:2]), "dark": frame(99, b"\7"), "none": None, "short": bytearray(b"\0\0\0")}
    df = spark.createDataFrame(list(values.items()), "n string, value binary")
    got = {r["n"]: r for r in decode(df, schemas).collect()}
    assert [json.loads(got[n]["text"]).get("grams") for n in ("plain", "json", "proto")] == [5, 6, 7] and json.loads(got["avro"]["text"])["state"] == "SENT"
    assert {n: r["reject"]["reason"] for n, r in got.items() if r["reject"]} == {"odd": "unsupported_format", "lost": "unknown_schema_id", "dark": "unknown_schema_id", "torn": "avro_decode_failed"}
    away = {r["n"]: r for r in decode(df, schemas, registry_up=False).collect()}
    assert json.loads(away["lost"]["text"]) == {"grams": 8} and [n for n, r in away.items() if r["undecoded"]] == ["dark"] and away["dark"]["reject"] is None


def test_registry_states():
    now, answers = [0.0], []

    def fetch(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    schemas = Schemas(ConfluentClient("http://r/", fetch), clock=lambda: now[0])
    answers[:] = [{"schema": "{}", "schemaType": "JSON"}, urllib.error.HTTPError("u", 404, "", None, None)]
    assert schemas.by_id(1)[0] == FOUND and schemas.by_id(1)[0] == FOUND and schemas.by_id(2)[0] == MISSING and schemas.by_id(2)[0] == MISSING
    answers[:] = [OSError()] * 3
    assert [schemas.by_id(3)[0] for _ in range(4)] == [AWAY] * 4 and not answers
    now[0] = 61.0
    answers[:] = [{"schema": "x"}]
    assert schemas.by_id(3) == (FOUND, schemas.known[3]) and schemas.known[3].kind == "AVRO"
    b = Breaker(2, 10, lambda: now[0])
    b.record(False), b.record(False)
    assert not b.allows()
    now[0] = 71.0
    assert b.allows() and not b.allows()


def test_the_other_registry_gives_newest_versions_only():
    asked = []

    def fetch(url):
        asked.append(url)
        return {"type": "object"}

    client = ApicurioClient("http://r/apis/v3/", "post", fetch)
    state, found = Schemas(client).latest("parcels/value")
    assert state == FOUND and found.kind == "JSON" and json.loads(found.text) == {"type": "object"} and not client.supports_ids
    assert asked == ["http://r/apis/v3/groups/post/artifacts/parcels%2Fvalue/versions/branch=latest/content"] and client.ping()


def test_references_are_followed():
    texts = {("places", 1): {"schema": PLACES, "schemaType": "PROTOBUF"}}
    client = ConfluentClient("http://r", lambda url: texts["places", 1] if "/subjects/places/versions/1" in url else {"schema": PARCEL, "schemaType": "PROTOBUF", "references": [{"name": "places.proto", "subject": "places", "version": 1}]})
    schemas = Schemas(client)
    state, found = schemas.by_id(23)
    assert state == FOUND and schemas.imports(found) == {"places.proto": PLACES}
