"""Protobuf payloads as JSON text by field name, from a description of the message's fields."""

from __future__ import annotations

import base64
import json
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VARINT, _EIGHT, _LENGTH, _FOUR = 0, 1, 2, 5


@dataclass(frozen=True)
class Field:
    """kind: int, uint, sint, bool, enum, double, float, fixed64, fixed32, string, bytes, timestamp or
    message. ``names`` of an enum's numbers; ``fields`` of a message by number."""

    name: str
    kind: str
    repeated: bool = False
    names: tuple[tuple[int, str], ...] = ()
    fields: tuple[tuple[int, Field], ...] = ()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _parts(data: bytes):
    """(field number, wire type, value) one after another."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == _VARINT:
            value, at = _varint(data, at)
        elif wire in (_EIGHT, _FOUR, _LENGTH):
            size = 8 if wire == _EIGHT else 4
            if wire == _LENGTH:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise ValueError("cut off")
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield tag >> 3, wire, value


def _value(field: Field, wire: int, raw):
    kind = field.kind
    if wire == _VARINT:
        if kind == "sint":
            return (raw >> 1) ^ -(raw & 1)
        if kind == "bool":
            return bool(raw)
        if kind == "enum":
            return dict(field.names).get(_signed(raw), _signed(raw))
        return raw if kind == "uint" else _signed(raw)
    if wire in (_EIGHT, _FOUR):
        code = {"double": "<d", "float": "<f", "fixed64": "<q", "fixed32": "<i"}[kind]
        return struct.unpack(code, raw)[0]
    if kind == "string":
        return raw.decode()
    if kind == "bytes":
        return base64.b64encode(raw).decode()
    if kind == "timestamp":  # nanoseconds
        seconds = nanos = 0
        for number, _, value in _parts(raw):
            seconds, nanos = (_signed(value), nanos) if number == 1 else (seconds, _signed(value))
        return seconds * 10**9 + nanos
    return decode(raw, dict(field.fields))


def _packed(field: Field, raw: bytes):
    """The values of a packed repeated field."""
    at = 0
    size = {"double": 8, "fixed64": 8, "float": 4, "fixed32": 4}.get(field.kind)
    while at < len(raw):
        if size:
            yield _value(field, _EIGHT if size == 8 else _FOUR, raw[at : at + size])
            at += size
        else:
            value, at = _varint(raw, at)
            yield _value(field, _VARINT, value)


def decode(data: bytes, fields: dict[int, Field]) -> dict:
    """The known fields by name: the last value of each, or all of a repeated one. Unknown fields are
    passed over; malformed bytes raise ValueError."""
    out: dict = {}
    try:
        for number, wire, raw in _parts(data):
            field = fields.get(number)
            if field is None:
                continue
            if not field.repeated:
                out[field.name] = _value(field, wire, raw)
            elif wire == _LENGTH and field.kind not in ("string", "bytes", "timestamp", "message"):
                out.setdefault(field.name, []).extend(_packed(field, raw))
            else:
                out.setdefault(field.name, []).append(_value(field, wire, raw))
    except (IndexError, KeyError, AttributeError, TypeError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"malformed message: {e}") from e
    return out


def json_of(fields: dict[int, Field]):
    """A function from a column of messages to JSON text by field name; null for malformed ones."""

    @F.arrow_udf(StringType())
    def as_json(messages: pa.Array) -> pa.Array:
        out = []
        for m in messages.to_pylist():
            try:
                out.append(None if m is None else json.dumps(decode(m, fields), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return as_json


def put_varint(value: int) -> bytes:
    out, value = bytearray(), value & (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode(values: dict, fields: dict[int, Field]) -> bytes:
    """A message of the given values by name; fields without a value are left out."""
    out = b""
    for number, f in fields.items():
        found = values.get(f.name)
        for v in (found if f.repeated else [found]) if found is not None else []:
            if f.kind in ("int", "uint", "bool", "enum", "sint"):
                v = {n: k for k, n in f.names}.get(v, v) if f.kind == "enum" else (v << 1 ^ v >> 63) if f.kind == "sint" else int(v)
                out += put_varint(number << 3 | _VARINT) + put_varint(v)
            elif f.kind in ("double", "fixed64", "float", "fixed32"):
                eight = f.kind in ("double", "fixed64")
                out += put_varint(number << 3 | (_EIGHT if eight else _FOUR)) + struct.pack({"double": "<d", "float": "<f", "fixed64": "<q", "fixed32": "<i"}[f.kind], v)
            else:
                if f.kind == "timestamp":
                    data = encode({"s": v // 10**9, "n": v % 10**9}, {1: Field("s", "int"), 2: Field("n", "int")})
                elif f.kind == "message":
                    data = encode(v, dict(f.fields))
                else:
                    data = v.encode() if f.kind == "string" else base64.b64decode(v)
                out += put_varint(number << 3 | _LENGTH) + put_varint(len(data)) + data
    return out
