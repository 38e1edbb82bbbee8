"""Hashes, reference texts, and the ids that public event protocols derive from content."""

from __future__ import annotations

import base64
import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How many parents of each kind an event may name; None: any number.
RELATIONSHIPS = {"auth": None, "link": None, "parent": 1, "prev": None, "related": None, "root": 1}
#: The largest whole number that canonical JSON may hold.
MAX_JSON_INT = 2**53 - 1


def stable_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def to_hex(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column | str) -> Column:
    """Bytes of hex text; null for malformed text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(c))


def reference(space: str, id_bytes: Column | str) -> Column:
    """``<space>:<lower-case hex>``."""
    return F.concat_ws(":", F.lit(space), to_hex(id_bytes))


def parse_reference(c: Column | str) -> Column:
    """struct(space, id) of a reference text, null if it is malformed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[a-z_]+:([0-9a-f]{2})+$"), F.struct(F.substring_index(c, ":", 1).alias("space"), F.unhex(F.substring_index(c, ":", -1)).alias("id")))


def references(c: Column | str) -> Column:
    """The references of a space-separated column, exactly one array entry each."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")


def relationships_valid(kind: Column | str, refs: Column | str) -> Column:
    """Whether a relationship kind is known and has no more references than it may."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    single = [k for k, n in RELATIONSHIPS.items() if n == 1]
    return kind.isin(*RELATIONSHIPS) & (~kind.isin(*single) | (F.size(references(refs)) <= 1))


def escaped(c: Column) -> Column:
    """A JSON string's inside as the canonical form has it: short escapes where there are any, other
    control characters by number, all else as it is."""
    for plain, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x08", "\\b"), ("\x0c", "\\f")):
        c = F.replace(c, F.lit(plain), F.lit(short))
    numbered = c
    for code in sorted({*range(32)} - {8, 9, 10, 12, 13}):
        numbered = F.replace(numbered, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(c.rlike("[\\x00-\\x1f]"), numbered).otherwise(c)


def protocol_event_id(author_hex: Column, claimed_at: Column, kind: Column, tags_json: Column, content: Column) -> Column:
    """SHA-256 of the canonical array [0, author, seconds, kind, tags, content]. ``tags_json`` is
    canonical JSON already; ``content`` is escaped here."""
    parts = [F.lit('[0,"'), author_hex, F.lit('",'), claimed_at.cast("string"), F.lit(","), kind.cast("string"), F.lit(","), tags_json, F.lit(',"'), escaped(content), F.lit('"]')]
    return F.sha2(F.concat(*parts), 256)


def canonical(value) -> str:
    """JSON with keys in code point order and no white space; fractions and large numbers are refused."""
    if isinstance(value, float) or (isinstance(value, int) and not isinstance(value, bool) and abs(value) > MAX_JSON_INT):
        raise ValueError("canonical JSON holds whole numbers up to 2^53-1 only")
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _each(text: pa.Array, f) -> pa.Array:
    out = []
    for t in text.to_pylist():
        try:
            out.append(None if t is None else f(json.loads(t)))
        except (ValueError, AttributeError):
            out.append(None)
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def canonical_json(text: pa.Array) -> pa.Array:
    """Canonical JSON of JSON text; null where it is malformed or holds refused numbers."""
    return _each(text, canonical)


def _without(event: dict, *keys: str) -> dict:
    return {k: v for k, v in event.items() if k not in keys}


def _base64(data: bytes, url_safe: bool) -> str:
    return (base64.urlsafe_b64encode if url_safe else base64.b64encode)(data).decode().rstrip("=")


@F.arrow_udf(StringType())
def content_hash(text: pa.Array) -> pa.Array:
    """Unpadded base64 of the SHA-256 of canonical JSON without hashes, signatures and unsigned."""
    return _each(text, lambda e: _base64(hashlib.sha256(canonical(_without(e, "hashes", "signatures", "unsigned")).encode()).digest(), False))


# What redaction keeps, by room version.
KEPT_KEYS = ["auth_events", "content", "depth", "event_id", "hashes", "origin_server_ts", "prev_events", "room_id", "sender", "signatures", "state_key", "type"]
KEPT_BEFORE_11 = ["membership", "origin", "prev_state"]
#: event type -> [(content key, first version, last version)]
KEPT_CONTENT = {
    "m.room.aliases": [("aliases", 1, 5)],
    "m.room.create": [("creator", 1, 99)],
    "m.room.history_visibility": [("history_visibility", 1, 99)],
    "m.room.join_rules": [("join_rule", 1, 99), ("allow", 8, 99)],
    "m.room.member": [("membership", 1, 99), ("join_authorised_via_users_server", 9, 99)],
    "m.room.power_levels": [(k, 1, 99) for k in ("ban", "events", "events_default", "kick", "redact", "state_default", "users", "users_default")] + [("invite", 11, 99)],
    "m.room.redaction": [("redacts", 11, 99)],
}


def redacted(event: dict, version: int) -> dict:
    """The event as redaction leaves it; from version 11 on a creation event keeps all content."""
    top = {*KEPT_KEYS, *(KEPT_BEFORE_11 if version < 11 else [])}
    out = {k: v for k, v in event.items() if k in top}
    if isinstance(out.get("content"), dict) and not (version >= 11 and event.get("type") == "m.room.create"):
        keep = {k for k, a, b in KEPT_CONTENT.get(event.get("type"), []) if a <= version <= b}
        out["content"] = {k: v for k, v in out["content"].items() if k in keep}
    return out


def event_id_udf(version: int):
    """The id of room events: their own in versions 1 and 2, ``$`` and the reference hash in
    unpadded base64 in version 3, in the URL-safe alphabet from 4 on."""

    def one(e: dict) -> str | None:
        if version <= 2:
            return e.get("event_id")
        signed = canonical(_without(redacted(e, version), "signatures", "unsigned"))
        return "$" + _base64(hashlib.sha256(signed.encode()).digest(), version >= 4)

    @F.arrow_udf(StringType())
    def event_id(text: pa.Array) -> pa.Array:
        return _each(text, one)

    return event_id
