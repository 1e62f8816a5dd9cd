"""Fingerprints, deterministic ids and time keys."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_hash(values: Column) -> Column:
    """Hash of a set of strings, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(values), "\n"), 256)


def fingerprint(*columns: Column) -> Column:
    """Hash of the JSON of named columns in order of name; nulls are absent."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def listing_fingerprint(*columns: Column) -> Column:
    """Hash of a JSON array of the columns as strings, nulls as ``null``."""
    quoted = [F.coalesce(F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null")) for c in columns]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256)


def uuid_of(text: Column) -> Column:
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def cadence_bucket(at: Column, cadence: int) -> Column:
    return F.floor(F.unix_timestamp(at) / cadence).cast("long")


def jitter(identity: Column, bucket: Column, cadence: int) -> Column:
    """A tenth of the cadence in milliseconds at most, fixed by identity and bucket."""
    head = F.conv(F.substring(F.sha2(F.concat_ws(":", identity.cast("string"), bucket.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(cadence * 100).cast("double") * head / F.lit(0xFFFFFFFF)).cast("long")


def backoff(attempt: Column, share: Column) -> Column:
    """Milliseconds until the next attempt: doubling from five seconds, an hour at most, times a given share."""
    return F.floor(F.least(F.lit(3_600_000.0), 5_000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))) * share).cast("long")


def filter_hash(filters: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in sorted(filters.items()) if v is not None and k not in ("cursor", "limit")}, separators=(",", ":")).encode()).hexdigest()


def encode_cursor(scope: str, filters: dict, primary, identity) -> str:
    """An opaque cursor, bound to the scope and the filters of the page that it continues."""
    body = {"v": 1, "scope": scope, "filterHash": filter_hash(filters), "after": {"primary": primary, "id": identity}}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, scope: str, filters: dict) -> dict:
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if body["v"] == 1 and body["scope"] == scope and body["filterHash"] == filter_hash(filters):
            return body["after"]
    except (ValueError, KeyError, TypeError):
        pass
    raise ValueError("invalid_cursor")
