"""What telemetry may hold: maps of fields and nested documents without secrets and signed URLs."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievewright.functions import urls

REDACTED, LONGEST = "[REDACTED]", 1_000
#: Levels and keys of a nested document that are told.
DEPTH, KEYS = 6, 100
# Fixed patterns: names of fields that are never told, values that are secrets, queries that sign a URL.
FORBIDDEN = "(?i)authorization|cookie|credential|password|passwd|secret|token|api[_-]?key|private[_-]?key|request[_-]?body|response[_-]?body|raw[_-]?(body|document|prompt)|resume|curriculum|cover[_-]?letter|email|phone"
SECRET = r"(?i)(?<![A-Za-z0-9_])(bearer|basic)\s+[A-Za-z0-9+/_.=-]{8,}|(sk|phc|ghp|github_pat|xox[baprs])[_-][A-Za-z0-9_-]{8,}|CANARY[_-]?SECRET"
SIGNED = r"(?i)[?&](x-amz-(algorithm|credential|signature)|signature|sig|token|access_token|key-pair-id)="


def safe_value(value: Column) -> Column:
    """A text as telemetry may hold it: secrets and URLs inside prose become marks, a URL loses its query, the rest is cut at 1000 characters."""
    credentials = value.rlike(r"(?i)^https?://[^/?#]*@")
    signed = F.concat(F.lit("?"), urls.query(value)).rlike(SIGNED)
    whole = F.when(credentials | signed, "[REDACTED_SIGNED_URL]").when(value.rlike("[?#]"), F.concat(urls.origin(value), urls.path(value), F.lit("?" + REDACTED))).otherwise(F.substring(value, 1, LONGEST))
    kept = F.when(value.rlike(r"(?i)^https?://\S+$"), whole).when(value.rlike(r"(?i)https?://\S+"), "[REDACTED_URL_TEXT]").otherwise(F.substring(value, 1, LONGEST))
    return F.when(value.rlike(SECRET), REDACTED).otherwise(kept)


def safe_fields(fields: Column) -> Column:
    """``map<string, string>`` with every value safe, and those of forbidden names behind a mark."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(FORBIDDEN), REDACTED).otherwise(safe_value(v)))


_FORBIDDEN, _SECRET, _SIGNED = re.compile(FORBIDDEN), re.compile(SECRET), re.compile(SIGNED)


def _text(value: str) -> str:
    if _SECRET.search(value):
        return REDACTED
    if re.match(r"(?i)https?://\S+$", value):
        try:
            parts = urlsplit(value)
            where = f"{parts.scheme.lower()}://{parts.netloc.rpartition('@')[2].lower()}{parts.path}"
        except ValueError:
            return REDACTED
        if "@" in parts.netloc or _SIGNED.search(f"?{parts.query}"):
            return "[REDACTED_SIGNED_URL]"
        return f"{where}?{REDACTED}" if re.search("[?#]", value) else value[:LONGEST]
    return "[REDACTED_URL_TEXT]" if re.search(r"(?i)https?://\S+", value) else value[:LONGEST]


def safe_tree(value, depth: int = 0):
    """A decoded document as telemetry may hold it: forbidden keys and unsafe texts behind marks, what is too deep or too much left out."""
    if depth > DEPTH:
        return "[TRUNCATED]"
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, list):
        return [safe_tree(v, depth + 1) for v in value[:KEYS]]
    if isinstance(value, dict):
        return {k: REDACTED if _FORBIDDEN.search(k) else safe_tree(v, depth + 1) for k, v in [*value.items()][:KEYS]}
    return value


@F.pandas_udf(StringType())
def _safe_documents(documents: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(safe_tree(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return documents.map(one)


def redact_nested(document: Column) -> Column:
    """A JSON document as telemetry may hold it, rewritten and put together again; null where it is malformed. Below six levels stands ``[TRUNCATED]``, beyond a hundred keys or
    elements nothing. A tree of any shape is beyond column expressions, so batches of documents go through one small function."""
    return _safe_documents(document)
