"""Text functions: cleaning, normal forms, similarity sets, classifiers."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Control and bidirectional marks that cleaning removes.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
# Patterns of employment types in five languages; the first that matches gives the type. Words end at ASCII word marks.
EMPLOYMENT = (
    ("full[- ]?time|temps plein|tiempo completo|vollzeit|permanent", "full_time"),
    ("part[- ]?time|temps partiel|medio tiempo|teilzeit", "part_time"),
    ("contract|contractor|freelance|consultant|cdd", "contract"),
    ("intern(ship)?|stage|stagiaire|praktikum", "internship"),
    ("temporary|temporaire|temporal", "temporary"),
)
REMOTE = "remote|anywhere|distributed|home[- ]?based|t[eé]l[eé]travail|remoto|remota|fernarbeit|homeoffice"


def _bounded(words: str) -> str:
    return f"(?iu)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"


#: Texts that are Python objects at one time; the rest of a batch stays in Arrow.
SLICE = 64


def _normal(form: str, texts: pa.Array) -> pa.Array:
    """Texts in a normal form, slice by slice: beside the batch and its result Python holds few texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = [pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return _normal("NFKC", texts)


@F.arrow_udf(StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    return _normal("NFKD", texts)


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return _normal("NFC", texts)


def composed(text: Column) -> Column:
    """Compatibility form; ASCII text is that already and is not sent to Python."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))


def clean(text: Column, limit: int = 1_000_000, normal: bool = True) -> Column:
    """Compatibility form without control marks, line ends as ``\\n``, blanks single, at most one empty line, trimmed, clipped."""
    x = nfkc(text) if normal else text
    x = F.regexp_replace(x, CONTROLS, "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[\t ]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(x, r"^\s+|\s+$", ""), 1, limit)


def search_title(text: Column) -> Column:
    """The form of a title that is searched: Latin letters without marks, lower case, punctuation as blanks."""
    x = F.regexp_replace(_nfkd(clean(text, 500)), r"(\p{IsLatin})\p{M}+", "$1")
    x = F.regexp_replace(F.lower(x), r"[\p{P}\p{S}]+", " ")
    return _nfc(F.trim(F.regexp_replace(x, r"\s+", " ")))


def company_name(text: Column) -> Column:
    """The form in which organisations' names are compared: letters and digits, single blanks."""
    x = F.regexp_replace(nfkc(text), r"[\x00-\x1F\x7F\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]", " ")
    x = F.regexp_replace(_nfkd(F.lower(x)), r"(\p{IsLatin})\p{M}+", "$1")
    return F.trim(F.regexp_replace(_nfc(x), r"[^\p{L}\p{N}]+", " "))


def ascii_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def identity_key(kind: Column, value: Column) -> Column:
    """Normal form of an identity key, null where it is not valid: a host name, ``connector:region:tenant``, or a name."""
    host = F.lower(F.regexp_replace(F.trim(value), r"\.$", ""))
    tenant = F.lower(F.trim(value))
    return (
        F.when(kind == "verified_domain", F.when(host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), host))
        .when(kind == "ats_tenant", F.when(tenant.rlike(r"^[a-z0-9][a-z0-9._-]{0,127}(:[a-z0-9][a-z0-9._-]{0,127}){2}$"), tenant))
        .otherwise(company_name(value))
    )


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def bigrams(name: Column) -> Column:
    return grams(F.concat(F.lit(" "), name, F.lit(" ")), 2)


def dice(a: Column, b: Column) -> Column:
    """Twice the common elements over all, four decimals; 0 if either set is empty."""
    both = 2 * F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.round(both / (F.size(a) + F.size(b)), 4))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.round(common / (F.size(a) + F.size(b) - common), 4))


def trigrams(text: Column) -> Column:
    """Trigrams of each lower-case word, padded by two blanks in front and one behind."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def employment_type(text: Column) -> Column:
    """The first type whose pattern matches, else the text as a slug; null for null or empty."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(EMPLOYMENT):
        out = F.when(text.rlike(_bounded(pattern)), F.lit(name)).otherwise(out)
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")
    return F.when(F.length(text) > 0, F.coalesce(out, slug))


def remote_eligible(label: Column) -> Column:
    return label.rlike(_bounded(REMOTE))


def workplace(explicit: Column, locations: Column) -> Column:
    """The explicit kind of workplace, else remote if any location's label says so."""
    return F.coalesce(explicit, F.when(F.exists(locations, remote_eligible), F.lit("remote")), F.lit("unspecified"))


def error_class(message: Column) -> Column:
    """Reason and whether to retry, by words of an error message."""
    low = F.lower(message)
    rules = (("429", "rate_limited", True), ("timeout", "timeout", True), ("403", "blocked", False), ("404", "not_found", False), ("schema", "schema_invalid", False), ("json", "invalid_json", False))
    out = F.struct(F.lit("unknown").alias("reason"), F.lit(True).alias("retryable"))
    for word, reason, again in reversed(rules):
        out = F.when(low.contains(word), F.struct(F.lit(reason).alias("reason"), F.lit(again).alias("retryable"))).otherwise(out)
    return out


def duration_bucket(milliseconds: Column) -> Column:
    return F.when(milliseconds < 1_000, "under_1s").when(milliseconds < 10_000, "1s_to_10s").when(milliseconds < 60_000, "10s_to_60s").otherwise("over_60s")


def clipped(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def escape_html(text: Column) -> Column:
    out = text
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(reference))
    return out


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<!--.*?(?:-->|\Z)|<[!?/][^>]*>?", re.S)
_BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article".split())


def visible(source: str | None) -> str | None:
    """Text of untrusted HTML: nested script and style suppressed, block ends as line ends, references decoded."""
    if source is None:
        return None
    out, hidden, at = [], [], 0
    for m in _TAG.finditer(source):
        if not hidden:
            out.append(source[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag in ("script", "style"):
            if not m[1]:
                hidden.append(tag)
            elif hidden:
                hidden.pop()
        elif tag in _BREAKS and not hidden:
            out.append("\n")
    if not hidden:
        out.append(source[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def html_to_text(sources: pd.Series) -> pd.Series:
    return sources.map(visible)
