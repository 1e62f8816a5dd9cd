"""Faceted, full-text and fuzzy search with keyset pages."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.digests import decode_cursor, encode_cursor
from sievewright.functions.text import jaccard, like_escape, trigrams, words
from sievewright.operators.relational import spread_join

SORTS = ("first_seen_desc", "source_posted_desc", "relevance", "compensation_desc")
STATUSES = ("active", "possibly_closed", "closed", "all")
FUZZY = 0.3


@dataclass
class Filters:
    """A parsed search: what is None is not filtered."""

    q: str | None = None
    company: str | None = None
    title: str | None = None
    equal: dict = field(default_factory=dict)
    seen_after: str | None = None
    posted_after: str | None = None
    least_compensation: float | None = None
    currency: str | None = None
    period: str | None = None
    status: str = "active"
    sort: str = "first_seen_desc"
    limit: int = 25
    cursor: str | None = None

    def __post_init__(self):
        if self.status not in STATUSES or self.sort not in SORTS:
            raise ValueError("invalid_query")
        if not 1 <= self.limit <= 100:
            raise ValueError("invalid_page_size")
        if self.sort == "relevance" and not self.q:
            raise ValueError("relevance_requires_query")
        if any(len(x) > 200 for x in (self.q, self.title) if x):
            raise ValueError("invalid_query")


def parse_web_query(q: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (negated, words): bare words are all needed, ``or`` separates, quotes hold a phrase, a minus negates."""
    import re

    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q):
        if not phrase and not minus and word.lower() == "or":
            out.append([])
            continue
        terms = re.findall(r"[^\W_]+", (phrase or word).lower())
        if terms:
            out[-1].append((bool(minus), terms))
    return [x for x in out if x]


def _has_phrase(tokens: Column, terms: list[str]) -> Column:
    if len(terms) == 1:
        return F.array_contains(tokens, terms[0])
    wanted = F.array(*map(F.lit, terms))
    starts = F.sequence(F.lit(1), F.size(tokens) - len(terms) + 1)
    return F.when(F.size(tokens) >= len(terms), F.exists(starts, lambda i: F.slice(tokens, i, len(terms)) == wanted)).otherwise(F.lit(False))


def matches(tokens: Column, q: str) -> Column:
    """Whether a token array satisfies a web query; a query without words matches nothing."""
    out = F.lit(False)
    for group in parse_web_query(q):
        one = F.lit(True)
        for minus, terms in group:
            hit = _has_phrase(tokens, terms)
            one = one & (~hit if minus else hit)
        out = out | one
    return out


def rank(tokens: Column, q: str) -> Column:
    """Share of a text's tokens that are words of the query; 0 for a text without tokens."""
    wanted = sorted({t for group in parse_web_query(q) for minus, terms in group if not minus for t in terms})
    hits = F.size(F.filter(tokens, lambda t: t.isin(wanted))) if wanted else F.lit(0)
    return F.when(F.size(tokens) > 0, F.round(hits / F.size(tokens), 6)).otherwise(F.lit(0.0))


def similar(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def contains(column: Column, part: str) -> Column:
    """Case-insensitive substring; wildcards in it stand for themselves."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def like_pattern(part: Column) -> Column:
    return F.concat(F.lit("%"), like_escape(part), F.lit("%"))


def search(items: DataFrame, filters: Filters, compensation: DataFrame | None = None, facets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``items(id, title, company, company_name, tokens, status, first_seen, posted, ...)`` -> one page and a row more.

    Only filters that are set become predicates. ``compensation(id, amount, currency, period)`` gives the best amount
    and, with the bounds on one row, the compensation filters; ``facets`` are tables ``(id)`` that the item must be in.
    """
    out = items
    if filters.status != "all":
        out = out.where(F.col("status") == filters.status)
    if filters.company is not None:
        out = out.where(F.col("company") == filters.company)
    for column, value in filters.equal.items():
        out = out.where(F.col(column) == value)
    if filters.title:
        out = out.where(contains(F.col("title"), filters.title))
    if filters.seen_after:
        out = out.where(F.col("first_seen") >= F.lit(filters.seen_after).cast("timestamp_ntz"))
    if filters.posted_after:
        out = out.where(F.col("posted") >= F.lit(filters.posted_after).cast("timestamp_ntz"))
    if filters.q:
        fuzzy = (similar(F.col("title"), F.lit(filters.q)) >= FUZZY) | (similar(F.col("company_name"), F.lit(filters.q)) >= FUZZY)
        out = out.where(matches(F.col("tokens"), filters.q) | fuzzy)
        out = out.withColumn("relevance", F.when(matches(F.col("tokens"), filters.q), rank(F.col("tokens"), filters.q)).otherwise(F.lit(0.0)))
    for facet in (facets or {}).values():
        out = out.join(facet.select("id").distinct(), "id", "left_semi")
    if compensation is not None:
        wanted = compensation
        if filters.currency:
            wanted = wanted.where(F.col("currency") == filters.currency)
        if filters.period:
            wanted = wanted.where(F.col("period") == filters.period)
        if filters.least_compensation is not None:
            wanted = wanted.where(F.col("amount") >= filters.least_compensation)
        best = wanted.groupBy("id").agg(F.max("amount").alias("best_amount"))
        bounded = filters.currency or filters.period or filters.least_compensation is not None
        out = out.join(best, "id", "inner" if bounded else "left")
    sort = {"first_seen_desc": F.col("first_seen"), "source_posted_desc": F.coalesce(F.col("posted"), F.lit("1970-01-01").cast("timestamp_ntz")), "compensation_desc": F.coalesce(F.col("best_amount"), F.lit(-1.0)) if compensation is not None else F.lit(-1.0), "relevance": F.col("relevance") if filters.q else F.lit(0.0)}[filters.sort]
    from sievewright.operators.relational import keyset_page

    after = None
    if filters.cursor:
        place = decode_cursor(filters.cursor, "items", asdict(filters))
        after = (place["primary"], place["id"])
    return keyset_page(out.withColumn("sort_value", sort), F.col("sort_value"), "id", filters.limit, after)


def page_of(rows: list, filters: Filters) -> tuple[list, str | None]:
    """The rows of a page and the cursor of the next one, from a page and a row more."""
    if len(rows) <= filters.limit:
        return rows, None
    last = rows[filters.limit - 1]
    primary = last["sort_value"]
    return rows[: filters.limit], encode_cursor("items", asdict(filters), primary if isinstance(primary, (int, float, str)) else str(primary), last["id"])


# The parameters of a search, and what some of them may be.
PARAMETERS = (
    "q", "company_id", "title", "country", "region", "workplace_mode", "eligible_country", "employment_type", "seniority", "skill", "language", "visa", "min_compensation",
    "currency", "compensation_period", "first_seen_after", "source_posted_after", "status", "sort", "cursor", "limit",
)
MODES, PAY_PERIODS = ("remote", "hybrid", "onsite", "unspecified"), ("hour", "day", "week", "month", "year")
_LONGEST = {"q": 200, "title": 200, "region": 120, "employment_type": 80, "seniority": 80, "skill": 100, "language": 40, "cursor": 2_048}
_ID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


def parse_parameters(query: str) -> tuple[Filters, dict]:
    """A URL's query string -> filters, and the facets that it asks for by name; ``ValueError`` with a code for what is not allowed.

    Values are trimmed, empty ones count as not given; a parameter comes once; countries and currencies are upper-cased, times are ISO.
    """
    import re
    from datetime import UTC, datetime
    from urllib.parse import parse_qsl

    given: dict[str, str] = {}
    for name, value in parse_qsl(query, keep_blank_values=True):
        if name not in PARAMETERS:
            raise ValueError("unknown_query_parameter")
        if name in given:
            raise ValueError("duplicate_query_parameter")
        given[name] = value.strip()
    found = {name: value for name, value in given.items() if value}

    def checked(name: str, right) -> str | None:
        value = found.get(name)
        if value is not None and not right(value):
            raise ValueError("invalid_query")
        return value

    def moment(name: str) -> str | None:
        value = found.get(name)
        if value is None:
            return None
        try:
            at = datetime.fromisoformat(value)
        except ValueError:
            raise ValueError("invalid_query") from None
        return (at.astimezone(UTC) if at.tzinfo else at).strftime("%Y-%m-%d %H:%M:%S.%f")

    def number(name: str) -> float | None:
        value = checked(name, lambda x: re.fullmatch(r"\d+(\.\d+)?", x))
        if value is not None and float(value) > 1_000_000_000:
            raise ValueError("invalid_query")
        return None if value is None else float(value)

    for name, most in _LONGEST.items():
        if len(found.get(name, "")) > most:
            raise ValueError("invalid_cursor" if name == "cursor" else "invalid_query")
    for name in ("country", "eligible_country", "currency"):
        if name in found:
            found[name] = found[name].upper()
            checked(name, re.compile("[A-Z]{3}" if name == "currency" else "[A-Z]{2}").fullmatch)
    limit = found.get("limit", "25")
    if not re.fullmatch(r"\d{1,9}", limit):
        raise ValueError("invalid_page_size")
    equal = {"workplace_mode": checked("workplace_mode", MODES.__contains__), "employment_type": found.get("employment_type"), "seniority": found.get("seniority")}
    visa = checked("visa", ("true", "false").__contains__)
    facets = {name: found[name] for name in ("country", "eligible_country", "region", "skill", "language") if name in found}
    if visa:
        facets["visa"] = visa
    filters = Filters(
        q=found.get("q"), company=checked("company_id", lambda x: re.fullmatch(_ID, x)), title=found.get("title"), equal={k: v for k, v in equal.items() if v}, seen_after=moment("first_seen_after"), posted_after=moment("source_posted_after"),
        least_compensation=number("min_compensation"), currency=found.get("currency"), period=checked("compensation_period", PAY_PERIODS.__contains__), status=found.get("status", "active"), sort=found.get("sort", "first_seen_desc"), limit=int(limit), cursor=found.get("cursor"),
    )
    return filters, facets


def facet_tables(wanted: dict, locations: DataFrame, skills: DataFrame, languages: DataFrame, assertions: DataFrame) -> dict[str, DataFrame]:
    """Facets by name -> the ids that have them, for :func:`search`: ``locations(id, country, region, remote_eligible)``, ``skills(id, skill)``, ``languages(id, language)``, ``assertions(id, path, value)``.

    Regions, skills and languages are compared whatever their case; a country must be eligible for remote work where that is asked; ``visa`` is an assertion's JSON value.
    """
    folded = lambda column, value: F.lower(column) == value.lower()
    rules = {
        "country": lambda v: locations.where(F.col("country") == v),
        "eligible_country": lambda v: locations.where(F.col("remote_eligible") & (F.col("country") == v)),
        "region": lambda v: locations.where(folded(F.col("region"), v)),
        "skill": lambda v: skills.where(folded(F.col("skill"), v)),
        "language": lambda v: languages.where(folded(F.col("language"), v)),
        "visa": lambda v: assertions.where((F.col("path") == "/visa_sponsorship") & (F.col("value") == v)),
    }
    return {name: rules[name](value).select("id") for name, value in wanted.items()}


def detail_documents(items: DataFrame, children: dict[str, tuple], shared: dict[str, str] | None = None) -> DataFrame:
    """Items with a ``record`` each: a JSON document of their own columns and of lists of their children, empty where they have none.

    ``children`` names tables with an ``id`` column and the columns that sort them; their other columns make up the entries. Each table is grouped once and joined, whatever the number of items;
    an item's children are few. ``shared`` names the children that many items have alike, with the column of ``items`` whose value is their ``id`` (null: none): such a list is made once for all its
    items, whose records are then written by many tasks.
    """
    shared = shared or {}
    out, names = items, [c for c in items.columns if c != "id" and c not in shared.values()]
    for name in sorted(children, key=lambda n: n in shared):
        table, order = children[name]
        values = [c for c in table.columns if c != "id"]
        rest = [c for c in values if c not in order]
        lists = table.groupBy("id").agg(_entries(F.struct(*order, *rest), values).alias(f"_{name}"))
        if name in shared:
            key = shared[name]
            with_list = spread_join(out.where(F.col(key).isNotNull()), lists.where("id is not null").withColumnRenamed("id", key), key, "id", outer=True)
            kind = lists.schema[f"_{name}"].dataType
            out = with_list.unionByName(out.where(F.col(key).isNull()).withColumn(f"_{name}", F.lit(None).cast(kind)))
        else:
            out = out.join(lists, "id", "left")
        kind = table.select(F.array(F.struct(*values)).alias("x")).schema["x"].dataType
        out = out.withColumn(f"_{name}", F.coalesce(f"_{name}", F.from_json(F.lit("[]"), kind)))
    record = F.to_json(F.struct("id", *names, *[F.col(f"_{name}").alias(name) for name in children]), {"ignoreNullFields": "false"})
    return out.select("id", record.alias("record"))


def _entries(entry: Column, values: list[str]) -> Column:
    """Collected entries in the order of their first fields, their fields as the table has them."""
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*[e[c].alias(c) for c in values]))
