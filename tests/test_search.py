"""The grammar of a search, its facets, the four orders, and detail documents."""

import json
from datetime import datetime

import pytest

from sievewright.operators import search


def test_parameters():
    filters, facets = search.parse_parameters("limit=100&country=de&visa=true&skill=%20SQL%20&q=&min_compensation=10.5&currency=eur&workplace_mode=remote&first_seen_after=2024-01-01T02:00:00%2B02:00&compensation_period=year")
    assert (filters.limit, filters.least_compensation, filters.currency, filters.period, filters.equal, filters.q, filters.status) == (100, 10.5, "EUR", "year", {"workplace_mode": "remote"}, None, "active")
    assert facets == {"country": "DE", "skill": "SQL", "visa": "true"} and filters.seen_after == "2024-01-01 00:00:00.000000"
    refused = {"limit=101": "invalid_page_size", "limit=0": "invalid_page_size", "limit=x": "invalid_page_size", "limit=1.5": "invalid_page_size", "q=a&q=b": "duplicate_query_parameter", "offset=2": "unknown_query_parameter", "sort=relevance": "relevance_requires_query", "q=" + "x" * 201: "invalid_query", "country=deu": "invalid_query"}
    refused |= {"currency=eu": "invalid_query", "visa=yes": "invalid_query", "min_compensation=-1": "invalid_query", "min_compensation=1000000001": "invalid_query", "status=open": "invalid_query", "sort=newest": "invalid_query", "company_id=7": "invalid_query", "first_seen_after=soon": "invalid_query", "workplace_mode=x": "invalid_query", "cursor=" + "x" * 2049: "invalid_cursor", "region=" + "x" * 121: "invalid_query"}
    for query, code in refused.items():
        with pytest.raises(ValueError, match=code):
            search.parse_parameters(query)


ITEMS = "id int, title string, company int, company_name string, tokens array<string>, status string, first_seen timestamp_ntz, posted timestamp_ntz"


@pytest.fixture(scope="module")
def items(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [(1, "a", 1, "x", ["big", "data"], "active", at(3), None), (2, "b", 1, "x", ["data"], "active", at(1), at(9)), (3, "c", 2, "y", ["data", "data"], "active", at(3), at(5)), (4, "d", 2, "y", ["other"], "closed", at(9), at(1))]
    return spark.createDataFrame(rows, ITEMS)


def test_the_four_orders(spark, items):
    pay = spark.createDataFrame([(1, 5.0, "EUR", "year"), (3, 9.0, "USD", "year"), (3, 1.0, "EUR", "year")], "id int, amount double, currency string, period string")
    page = lambda query, **k: [r["id"] for r in search.search(items, search.parse_parameters(query)[0], **k).collect()]
    assert page("sort=first_seen_desc") == [3, 1, 2] and page("status=all") == [4, 3, 1, 2]
    assert page("sort=source_posted_desc") == [2, 3, 1]
    assert page("sort=compensation_desc", compensation=pay) == [3, 1, 2] and page("sort=compensation_desc&currency=EUR", compensation=pay) == [1, 3]
    assert page("sort=relevance&q=data") == [3, 2, 1]


def test_facets(spark, items):
    locations = spark.createDataFrame([(1, "DE", "Bayern", True), (2, "DE", "Berlin", False), (3, "FR", None, True)], "id int, country string, region string, remote_eligible boolean")
    skills, languages = spark.createDataFrame([(1, "SQL"), (3, "sql")], "id int, skill string"), spark.createDataFrame([(2, "en")], "id int, language string")
    assertions = spark.createDataFrame([(1, "/visa_sponsorship", "true"), (2, "/visa_sponsorship", "false"), (3, "/other", "true")], "id int, path string, value string")

    def page(query):
        filters, wanted = search.parse_parameters(query)
        return sorted(r["id"] for r in search.search(items, filters, facets=search.facet_tables(wanted, locations, skills, languages, assertions)).collect())

    assert [page(q) for q in ("country=de", "eligible_country=DE", "region=BAYERN", "skill=Sql", "language=EN", "visa=true", "visa=false", "country=de&skill=sql", "country=us")] == [[1, 2], [1], [1], [1, 3], [2], [1], [2], [1], []]


def test_detail_documents(spark):
    items = spark.createDataFrame([(1, "A", None), (2, "B", "x")], "id int, title string, note string")
    places = spark.createDataFrame([(1, "R2", "FR"), (1, "R1", "FR"), (1, "R9", "DE")], "id int, region string, country string")
    skills = spark.createDataFrame([(2, "sql"), (2, "c")], "id int, skill string")
    got = {r["id"]: json.loads(r.record) for r in search.detail_documents(items, {"locations": (places, ["country", "region"]), "skills": (skills, ["skill"])}).collect()}
    assert got == {
        1: {"id": 1, "title": "A", "note": None, "locations": [{"region": "R9", "country": "DE"}, {"region": "R1", "country": "FR"}, {"region": "R2", "country": "FR"}], "skills": []},
        2: {"id": 2, "title": "B", "note": "x", "locations": [], "skills": [{"skill": "c"}, {"skill": "sql"}]},
    }
