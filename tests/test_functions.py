import datetime

import pytest
from pyspark.sql import functions as F

from rolegraph.functions import text as X
from rolegraph.functions import urls as U


def one(spark, expression, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://TR.linkedin.com/in/Ada-1/?trk=x", ("https://www.linkedin.com/in/Ada-1", "linkedin.com", "Ada-1")),
        ("https://Example.com//a//b/?utm_source=1&q=2&ref=3#f", ("https://example.com/a/b?q=2", "example.com", None)),
        ("https://x.com:443/%7Eu", ("https://x.com/~u", "x.com", None)),
        ("https://x.com?b=", ("https://x.com/?b=", "x.com", None)),
        ("http://bücher.de/x y", ("http://xn--bcher-kva.de/x%20y", "xn--bcher-kva.de", None)),
        ("ftp://x.y/a", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_canonical_url(spark, url, want):
    got = one(spark, U.canonical_url(F.col("c0")), url)
    assert (got.url, got.domain or None, got.slug or None) == want


def test_target_domain(spark):
    assert one(spark, U.target_domain(F.col("c0")), " https://LinkedIn.com//in/ ") == "linkedin.com/in"
    assert one(spark, U.target_domain(F.col("c0")), "a.b?c=1") is None


@pytest.mark.parametrize("value, want", [("Dr. Ada Byron | LinkedIn", "Ada Byron"), ("Ada adlı kullanıcının profili", "Ada"), ("LinkedIn Member", None), ("  ", None), (None, None), ("Ada  - LinkedIn", "Ada")])
def test_person_name(spark, value, want):
    assert one(spark, X.person_name(F.col("c0")), value) == want


@pytest.mark.parametrize("value, want", [("Bursa, Turkey", ("Bursa", "Turkey")), ("Türkiye", (None, "Turkey")), ("x, İstanbul", ("Istanbul", None)), (None, (None, None)), ("Paris", (None, None))])
def test_location(spark, value, want):
    got = one(spark, X.location_parts(F.col("c0")), value)
    assert (got.city, got.country) == want


@pytest.mark.parametrize("value, want", [("Engineer at Acme", ("Engineer", "Acme", 0.95)), ("A | B", ("A", None, 0.7)), ("a student", (None, None, 0.4)), ("x", (None, None, 0.3)), (None, (None, None, 0.0))])
def test_headline(spark, value, want):
    got = one(spark, X.headline_parts(F.col("c0")), value)
    assert (got.title, got.company, got.confidence) == want


def test_result_title(spark):
    got = one(spark, X.title_parts(F.col("c0")), "Ada Byron - Engineer - Acme | LinkedIn")
    assert (got.name, got.headline) == ("Ada Byron", "Engineer")


@pytest.mark.parametrize(
    "value, want",
    [
        ("Oca 2020 - Günümüz", (datetime.date(2020, 1, 1), None, True, [])),
        ("Mar 2019 – Jan 2018", (datetime.date(2019, 3, 1), datetime.date(2018, 1, 1), False, ["invalid_date_range"])),
        ("foo", (None, None, False, ["date_parse_failed"])),
        (None, (None, None, False, ["date_parse_failed"])),
    ],
)
def test_date_range(spark, value, want):
    got = one(spark, X.date_range(F.col("c0")), value)
    assert (got.start_date, got.end_date, got.is_current, got.warnings) == want


def test_posting_text(spark):
    html = "<ul><li>a&amp;b</li></ul>\r\n\r\n\r\n•  x <b>y</b>\n 1) z"
    assert one(spark, X.clean_posting(F.col("c0")), html) == "- a&b\n\n- x y\n- z"


def test_keys(spark):
    assert one(spark, X.match_key(F.col("c0")), " İSTANBUL Straße ｘ ") == "istanbul strasse x"
    assert one(spark, X.distinct_by_key(F.split("c0", ","), X.ascii_key, 2), "Ab, aB,,c ,d") == ["Ab", "c"]
    assert one(spark, X.unique_lines(F.col("c0")), "a  b\n\na b\nc") == ["a b", "c"]


def test_small_parts(spark):
    assert one(spark, X.endorsements(F.col("c0")), "12 endorsements") == 12
    assert tuple(one(spark, X.degree_and_field(F.col("c0")), "BSc, Physics, x")) == ("BSc", "Physics, x")
    assert one(spark, X.redacted(F.create_map(F.lit("Email"), F.col("c0"), F.lit("a"), F.col("c0"))), "v") == {"Email": "[REDACTED]", "a": "v"}
    assert one(spark, X.evidence_ok(F.col("c0")), "<HTML>") is False
    assert len(one(spark, X.fingerprint(F.col("c0"), F.lit(None)), "v")) == 24
    assert one(spark, X.place_in(F.col("c0")), "in ANKARA today") == "Ankara"
    assert one(spark, U.safe_href(F.col("c0")), "javascript:x") is None
    assert one(spark, U.search_url(F.col("c0"), "b?q="), 'a "b"') == "b?q=a+%22b%22"
    assert one(spark, U.source_url(F.col("c0")), "HTTPS://X.com/A/?q=1#f") == "https://x.com/A?q=1"


URLS = [
    ("https://www.linkedin.com/in/example-name/", "https://www.linkedin.com/in/example-name", "example-name"), ("https://tr.linkedin.com/in/example-name?trk=abc#section", "https://www.linkedin.com/in/example-name", "example-name"),
    ("HTTPS://Example.COM:443/a//b/?utm_source=x&page=2#fragment", "https://example.com/a/b?page=2", None), ("https://münich.example/kişiler/demo", "https://xn--mnich-kva.example/ki%C5%9Filer/demo", None),
    *((u, None, None) for u in ("", "not a url", "javascript:alert(1)", "mailto:test@example.com", "/relative/path", "https://example.com:invalid/path", "http://a..b/", "http://h.example:70000/", None)),
    ("https://linkedin.com/company/example", "https://linkedin.com/company/example", None), ("https://example.com/profile?trackingId=x&tab=activity&refId=y", "https://example.com/profile?tab=activity", None),
    ("https://linkedin.com/in/a+b", "https://www.linkedin.com/in/a%2Bb", "a+b"), ("https://linkedin.com/in/a(b)", "https://www.linkedin.com/in/a%28b%29", "a(b)"), ("https://linkedin.com/in/J%C3%BCrgen%20x/", "https://www.linkedin.com/in/J%C3%BCrgen%20x", "Jürgen x"),
    ("https://user:pw@ex.com/x", "https://ex.com/x", None), ("https://a@b:c@Ex.com:8443/x/", "https://ex.com:8443/x", None), ("https://user:@ex.com", "https://ex.com/", None), ("http://[::1]:8080/x", "http://::1:8080/x", None), ("http://a[b]/x", None, None), ("https://ex.com:/x", "https://ex.com/x", None),
    ("https://ex.com/a/b", "https://ex.com/a/b", None), ("https://ex.com/a//b", "https://ex.com/a/b", None), ("https://ex.com/a/?", "https://ex.com/a", None), ("https://" + "a" * 64 + ".com/x", None, None), ("https://linkedin.com/in/x", "https://www.linkedin.com/in/x", "x"),
    ("http://u:p@Host.example:8080", "http://host.example:8080/", None), ("http://h.example?b=1&a&=2&c=x=y z&d=a+b%2B", "http://h.example/?b=1&a=&=2&c=x%3Dy+z&d=a+b%2B", None), ("http://h.example/%zz/%7Euser/a%2Fb*", "http://h.example/%25zz/~user/a/b*", None),
    ("https://evil-linkedin.com/in/x", "https://evil-linkedin.com/in/x", None), ("https://LinkedIn.com/IN/X", "https://www.linkedin.com/in/X", "X"),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "i int, u string").repartition(2)
    got = {r.i: r.x for r in df.select("i", U.canonical_url(F.col("u")).alias("x")).collect()}
    for i, (u, url, slug) in enumerate(URLS):
        assert (got[i].url, got[i].slug) == (url, slug), u
