"""Text functions on columns. All but NFKC and entity decoding are Catalyst expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegraph.functions import dictionaries as D


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no such function. ASCII values are passed on."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """HTML entities decoded, then NFKC."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def lit_map(values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    """White space runs to one space, trimmed; blank stays blank."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def fold(c: Column) -> Column:
    """Case folding: lower case and sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def match_key(c: Column, normalized: bool = False) -> Column:
    """NFKC, dotted and dotless i as i, folded, collapsed. normalized: c is in NFKC already."""
    return collapse(fold(F.translate(c if normalized else nfkc(c), "İIı", "iii")))


def query_key(c: Column, normalized: bool = False) -> Column:
    """T5: as match_key, but i stays as it is."""
    return collapse(fold(c if normalized else nfkc(c)))


def clean(c: Column, unicode: bool = True) -> Column:
    """NFKC (unless unicode is False), collapsed, blank to null."""
    return bound(collapse(nfkc(c) if unicode else c), blank_to_null)


def clean_posting(c: Column) -> Column:
    """A posting's text with its markup as lines and bullets."""
    t = unescaped(F.coalesce(c, F.lit("")))
    for pattern, into in [
        (r"(?i)<li[^>]*>", "\n- "),
        (r"(?i)</li>", "\n"),
        (r"(?i)</?(?:p|div|ul|ol|br|h[1-6]|section|article|tr|td|table)[^>]*>", "\n"),
        (r"<[^>]+>", ""),
        (r"\r\n?", "\n"),
        (r"(?U)(?:[^\S\n]|[\x1c-\x1f])+", " "),
        (r"(?md)^ | $", ""),
        (r"(?mdU)^(?:[-*•▪◦]|\d+[.)])[^\S\n]*", "- "),
        (r"\n{3,}", "\n\n"),
        (r"\A\s+|\s+\z", ""),
    ]:
        t = F.regexp_replace(t, pattern, into)
    return t


def distinct_by_key(arr: Column, key=match_key, limit: int | None = None) -> Column:
    """T4: the first value of each key, in order, blanks dropped; limit counts what is kept."""
    trimmed = F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(trimmed, lambda x: key(x))
    chosen = F.filter(trimmed, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)
    return F.slice(chosen, 1, limit) if limit else chosen


def ascii_key(x: Column) -> Column:
    """match_key for values in NFKC, usable inside higher-order functions."""
    return match_key(x, normalized=True)


def person_name(c: Column, honorific: bool = True, placeholders: Sequence[str] = D.PLACEHOLDER_NAMES) -> Column:
    """A result's title as a person's name; placeholders are null."""
    n = clean(c)
    for pattern in [r"(?i)\s*(?:[-|]\s*LinkedIn)\s*$", r"(?i)\s+adl[ıi]\s+kullan[ıi]c[ıi]n[ıi]n\s+profili\s*$", *([r"(?i)^(?:dr\.?|mr\.?|ms\.?|mrs\.?)\s+"] if honorific else [])]:
        n = F.regexp_replace(n, pattern, "")
    n = clean(n, unicode=False)
    return bound(n, lambda n: F.when(~fold(n).isin(list(placeholders)), n))


def location_parts(c: Column, cities: Mapping[str, str] = D.CITIES, countries: Mapping[str, str] = D.COUNTRIES) -> Column:
    """Struct of location_raw, city, country."""

    def parts(raw: Column) -> Column:
        pieces = F.filter(F.transform(F.split(fold(raw), ","), lambda x: F.trim(x)), lambda x: x != "")
        named = lambda pieces, table: F.try_element_at(F.filter(F.transform(pieces, lambda x: F.try_element_at(lit_map(table), x)), lambda x: x.isNotNull()), F.lit(1))
        return bound(pieces, lambda p: F.struct(raw.alias("location_raw"), named(p, cities).alias("city"), named(p, countries).alias("country")))

    return bound(clean(c), parts)


def headline_parts(c: Column) -> Column:
    """Struct of headline, title, company, confidence."""
    h = collapse(F.regexp_replace(clean(c), r"(?i)\s*(?:\||-)\s*LinkedIn\s*$", ""))
    at = r"(?i)^(.+?)\s+(?:at|@)\s+([^|]+)$"

    def parts(x: Column) -> Column:
        h, found, bar = x["h"], x["found"], x["bar"]
        student = fold(h).contains("student") | fold(h).contains("öğrenci")
        return F.struct(
            h.alias("headline"),
            F.when(found, bound(collapse(F.regexp_extract(h, at, 1)), blank_to_null)).when(bar, bound(collapse(F.split(h, r"\|", 2)[0]), blank_to_null)).alias("title"),
            F.when(found, bound(collapse(F.regexp_extract(h, at, 2)), blank_to_null)).alias("company"),
            F.when(h.isNull(), 0.0).when(found, 0.95).when(bar, 0.7).when(student, 0.4).otherwise(0.3).alias("confidence"),
        )

    found = lambda h: F.struct(h.alias("h"), h.rlike(at).alias("found"), h.contains("|").alias("bar"))
    return bound(h, lambda h: bound(blank_to_null(h), lambda h: bound(found(h), parts)))


def title_parts(c: Column) -> Column:
    """Struct of name, headline from a search result's title."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(clean(c, False), r"(?i)\s*(?:\||-)\s*LinkedIn\s*$", "")), r"(?i)\s+adlı kullanıcının profili\s*$", ""))
    parts = F.filter(F.transform(F.split(t, " - "), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.when(F.size(parts).between(1, 3), parts[0]).alias("name"), F.when(F.size(parts).between(2, 3), F.get(parts, F.lit(1))).alias("headline"))


def place_in(c: Column, places: Sequence[str] = D.SNIPPET_PLACES) -> Column:
    """The first of the places that the text mentions."""
    return F.coalesce(*(F.when(F.contains(fold(c), fold(F.lit(p))), F.lit(p)) for p in places))


def month_date(c: Column, months: Mapping[str, str] = D.MONTHS) -> Column:
    """The first four digits as year, the first listed month name, day 1."""
    names, year = list(months), F.regexp_extract(c, r"(\d{4})", 1)
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    listed = F.array_min(F.transform(words, lambda w: F.try_element_at(lit_map({n: i for i, n in enumerate(names, 1)}), w)))
    month = F.coalesce(F.try_element_at(F.array(*(F.lit(int(months[n])) for n in names)), listed), F.lit(1))
    return F.when(year != "", F.make_date(F.try_to_number(year, F.lit("9999")).cast("int"), month, F.lit(1)))


def date_range(c: Column, present: Sequence[str] = D.PRESENT_WORDS) -> Column:
    """Struct of start_date, end_date, is_current, warnings."""
    raw = F.trim(F.coalesce(c, F.lit("")))

    def halves(raw: Column) -> Column:
        parts = F.split(raw, r"\s+[–—-]\s+", 2)
        second = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        return F.struct(raw.alias("raw"), F.get(parts, F.lit(0)).alias("first"), second.alias("second"), fold(second).isin(list(present)).alias("current"))

    dates = lambda h: F.struct(h.alias("h"), month_date(h["first"]).alias("start"), F.when(~h["current"], month_date(h["second"])).alias("end"))

    def made(d: Column) -> Column:
        raw, second, current, start, end = d["h"]["raw"], d["h"]["second"], d["h"]["current"], d["start"], d["end"]
        warn = F.array_compact(F.array(F.when(start.isNull(), F.lit("date_parse_failed")), F.when((raw != "") & ~current & (F.trim(second) != "") & end.isNull(), F.lit("date_parse_failed")), F.when(end < start, F.lit("invalid_date_range"))))
        return F.struct(start.alias("start_date"), end.alias("end_date"), (current & (raw != "")).alias("is_current"), warn.alias("warnings"))

    return bound(raw, lambda raw: bound(halves(raw), lambda h: bound(dates(h), made)))


def endorsements(c: Column) -> Column:
    """T19."""
    return F.regexp_extract(F.lower(c), r"\b(\d+)\s+(?:endorsements?|yetenek onayı)", 1).try_cast("int")


def degree_and_field(c: Column) -> Column:
    """Split at the first comma."""
    parts = F.split(c, ",", 2)
    return F.struct(blank_to_null(F.trim(F.get(parts, F.lit(0)))).alias("degree"), blank_to_null(F.trim(F.get(parts, F.lit(1)))).alias("field"))


def unique_lines(c: Column) -> Column:
    """T21."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), collapse), lambda x: x != ""))


def fingerprint(*cols: Column, missing: str = "", length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of the values joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit(missing)) for c in cols)), 256), 1, length)


def redacted(m: Column, keys: Sequence[str] = D.SENSITIVE_KEYS) -> Column:
    """A map's values under sensitive keys hidden."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(list(keys)), F.lit("[REDACTED]")).otherwise(v))


def evidence_ok(c: Column, most: int = 2000) -> Column:
    """Short enough, and no whole HTML document. Characters of at most four bytes are counted only where the bytes, whose number is at hand, allow it."""
    return c.isNull() | ((F.octet_length(c) <= 4 * most) & (F.length(c) <= most) & ~F.lower(c).contains("<html") & ~F.lower(c).contains("<!doctype html"))
