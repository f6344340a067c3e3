"""Fields of stored HTML pages (S4, S5). Nothing is fetched."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rolegraph.functions import dictionaries as D
from rolegraph.functions import text as X
from rolegraph.functions.urls import safe_href

MOST_BYTES = 2 << 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSAFE = frozenset(("script", "style", "noscript"))
# Containers and snippets of result pages, and selectors of profile pages, first match first.
CONTAINERS, SNIPPETS = ["[data-result]", "article", ".result", ".g"], [".snippet", ".description", "p"]
SCOPES = {"top_card": ["section[data-section='top-card']", "#top-card", "main"], "about": ["section[data-section='about']", "#about", "section.about"]}
IDENTITY = {
    "full_name": ["h1[data-field='name']", "h1", ".top-card-name"],
    "headline": ["[data-field='headline']", ".headline", "div.text-body-medium"],
    "location_raw": ["[data-field='location']", ".location", "span.top-card-location"],
}
ABOUT = ["[data-field='about']", ".about-content", "div.description"]
OPEN_TO_WORK = ["[data-open-to-work='true']", "[aria-label*='Open to Work']", "[aria-label*='Açık']"]
SECTIONS = {
    "experience": (["section[data-section='experience']", "#experience", ".experience-list"], ["[data-experience-item]", ".experience-item", "li"]),
    "education": (["section[data-section='education']", "#education", ".education-list"], ["[data-education-item]", ".education-item", "li"]),
    "skills": (["section[data-section='skills']", "#skills", ".skills-list"], ["[data-skill-item]", ".skill-item", "li"]),
    "certifications": (["section[data-section='certifications']", "#certifications", ".certifications-list"], ["[data-certification-item]", ".certification-item", "li"]),
    "languages": (["section[data-section='languages']", "#languages", ".languages-list"], ["[data-language-item]", ".language-item", "li"]),
}
# Where an item's fields stand. @name is an attribute of the item; after selectors, @href is the node's link and @a that of the first link inside.
_NAME, _DATE, _COMPANY = "h3, h4", "[data-field='date'], .date-range, time", "[data-field='company'], .company-name, p.company"
ITEMS = {
    "experience": {"name": f"[data-field='title'], .position-title, {_NAME}", "key": "@data-external-key", "company": _COMPANY, "link": f"{_COMPANY}@a", "date": _DATE, "kind": "@data-employment-type", "skills": "@data-skills", "location": "[data-field='location'], .location", "description": "[data-field='description'], .description"},
    "education": {"name": f"[data-field='institution'], .institution, {_NAME}", "key": "@data-external-key", "degree": "[data-field='degree-field'], .degree-field, p.degree", "date": _DATE, "grade": "[data-field='grade'], .grade", "description": "[data-field='description'], .description"},
    "skills": {"name": f"[data-field='name'], .skill-name, {_NAME}", "all": "."},
    "certifications": {"name": f"[data-field='name'], .certification-name, {_NAME}", "issuer": "[data-field='issuer'], .issuer", "issued": "[data-field='issue-date'], .issue-date", "expires": "[data-field='expiration-date'], .expiration-date", "id": "[data-field='credential-id'], .credential-id", "link": "a[href]@href"},
    "languages": {"name": f"[data-field='name'], .language-name, {_NAME}", "proficiency": "[data-field='proficiency'], .proficiency"},
}


_FORM = re.compile(r"([a-z0-9]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?)='([^']*)')?\])?")


class Selectors:
    """Selectors compiled to look-ups by what they ask of an element, so that an element costs what its attributes do.

    Of the forms tag, .class, #id, [attr], [attr='value'], [attr*='part'] and tag with one of them.
    """

    def __init__(self, selectors: Iterable[str]):
        self.asked: dict[tuple[str, str], list[tuple[str, str, bool, str | None]]] = {}
        for s in dict.fromkeys(selectors):
            tag, name, ident, attr, part, value = _FORM.fullmatch(s).groups()
            kind, key = ("class", name) if name else ("id", ident) if ident else ("attr", attr) if attr else ("tag", tag)
            self.asked.setdefault((kind, key), []).append((s, tag, bool(part), value))

    def of(self, tag: str, attrs: Mapping[str, str | None]) -> Iterator[str]:
        """The selectors that an element fits."""
        keys = [("tag", tag), ("id", attrs.get("id") or ""), *(("class", c) for c in set((attrs.get("class") or "").split())), *(("attr", a) for a in attrs)]
        for k in keys:
            for s, wanted, part, value in self.asked.get(k, ()):
                if wanted and wanted != tag:
                    continue
                if k[0] != "attr" or value is None or (value in (attrs[k[1]] or "") if part else attrs[k[1]] == value):
                    yield s


class Page(HTMLParser):
    """One pass over a page, without scripts and styles; open tags close where they can.

    An element is its place in the page: those from i + 1 to last[i] lie inside element i. Its text is a piece of one
    buffer, so texts of nested elements are never copied. `hits` has the elements that fit each selector, in order.
    """

    def __init__(self, html: str, selectors: Selectors):
        super().__init__(convert_charrefs=True)
        self.selectors, self.hits, self.attrs = selectors, {}, {}
        self.pieces: list[bytes] = []
        self.offsets: list[int] = [0]  # where each piece begins in the buffer
        self.first, self.after, self.last, self.parent = [0], [0], [0], [0]
        self.stack, self.opened, self.hidden = [(0, "")], Counter(), 0
        self.feed(html)
        self.close()
        while self.stack:
            self._end()

    def _end(self) -> str:
        i, tag = self.stack.pop()
        self.after[i], self.last[i] = len(self.pieces), len(self.first)
        self.opened[tag] -= 1
        return tag

    def handle_starttag(self, tag, attrs):
        if tag in UNSAFE:
            self.hidden += 1
        elif not self.hidden:
            i, attrs = len(self.first), dict(attrs)
            self.first.append(len(self.pieces))
            self.after.append(len(self.pieces))
            self.last.append(i + 1)
            self.parent.append(self.stack[-1][0])
            for s in self.selectors.of(tag, attrs):
                self.hits.setdefault(s, []).append(i)
                self.attrs[i] = attrs
            if tag not in VOID:
                self.stack.append((i, tag))
                self.opened[tag] += 1

    def handle_endtag(self, tag):
        if tag in UNSAFE:
            self.hidden = max(0, self.hidden - 1)
        elif self.opened[tag] > 0:
            while self._end() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden and (piece := " ".join(data.split()).encode()):
            self.pieces.append(piece)
            self.offsets.append(self.offsets[-1] + len(piece) + 1)

    def body(self) -> bytes:
        return b" ".join(self.pieces)

    def span(self, i: int) -> tuple[int, int]:
        """Where an element's text begins in the body, and its bytes."""
        a, b = self.first[i], self.after[i]
        return (self.offsets[a], self.offsets[b] - 1 - self.offsets[a]) if b > a else (0, 0)

    def inside(self, i: int, selector: str) -> list[int]:
        """The elements inside i that fit a selector, in order."""
        own = self.hits.get(selector, [])
        return own[bisect_left(own, i + 1) : bisect_left(own, self.last[i])]

    def one(self, i: int, selectors: Iterable[str]) -> int | None:
        """The first element inside i that fits any of the selectors."""
        found = []
        for s in selectors:
            own = self.hits.get(s, [])
            at = bisect_left(own, i + 1)
            if at < len(own) and own[at] < self.last[i]:
                found.append(own[at])
        return min(found, default=None)

    def find(self, i: int, selectors: Iterable[str]) -> list[int]:
        """All elements inside i that fit the first selector that any fits."""
        return next((found for s in selectors if (found := self.inside(i, s))), [])

    def text(self, i: int) -> str | None:
        a, n = self.span(i)
        return self.body_of[a : a + n].decode() or None


#: Bytes of pages that are handed on at once.
STEP_BYTES = 4 << 20
LINK = "a[href]"
_RESULTS = Selectors([*CONTAINERS, *SNIPPETS, LINK])
_SPAN = "struct<at: int, bytes: int>"
RECORDS = f"page_id long, body binary, records array<struct<rank: int, url: string, named: string, title: {_SPAN}, snippet: {_SPAN}, boxed: boolean>>"


def _records(html: str) -> dict:
    """A result page's text, and its records as places in it: of each container with a link, or else of each link."""
    page = Page(html, _RESULTS)
    span = lambda i: None if i is None else dict(zip(("at", "bytes"), page.span(i), strict=True))

    def record(rank: int, link: int, snippet: int | None, boxed: bool) -> dict:
        own = page.attrs[link]
        return {"rank": rank, "url": own["href"], "named": own.get("title"), "title": span(link), "snippet": span(snippet), "boxed": boxed}

    boxes = sorted({i for s in CONTAINERS for i in page.inside(0, s)})
    found = [record(n, link, page.one(i, SNIPPETS), True) for n, i in enumerate(boxes, 1) if (link := page.one(i, [LINK])) is not None]
    found = found or [record(n, link, page.parent[link], False) for n, link in enumerate(page.inside(0, LINK), 1)]
    return {"body": page.body(), "records": found}


def _by_page(read: Callable[[str], dict], schema: str):
    """For mapInArrow: a row for each page, handed on every STEP_BYTES of text."""
    types = to_arrow_schema(T._parse_datatype_string(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, size = [], 0
            for i, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append({"page_id": i} | read(html.as_py() or ""))
                size += len(rows[-1]["body"])
                if size > STEP_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return run


def _text(body: Column, span: Column) -> Column:
    """A piece of the body; null for none and for an empty one."""
    return F.when(span["bytes"] > 0, F.decode(F.substring(body, span["at"] + 1, span["bytes"]), "UTF-8"))


def result_records(pages: DataFrame, most_bytes: int = MOST_BYTES, most_snippet: int | None = None) -> tuple[DataFrame, DataFrame]:
    """page_id, rank, url, title, snippet of stored result pages; and page_id, reject_reason of pages that give none.

    A container gives its first link and its first snippet. Where no container has a link, all links with a title
    of three characters or more count, with what stands around them. Python gives a row for each page, in memory linear
    in the page; texts are cut out row by row. most_snippet is a request's limit; without it snippets are whole.
    """
    large = F.octet_length("html") > most_bytes
    reason = F.when(F.col("html").isNull(), "empty_page").when(large, "page_too_large")
    rows = pages.filter(F.col("html").isNotNull() & ~large).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string")).mapInArrow(_by_page(_records, RECORDS), RECORDS)
    found = rows.select("page_id", "body", F.explode("records").alias("r")).select("page_id", "body", "r.*")
    found = found.withColumn("title", F.coalesce(_text(F.col("body"), F.col("title")), "named")).withColumn("text", _text(F.col("body"), F.col("snippet"))).filter(F.col("boxed") | (F.length(F.trim("title")) >= 3))
    at, around = F.instr("text", F.col("title")), F.coalesce("text", F.lit(""))
    rest = F.when(at > 0, F.concat(F.substr(around, F.lit(1), at - 1), F.substr(around, at + F.length("title")))).otherwise(around)
    snippet = F.when(F.col("boxed"), F.when(F.col("snippet").isNotNull(), around)).otherwise(F.nullif(F.trim(rest), F.lit("")))
    snippet = snippet if most_snippet is None else F.substring(snippet, 1, most_snippet)
    return found.select("page_id", "rank", "url", "title", snippet.alias("snippet")), pages.withColumn("reject_reason", reason).filter("reject_reason is not null").select("page_id", "reject_reason")


def links(pages: DataFrame) -> DataFrame:
    """S4, native: page_id, rank, url of every quoted href of a link."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s+(?:[^>]*?\s)?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("p", "url")).select("page_id", (F.col("p") + 1).alias("rank"), "url")


_VALUE = "struct<at: int, bytes: int, value: string>"
PROFILE = "page_id string, body binary, " + ", ".join(f"{c} string" for c in (*IDENTITY, "about")) + ", open_to_work boolean, " + ", ".join(f"{s} array<array<{_VALUE}>>" for s in SECTIONS) + ", warnings array<string>"
#: Bytes that the texts of a section's items may have together; nested items repeat what lies in them.
MOST_ITEM_BYTES = 32 << 20


def _parts(spec: str) -> tuple[list[str], str]:
    where, _, attr = spec.partition("@")
    return [] if where in ("", ".") else where.split(", "), attr


_PROFILE = Selectors([*(x for s in (*SCOPES.values(), *IDENTITY.values(), ABOUT, OPEN_TO_WORK) for x in s), *(x for box, items in SECTIONS.values() for x in (*box, *items)), *(x for i in ITEMS.values() for spec in i.values() for x in _parts(spec)[0]), "a"])


def _value(page: Page, item: int, spec: str) -> dict | None:
    """A field of an item, in the notation of ITEMS: where its text stands, or the value of an attribute."""
    where, attr = _parts(spec)
    if not where and attr:
        return {"value": page.attrs[item].get(attr)}
    at = page.one(item, where) if where else item
    if attr == "a" and at is not None:
        at = page.one(at, ["a"])
    if at is None:
        return None
    return {"value": page.attrs[at].get("href")} if attr else dict(zip(("at", "bytes"), page.span(at), strict=True))


def _profile(html: str, most_items: Mapping[str, int]) -> dict:
    """A profile page's text, and its parts: a section's items as lists in the order of its ITEMS."""
    page = Page(html, _PROFILE)
    page.body_of = body = page.body()
    first = lambda i, selectors: next(iter(page.find(i, selectors)), None) if i is not None else None
    scope = {k: first(0, s) for k, s in SCOPES.items()}
    text = lambda i: None if i is None else page.text(i)
    row = {f: text(first(scope["top_card"], s)) for f, s in IDENTITY.items()} | {"about": text(first(scope["about"], ABOUT)), "open_to_work": first(scope["top_card"], OPEN_TO_WORK) is not None}
    boxes = {k: first(0, s) for k, (s, _) in SECTIONS.items()}
    warnings = [f"{k}_missing" for k, v in (scope | row | boxes).items() if v is None]
    for name, (_, items) in SECTIONS.items():
        own = page.find(boxes[name], items) if boxes[name] is not None else []
        row[name] = [[_value(page, i, x) for x in ITEMS[name].values()] for i in own[: most_items.get(name)]]
        if sum((f or {}).get("bytes") or 0 for item in row[name] for f in item) > MOST_ITEM_BYTES:
            row[name] = []
            warnings.append(f"{name}_too_large")
    return row | {"body": body, "warnings": warnings}


def _items(section: str) -> Column:
    """A section's items as an array of structs with the columns that enrichment takes; items without a name are out, and of skills and languages with one name the first stays."""
    at = {f: i for i, f in enumerate(ITEMS[section])}

    def one(item: Column, i: Column) -> Column:
        x, d = item["x"], item["d"]
        get = lambda f: F.get(x, F.lit(at[f]))
        name = get("name")
        key = lambda *c: F.coalesce(get("key"), F.concat(F.lit("linkedin:" if section == "experience" else ""), X.fingerprint(*c, missing="None")))
        const = {"source": F.lit("linkedin"), "confidence": F.lit(0.95), "sort_order": i}
        if section == "experience":
            fields = {"external_key": key(name, get("company"), d["start_date"], d["end_date"], F.initcap(d["is_current"].cast("string"))), "position_title_raw": name, "company_name": get("company"), "company_url": safe_href(get("link")), "employment_type": get("kind"), "location": get("location"), **{f: d[f] for f in ("start_date", "end_date", "is_current")}, "duration_months": F.lit(None).cast("int"), "description": get("description"), "skills_detected": X.unique_lines(get("skills"))} | const
        elif section == "education":
            degree = X.degree_and_field(get("degree"))
            fields = {"external_key": key(name, degree["degree"], degree["field"], d["start_date"], d["end_date"]), "institution_name": name, "degree": degree["degree"], "field_of_study": degree["field"], "start_year": F.year(d["start_date"]), "end_year": F.year(d["end_date"]), "grade": get("grade"), "description": get("description")} | const
        elif section == "skills":
            fields = {"raw_name": name, "category": F.lit(None).cast("string"), "endorsement_count": X.endorsements(get("all"))} | const | {"source": F.lit("profile_skill"), "confidence": F.lit(0.98)}
        elif section == "certifications":
            fields = {"external_key": F.lit(None).cast("string"), "name": name, "issuer": get("issuer"), "issue_date": X.month_date(get("issued")), "expiration_date": X.month_date(get("expires")), "credential_id": get("id"), "credential_url": safe_href(get("link"))} | const
        else:
            fields = {"language": name, "proficiency": get("proficiency")} | const
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    dated = F.transform(section, lambda x: F.struct(x.alias("x"), (X.date_range(F.get(x, F.lit(at["date"]))) if "date" in at else F.lit(None)).alias("d")))
    rows = F.filter(F.transform(dated, one), lambda x: x[{"experience": "position_title_raw", "education": "institution_name", "skills": "raw_name", "certifications": "name", "languages": "language"}[section]].isNotNull())
    if section not in ("skills", "languages"):
        return rows
    named, field = (D.SKILLS, "raw_name") if section == "skills" else (D.LANGUAGES, "language")
    folded = lambda x: X.fold(X.collapse(x[field]))
    key = lambda x: F.split_part(F.coalesce(F.try_element_at(X.lit_map(named), folded(x)), folded(x)), F.lit("|"), F.lit(1))
    # bound as an array of one, so that keys are made once a page and not once an item
    bound = F.transform(F.array(F.struct(rows.alias("r"))), lambda t: F.struct(t["r"].alias("r"), F.transform(t["r"], key).alias("k")))
    return F.get(F.transform(bound, lambda t: F.filter(t["r"], lambda x, i: F.array_position(t["k"], F.get(t["k"], i)) == i + 1)), F.lit(0))


def profile_fields(pages: DataFrame, most_about: int | None = None, most_items: Mapping[str, int] | None = None) -> DataFrame:
    """A row for each stored profile page: identity, about, sections as arrays of structs, warnings.

    Python only reads the tree; dates, links, degrees, counts and fingerprints are Catalyst expressions. A page that is
    null, empty or without a top card gives nulls, empty arrays and a warning for each part that is missing; items
    without a name and dates that do not parse are warned of too. A section of items nested so deep that their texts
    have over MOST_ITEM_BYTES together is left out with a warning. most_about and most_items (a section's first items)
    are a request's limits; without them all is kept.
    """

    read = partial(_profile, most_items=dict(most_items or {}))
    rows = pages.select(F.col("page_id").cast("string"), F.col("html").cast("string")).mapInArrow(_by_page(read, PROFILE), PROFILE)
    value = lambda f: F.nullif(F.coalesce(f["value"], _text(F.col("body"), f)), F.lit(""))
    rows = rows.withColumns({s: F.transform(s, lambda item: F.transform(item, value)) for s in SECTIONS}).drop("body")
    date = lambda x: X.date_range(F.get(x, F.lit(list(ITEMS["experience"]).index("date"))))
    unnamed = F.transform(F.filter("experience", lambda x: x[0].isNull()), lambda x: F.lit("item_parse_failed"))
    dates = F.flatten(F.transform(F.filter("experience", lambda x: x[0].isNotNull()), lambda x: date(x)["warnings"]))
    rows = rows.withColumn("warnings", F.concat("warnings", unnamed, dates))
    return rows.withColumns({s: _items(s) for s in SECTIONS} | ({} if most_about is None else {"about": F.substring("about", 1, most_about)}))


def profile_section(profiles: DataFrame, section: str) -> DataFrame:
    """A section of profile_fields as rows with page_id and pos, as the enrichment import takes them."""
    return profiles.select("page_id", F.posexplode(section).alias("pos", "x")).select("page_id", "pos", "x.*")
