"""Typed requirements from job postings (X1-X22): lines, sections, sentences, phrases, reductions.

Every function takes and returns DataFrames over whole tables; rows carry the order they stem from.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.functions import dictionaries as D
from rolegraph.sources.tables import kept
from rolegraph.functions.text import ascii_key, clean_posting, distinct_by_key, fold, lit_map, match_key

WEIGHTS = {"required": 1.0, "preferred": 0.6, "optional": 0.3}
RANKS = {"required": 2, "preferred": 1, "optional": 0}
REQUIREMENT = ["job_id", "type", "raw_value", "normalized_value", "importance", "weight", "confidence", "evidence_text", "evidence_start", "evidence_end", "seq"]


def key_of(phrase: str) -> str:
    """match_key of a dictionary's phrase."""
    return " ".join(phrase.translate(str.maketrans("İIı", "iii")).casefold().split())


def weight(importance: Column) -> Column:
    """X15."""
    return F.try_element_at(lit_map(WEIGHTS), importance)


def importance(key: Column, section: Column, signals: Mapping[str, str] = D.SIGNALS) -> Column:
    """The strongest signal that the key holds, else the section's importance."""
    out = section
    for level in ("optional", "preferred", "required"):
        any_ = "|".join(re.escape(key_of(s)) for s, v in signals.items() if v == level)
        out = F.when(key.rlike(any_), F.lit(level)).otherwise(out)
    return out


def lines(postings: DataFrame, headings: Mapping[str, str] = D.HEADINGS, text_col: str = "description_clean") -> DataFrame:
    """A row for each line that is no heading, with its section and place; lines before a heading are in an untitled optional section."""
    spark = postings.sparkSession
    rows = postings.select("job_id", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("phrase", ascii_key(F.regexp_replace(F.trim("line"), r"\s*:\s*$", "")))
    known = F.broadcast(D.for_spark(spark, headings, key_of)).withColumnRenamed("value", "heading")
    rows = rows.join(known, "phrase", "left")
    before = Window.partitionBy("job_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("job_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "line_start": F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)),
            "section": F.last(F.when(F.col("heading").isNotNull(), F.struct(F.col("phrase").alias("title"), F.col("heading").alias("importance"), F.col("line_no").alias("at"))), ignorenulls=True).over(upto),
        }
    )
    return rows.filter(F.col("heading").isNull()).select("job_id", "line_no", "line", "line_start", F.coalesce("section.title", F.lit("")).alias("section_title"), F.coalesce("section.importance", F.lit("optional")).alias("section_importance"))


def units(postings: DataFrame, headings: Mapping[str, str] = D.HEADINGS) -> DataFrame:
    """A row for each sentence: text, importance, start, end in description_clean, unit (order)."""
    marker = r"^(?:[-*•▪◦]|\d+[.)])\s*"
    body = F.regexp_replace("line", marker, "")
    rows = lines(postings, headings).withColumns({"body": body, "skip": F.length("line") - F.length(body)})
    rows = rows.withColumn("parts", F.split("body", r"(?<=[.!?])\s+"))
    rows = rows.select("*", F.posexplode("parts").alias("k", "text")).filter(F.trim("text") != "")
    start = F.col("line_start") + F.col("skip") + F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 1)
    rows = rows.withColumns({"start": start.cast("int"), "end": (start + F.length("text")).cast("int"), "key": ascii_key(F.col("text"))})
    rows = rows.withColumn("importance", importance(F.col("key"), F.col("section_importance")))
    return rows.select("job_id", (F.col("line_no").cast("long") * 100_000 + F.col("k")).alias("unit"), "text", "key", "importance", "start", "end", "section_title")


SLOTS = 1 << 17


def _slot(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(SLOTS))


def phrase_hits(rows: DataFrame, ids: Sequence[str], dictionaries: Mapping[str, Mapping[str, str]], key_col: str = "key", most_broadcast: int = 200_000) -> DataFrame:
    """Ids, kind, match (position), phrase, value: whole-word phrases of several dictionaries (by kind) in one pass.

    For each kind the earliest phrase, of those the longest, without overlaps. ids name a row; rows without a key
    have no phrase. A key is cut into words and single other characters, and its runs of as many of them as some phrase has
    meet the phrases in an equi-join, so the cost hardly depends on the number of phrases. Only runs whose first
    token falls in the slot of some phrase's first are made. Dictionaries of more than
    most_broadcast phrases in all are shuffled instead of sent to every task.
    """
    first: dict[tuple[str, str], str] = {}
    for kind, phrases in dictionaries.items():
        for phrase, value in phrases.items():
            first.setdefault((kind, key_of(phrase)), value)
    cut = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+|\W"), F.lit(0))
    known = rows.sparkSession.createDataFrame([(k, p, v) for (k, p), v in first.items() if p], "kind string, phrase string, value string")
    tokens = known.select(cut(F.col("phrase")).alias("t")).select(F.size("t").alias("n"), _slot(F.col("t")[0]).alias("slot"))
    sizes, slots = tokens.agg(F.array_sort(F.collect_set("n")), F.collect_set("slot")).first()  # at most SLOTS numbers
    starts = bytearray(SLOTS)
    for s in slots:
        starts[s] = 1
    if len(first) <= most_broadcast:
        known = F.broadcast(known)

    t, n_tokens = F.col("t"), F.col("n_tokens")
    word = lambda i: t[i].rlike(r"(?U)^\w")
    begins = lambda i: (i == 0) | word(i) | ~word(F.greatest(i - 1, F.lit(0)))
    ends = lambda z: (z == n_tokens) | word(z - 1) | ~word(F.least(z, n_tokens - 1))
    may_start = lambda x: F.substring(F.lit(bytes(starts)), _slot(x) + 1, 1) == F.lit(b"\x01")
    cuts = rows.select(*ids, cut(F.col(key_col)).alias("t")).withColumn("n_tokens", F.size("t"))
    cuts = cuts.withColumn("at", F.array_compact(F.transform("t", lambda x, i: F.when(may_start(x), i)))).filter(F.size("at") > 0)
    runs = lambda i: F.filter(F.array(*map(F.lit, sizes)), lambda n: (i + n <= n_tokens) & begins(i) & ends(i + n))
    spots = F.flatten(F.transform("at", lambda i: F.transform(runs(i), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(t, i + 1, n), "").alias("phrase")))))
    hits = cuts.select(*ids, F.explode(spots).alias("x")).select(*ids, "x.*").join(known, "phrase")

    # Hits that overlap form chains, nearly all of one hit; a chain is read from left to right.
    row = Window.partitionBy(*ids, "kind").orderBy("at", F.desc("n"))
    before = F.max(F.col("at") + F.col("n")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("fresh", (F.col("at") >= F.coalesce(before, F.lit(0))).cast("long")).withColumn("chain", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    chains = hits.groupBy(*ids, "kind", "chain").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "phrase", "value"))).alias("c"))
    end = lambda x: x["at"] - x["less"]
    kept_ = F.aggregate(F.slice("c", 2, F.size("c")), F.slice("c", 1, 1), lambda a, x: F.when(x["at"] >= end(F.element_at(a, -1)), F.concat(a, F.array(x))).otherwise(a))
    return chains.select(*ids, "kind", F.explode(kept_).alias("x")).select(*ids, "kind", (F.row_number().over(Window.partitionBy(*ids, "kind").orderBy("x.at")) - 1).alias("match"), "x.phrase", "x.value")


def _requirement(rows: DataFrame, kind: Column, seq: Column, normalized: Column, confidence: Column, level: Column) -> DataFrame:
    return rows.select(
        "job_id", kind.alias("type"), F.col("phrase").alias("raw_value"), normalized.alias("normalized_value"), level.alias("importance"), weight(level).alias("weight"), confidence.cast("double").alias("confidence"),
        F.col("text").alias("evidence_text"), F.col("start").alias("evidence_start"), F.col("end").alias("evidence_end"), seq.alias("seq"),
    )


def titles(postings: DataFrame, sentence: DataFrame, aliases: Mapping[str, str] = D.TITLES) -> tuple[DataFrame, DataFrame]:
    """The title requirement of each job, and its title candidates (job_id, pos, title)."""
    table = lit_map({key_of(k): v for k, v in aliases.items()})
    named = lambda c: F.coalesce(F.try_element_at(table, match_key(c)), match_key(c))
    own = postings.select("job_id", F.trim("title").alias("raw")).withColumn("value", named(F.col("raw")))
    required = own.select("job_id", F.lit("title").alias("type"), F.col("raw").alias("raw_value"), F.col("value").alias("normalized_value"), F.lit("required").alias("importance"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.col("raw").alias("evidence_text"), F.lit(None).cast("int").alias("evidence_start"), F.lit(None).cast("int").alias("evidence_end"), F.lit(0).cast("long").alias("seq"))
    label = F.regexp_extract("text", r"(?i)^\s*(?:pozisyon|position|role)\s*:\s*([^\n]+)$", 1)
    more = sentence.withColumn("label", label).filter(F.col("label") != "").select("job_id", (F.col("unit") + 1).alias("pos"), named(F.trim("label")).alias("title"))
    return required, own.select("job_id", F.lit(0).cast("long").alias("pos"), F.col("value").alias("title")).unionByName(more)


#: The dictionaries by kind of phrase.
PHRASES = {"skill": {p: v.split("|")[0] for p, v in D.SKILLS.items()}, "field": D.EDUCATION_FIELDS, "level": D.EDUCATION_LEVELS, "language": D.LANGUAGES, "certification": D.CERTIFICATIONS, "location": D.LOCATIONS, "industry": D.INDUSTRIES}
#: Requirement type of a kind, its place among the types, and what is added to the places of its matches; fields come before levels.
TYPES = {"skill": ("skill", 1, 0), "field": ("education", 3, 0), "level": ("education", 3, 500), "language": ("language", 4, 0), "certification": ("certification", 5, 0), "location": ("location", 6, 1000), "industry": ("industry", 7, 0)}


def phrase_requirements(sentence: DataFrame, dictionaries: Mapping[str, Mapping[str, str]] = PHRASES, proficiencies: Mapping[str, str] = D.PROFICIENCIES) -> DataFrame:
    """The requirements that dictionaries name, of all kinds in one pass over the sentences.

    A language has the longest proficiency phrase of its sentence; residence words make a place required.
    """
    rows = sentence.select("job_id", "unit", "text", "key", "importance", "start", "end").join(phrase_hits(sentence, ["job_id", "unit"], dictionaries), ["job_id", "unit"])
    by_kind = lambda k: F.try_element_at(lit_map({x: str(v[k]) for x, v in TYPES.items()}), F.col("kind"))
    level = F.coalesce(*(F.when(F.contains("key", F.lit(key_of(p))), F.lit(proficiencies[p])) for p in sorted(proficiencies, key=len, reverse=True)))
    rows = rows.withColumn("level", F.when(F.col("kind") == "language", level))
    is_ = lambda k: F.col("kind") == k
    value = F.when(is_("field"), F.concat(F.lit("field:"), "value")).when(is_("level"), F.concat(F.lit("level:"), "value")).when(is_("language"), F.concat_ws(":", "value", "level")).otherwise(F.col("value"))
    sure = F.when(is_("language"), F.when(F.col("level").isNotNull(), 0.95).otherwise(0.9)).when(is_("location"), 0.9).when(is_("industry"), 0.85).when(F.col("phrase") == F.col("value"), 0.95).otherwise(0.9)
    strength = F.when(is_("location") & F.col("key").rlike("ikamet|çalişabilecek|çalışabilecek"), "required").otherwise(F.col("importance"))
    seq = by_kind(1).cast("long") * 10**15 + F.col("unit") * 1000 + F.col("match") + by_kind(2).cast("long")
    return _requirement(rows, by_kind(0), seq, value, sure, strength)


def _g(number: Column) -> Column:
    """A number of up to six significant digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(number, 6)), "0+$", ""), r"\.$", "")


def experience_of(key: Column) -> Column:
    """Struct of lo, hi, label, confidence from a sentence's key; null if it names no experience."""
    number, year = r"(\d+(?:[.,]\d+)?)", r"\s*(?:yil|years?)"
    value = lambda pattern, k: F.replace(F.regexp_extract(key, pattern, k), F.lit(","), F.lit(".")).try_cast("double")
    between = rf"{number}\s*(?:-|–|ila|to)\s*{number}{year}"
    least, plus = rf"(?:en az|minimum|at least)\s*{number}{year}", rf"{number}\s*\+{year}"
    months, more = rf"{number}\s*(?:ay|months?)", rf"(?:more than\s*)?{number}{year}\s*(?:ve üzeri|dan fazla|more)?"
    made = lambda lo, hi, label, confidence: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), label.alias("label"), F.lit(confidence).alias("confidence"))
    none = F.lit(None)
    from_ = lambda lo: made(lo, none, F.concat(F.lit("min:"), _g(lo)), 0.95)
    lo, hi = value(between, 1), value(between, 2)
    return (
        F.when(key.rlike(between), F.when(hi >= lo, made(lo, hi, F.concat(F.lit("range:"), _g(lo), F.lit("-"), _g(hi)), 0.95)))
        .when(key.rlike(least), from_(value(least, 1)))
        .when(key.rlike(plus), from_(value(plus, 1)))
        .when(key.rlike(r"(?U)\b(?:deneyimsiz|no experience required)\b"), made(F.lit(0.0), none, F.lit("min:0"), 0.9))
        .when(key.rlike(r"(?U)\b(?:yeni mezun|new graduate|entry level)\b"), made(F.lit(0.0), F.lit(1.0), F.lit("range:0-1"), 0.9))
        .when(key.rlike(months), from_(value(months, 1) / 12))
        .when(key.rlike(more) & key.rlike("ve üzeri|dan fazla|more than"), from_(value(more, 1)))
    )


def experience(sentence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements, and per job min_years, max_years, conflict (from required sentences where there are any)."""
    found = sentence.withColumn("e", experience_of(F.col("key"))).filter("e is not null").withColumn("phrase", F.col("text"))
    by_job = Window.partitionBy("job_id")
    ranked = found.withColumn("any_required", F.max((F.col("importance") == "required").cast("int")).over(by_job)).filter((F.col("any_required") == 0) | (F.col("importance") == "required"))
    per_job = ranked.groupBy("job_id").agg(F.max_by(F.struct("e.lo", "e.hi"), F.struct(F.col("e.lo"), -F.col("unit"))).alias("best"), (F.count_distinct(F.struct(F.col("e.lo"), F.coalesce("e.hi", F.lit(-1.0)))) > 1).alias("conflict"))
    rows = _requirement(found, F.lit("experience"), F.lit(2).cast("long") * 10**15 + F.col("unit") * 1000, F.col("e.label"), F.col("e.confidence"), F.col("importance"))
    return rows, per_job.select("job_id", F.col("best.lo").alias("min_years"), F.col("best.hi").alias("max_years"), "conflict")


def locations(postings: DataFrame, phrases: Mapping[str, str] = D.LOCATIONS) -> DataFrame:
    """The explicit columns, as required; places in the text are phrases."""
    table = lit_map({key_of(k): v for k, v in phrases.items()})
    explicit = postings.select("job_id", F.explode(F.array(*(F.struct(F.trim(c).alias("raw"), F.lit(p).alias("prefix"), F.lit(conf).alias("confidence"), F.lit(n).alias("n")) for n, (c, p, conf) in enumerate((("city", "city:", 1.0), ("country", "country:", 1.0), ("location_raw", "city:", 0.95)))))).alias("x")).select("job_id", "x.*").filter(F.col("raw") != "")
    return explicit.withColumn("k", match_key(F.col("raw"))).select(
        "job_id", F.lit("location").alias("type"), F.col("raw").alias("raw_value"), F.coalesce(F.try_element_at(table, F.col("k")), F.concat("prefix", "k")).alias("normalized_value"), F.lit("required").alias("importance"), F.lit(1.0).alias("weight"), "confidence",
        F.col("raw").alias("evidence_text"), F.lit(None).cast("int").alias("evidence_start"), F.lit(None).cast("int").alias("evidence_end"), (F.lit(6).cast("long") * 10**15 + F.col("n")).alias("seq"),
    )


def strongest(requirements: DataFrame) -> DataFrame:
    """Of equal type and value the most important, then most certain, then the one with the longest evidence; in order of first appearance."""
    w = Window.partitionBy("job_id", "type", fold(F.col("normalized_value")))
    best = w.orderBy(F.desc(F.try_element_at(lit_map(RANKS), F.col("importance"))), F.desc("confidence"), F.desc(F.length(F.coalesce("evidence_text", "raw_value"))), "seq")
    return requirements.withColumns({"first_seq": F.min("seq").over(w), "rank": F.row_number().over(best)}).filter("rank = 1").withColumn("seq", F.col("first_seq")).drop("rank", "first_seq")


def requirements(postings: DataFrame, sentence: DataFrame | None = None) -> DataFrame:
    """All typed requirements of postings (job_id, title, description_clean, city, country, location_raw), strongest() applied."""
    s = kept(units(postings)) if sentence is None else sentence  # phrases, experience and titles read it
    parts = [titles(postings, s)[0], phrase_requirements(s), experience(s)[0], locations(postings)]
    return strongest(reduce(DataFrame.unionByName, (p.select(REQUIREMENT) for p in parts)))


def parse(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each parsed job, all requirements, and rejected rows with a reason.

    postings: job_id, title, description_raw, location_raw, city, country, status. Only draft and parsed
    jobs with a text are parsed.
    """
    jobs = kept(_judged(postings).filter("reject_reason is null").drop("reject_reason"))
    s = kept(units(jobs))
    found = kept(requirements(jobs, s))
    arrays = _roll_up()
    span = found.groupBy("job_id").agg(
        *(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", F.regexp_replace("normalized_value", drop, "").alias("v"))))).alias(name) for name, cond, drop in arrays),
        *(F.max((F.col("type") == t).cast("int")).alias(f"has_{t}") for t in ("title", "skill", "experience", "education", "location", "language")),
        F.count(F.lit(1)).alias("n"),
    )
    span = span.select("job_id", "n", *(c for c in span.columns if c.startswith("has_")), *(distinct_by_key(F.transform(name, lambda x: x["v"]), ascii_key).alias(name) for name, _, _ in arrays))
    names = titles(jobs, s)[1].groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t")).select("job_id", distinct_by_key(F.transform("t", lambda x: x["title"]), ascii_key).alias("title_candidates"))
    flags = s.groupBy("job_id").agg(F.max(F.contains("key", F.lit("ilgili böl")) | F.contains("key", F.lit("related field"))).alias("related"), F.max(F.col("section_title") != "").alias("sections"))
    out = jobs.join(span, "job_id").join(names, "job_id").join(flags, "job_id", "left").join(experience(s)[1], "job_id", "left")
    score = F.col("has_title") * 0.2 + F.col("has_skill") * 0.2 + F.col("has_experience") * 0.15 + F.col("has_education") * 0.15 + F.col("has_location") * 0.1 + F.col("has_language") * 0.1 + F.coalesce(F.col("sections").cast("int"), F.lit(0)) * 0.1
    out = out.withColumn("confidence", F.round(score, 2))
    warn = lambda cond, name: F.when(cond, F.lit(name))
    warnings = F.array_compact(F.array(warn(F.col("conflict"), "conflicting_experience_requirements"), warn(F.col("related"), "related_departments_phrase_detected"), warn(F.col("has_skill") == 0, "no_skills_detected"), warn(F.col("has_experience") == 0, "no_experience_detected"), warn(F.col("has_education") == 0, "no_education_detected"), warn(F.col("n") == 1, "title_only_parse"), warn(F.col("confidence") < 0.4, "parser_low_confidence")))
    variants = F.flatten(F.transform("title_candidates", lambda t: F.coalesce(F.split(F.try_element_at(lit_map(D.TITLE_VARIANTS), t), r"\|"), F.array().cast("array<string>"))))
    common = F.concat("required_skills", "preferred_skills", "education_fields", F.transform("locations", lambda x: F.regexp_replace(x, "^[^:]*:", "")), "certifications", "industries")
    out = out.withColumns({"warnings": warnings, "keywords_tr": distinct_by_key(F.concat(variants, common), ascii_key, 30), "keywords_en": distinct_by_key(F.concat(F.col("title_candidates"), common), ascii_key, 30), "parser_version": F.lit("rule-based-v1"), "status": F.lit("parsed")})
    drop = ["n", "related", "sections", "conflict", *(c for c in span.columns if c.startswith("has_"))]
    return out.withColumnsRenamed({"min_years": "min_experience_years", "max_years": "max_experience_years"}).drop(*drop), found, rejected(postings)


def _judged(postings: DataFrame) -> DataFrame:
    """Postings with description_clean and why they are not parsed (null: they are)."""
    jobs = postings.withColumn("description_clean", clean_posting(F.col("description_raw")))
    reason = F.when(~F.col("status").isin("draft", "parsed"), "status_not_parsable").when(F.col("description_clean") == "", "empty_description").when(F.coalesce(F.trim("title"), F.lit("")) == "", "title_missing")
    return jobs.withColumn("reject_reason", reason)


def rejected(postings: DataFrame) -> DataFrame:
    """job_id, reject_reason of the postings that parse() leaves out, without parsing the others."""
    return _judged(postings).filter("reject_reason is not null").select("job_id", "reject_reason")


def _roll_up() -> list:
    """Array columns of a parsed job: name, which requirements, and the prefix to drop."""
    kind = lambda t: F.col("type") == t
    value = F.col("normalized_value")
    return [
        ("required_skills", kind("skill") & (F.col("importance") == "required"), "^$"),
        ("preferred_skills", kind("skill") & (F.col("importance") == "preferred"), "^$"),
        ("education_fields", kind("education") & value.startswith("field:"), "^field:"),
        ("education_levels", kind("education") & value.startswith("level:"), "^level:"),
        ("locations", kind("location"), "^$"),
        ("languages", kind("language"), "^$"),
        ("certifications", kind("certification"), "^$"),
        ("industries", kind("industry"), "^$"),
    ]


def listed(found: DataFrame) -> DataFrame:
    """Requirements by type, value, importance."""
    return found.orderBy("job_id", "type", "normalized_value", "importance", "seq")
