"""What an enrichment payload may hold (S6): unknown keys, lengths, ranges, listed values and dates, checked line by line."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.sources.tables import PAYLOAD, _ddl

# What each object of a payload may hold. A field is optional (null allowed), default (not null where it is
# given) or required; then its kind: text with its least and largest length, number and whole with their least and largest
# value, date, flag, list with its largest size, or the listed values.
ROOT = {
    "payload_id": "optional text 0 500", "candidate_id": "required text 1 500", "sections_present": "optional list 7",
    "provider": "default listed manual linkedin imported demo", "mode": "default listed fast deep", "import_mode": "default listed merge replace_sections replace_all",
    "identity_update_strategy": "default listed fill_empty overwrite_non_null keep_existing", "parser_version": "default text 1 100", "warnings": "default list 100", "is_partial": "default flag",
    "identity": "optional object", "experiences": "default list 200", "educations": "default list 50", "skills": "default list 500", "certifications": "default list 200", "languages": "default list 50",
}
SECTIONS = {
    "experiences": {
        "external_key": "optional text 0 500", "position_title_raw": "required text 1 500", "company_name": "optional text 0 255", "company_url": "optional text 0 2048", "employment_type": "optional text 0 120", "location": "optional text 0 500",
        "start_date": "optional date", "end_date": "optional date", "is_current": "default flag", "duration_months": "optional whole 0", "description": "optional text 0 20000", "skills_detected": "default list 500", "industry_detected": "optional text 0 255",
        "confidence": "default number 0 1", "source": "default text 1 120", "sort_order": "default whole 0",
    },
    "educations": {
        "external_key": "optional text 0 500", "institution_name": "required text 1 500", "degree": "optional text 0 255", "field_of_study": "optional text 0 255", "start_year": "optional whole 1900 2100", "end_year": "optional whole 1900 2100",
        "grade": "optional text 0 120", "description": "optional text 0 20000", "confidence": "default number 0 1", "source": "default text 1 120", "sort_order": "default whole 0",
    },
    "skills": {"raw_name": "required text 1 255", "category": "optional text 0 120", "endorsement_count": "optional whole 0", "source": "default listed profile_skill experience_text about_text inferred manual", "confidence": "default number 0 1"},
    "certifications": {
        "external_key": "optional text 0 500", "name": "required text 1 500", "issuer": "optional text 0 255", "issue_date": "optional date", "expiration_date": "optional date", "credential_id": "optional text 0 255", "credential_url": "optional text 0 2048",
        "source": "default text 1 120", "confidence": "default number 0 1",
    },
    "languages": {"language": "required text 1 120", "proficiency": "optional text 0 120", "confidence": "default number 0 1", "source": "default text 1 120"},
}
IDENTITY = ["full_name", "headline", "about", "location_raw", "city", "country", "current_title", "current_company", "open_to_work"]
EXTRACTED = {"value": "required text 1 20000", "source": "default text 1 120", "confidence": "default number 0 1", "evidence": "optional text 0 2000"}
FLAGS = ["true", "false", "1", "0", "yes", "no", "on", "off", "y", "n", "t", "f"]
ERROR = "array<struct<section: string, pos: int, field: string, reason: string>>"
_OBJECT = "map<string, string>"


def _object(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _OBJECT))


def _wrong(v: Column, kind: str, *bounds: str) -> Column:
    """The reason why a value that is not null breaks its rule, or null."""
    if kind == "text":
        return F.when(F.length(v) < int(bounds[0]), "too_short").when(F.length(v) > int(bounds[1]), "too_long")
    if kind in ("number", "whole"):
        d = v.try_cast("double")
        bad = d.isNull() | F.isnan(d) | (d != F.floor(d) if kind == "whole" else F.lit(False))
        return F.when(bad, "wrong_type").when((d < float(bounds[0])) | (d > float(bounds[1]) if bounds[1:] else F.lit(False)), "out_of_range")
    if kind == "date":
        return F.when(~v.rlike(r"^\d{4}-\d\d-\d\d$") | v.try_cast("date").isNull(), "wrong_type")
    if kind == "flag":
        return F.when(~F.lower(v).isin(FLAGS), "wrong_type")
    if kind == "listed":
        return F.when(~v.isin(list(bounds)), "not_listed")
    if kind == "list":
        items = F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>"))
        return F.when(items.isNull(), "wrong_type").when(F.size(items) > int(bounds[0]), "too_many")
    return F.when(_object(v).isNull(), "wrong_type")


def _errors(m: Column, rules: Mapping[str, str], section: Column, pos: Column, prefix: Column | None = None, trim: bool = False, pairs: Mapping[str, Column] | None = None) -> Column:
    """ERROR of one object: broken rules in the order of its fields, then pairs of fields that contradict each other, then unknown keys."""

    def error(field: Column, reason: Column) -> Column:
        shown = field if prefix is None else F.concat(prefix, F.lit("."), field)
        return F.struct(section.alias("section"), pos.alias("pos"), shown.alias("field"), reason.alias("reason"))

    def reason(field: str, rule: str) -> Column:
        need, kind, *bounds = rule.split()
        v = F.try_element_at(m, F.lit(field))
        v = F.trim(v) if trim and kind == "text" else v
        nothing = {"required": F.lit("missing"), "default": F.when(F.map_contains_key(m, field), "wrong_type")}.get(need, F.lit(None))
        return F.when(v.isNull(), nothing).otherwise(_wrong(v, kind, *bounds))

    broken = [error(F.lit(f), reason(f, r)) for f, r in rules.items()] + [error(F.lit(f), c) for f, c in (pairs or {}).items()]
    unknown = F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, rules))))
    return F.concat(F.filter(F.array(*broken), lambda e: e["reason"].isNotNull()), F.transform(unknown, lambda k: error(k, F.lit("unknown_key"))))


def _pairs(section: str, m: Column) -> dict[str, Column]:
    """Fields of a section that contradict each other; values of a wrong type are reported on their own."""
    at = lambda f, kind: F.try_element_at(m, F.lit(f)).try_cast(kind)
    if section == "experiences":
        current = F.lower(F.try_element_at(m, F.lit("is_current"))).isin("true", "1", "yes", "on", "y", "t")
        return {"end_date": F.when(at("end_date", "date") < at("start_date", "date"), "end_before_start").when(current & at("end_date", "date").isNotNull(), "current_with_end")}
    if section == "educations":
        return {"end_year": F.when(at("end_year", "double") < at("start_year", "double"), "end_before_start")}
    return {"expiration_date": F.when(at("expiration_date", "date") < at("issue_date", "date"), "end_before_start")} if section == "certifications" else {}


def with_errors(lines: DataFrame, column: str = "value", name: str = "errors") -> DataFrame:
    """Lines with an array of ERROR, empty where a line is a payload that keeps every rule.

    Null, empty and broken text is one error, invalid_json. Texts given as numbers count as texts. Each line is
    checked in its own row, without Python and without a shuffle.
    """
    none = F.array().cast(ERROR)

    def one(section: str, pos: Column, m: Column, found: Column, field: Column) -> Column:
        plain = F.array(F.struct(F.lit(section).alias("section"), pos.alias("pos"), field.alias("field"), F.lit("wrong_type").alias("reason")))
        return F.when(m.isNull(), plain).otherwise(found).cast(ERROR)

    def children(root: Column, s: str) -> Column:
        text = F.try_element_at(root, F.lit(s))
        items = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
        objects = F.transform(F.coalesce(items, F.array().cast("array<string>")), _object)
        return F.flatten(F.transform(objects, lambda m, i: one(s, i, m, _errors(m, SECTIONS[s], F.lit(s), i, pairs=_pairs(s, m)), F.lit(None).cast("string"))))

    def identity(root: Column) -> Column:
        given = F.filter(F.map_entries(F.coalesce(_object(F.try_element_at(root, F.lit("identity"))), F.create_map().cast(_OBJECT))), lambda e: e["value"].isNotNull() | ~e["key"].isin(IDENTITY))
        parts = F.transform(given, lambda e: F.struct(e["key"].alias("k"), _object(e["value"]).alias("m")))
        nowhere, label = F.lit(None).cast("int"), F.lit("identity")

        def part(p: Column) -> Column:
            text = _errors(p["m"], EXTRACTED, label, nowhere, p["k"], trim=True)
            flag = _errors(p["m"], EXTRACTED | {"value": "required flag"}, label, nowhere, p["k"], trim=True)
            unknown = F.array(F.struct(label.alias("section"), nowhere.alias("pos"), p["k"].alias("field"), F.lit("unknown_key").alias("reason"))).cast(ERROR)
            return F.when(~p["k"].isin(IDENTITY), unknown).otherwise(one("identity", nowhere, p["m"], F.when(p["k"] == "open_to_work", flag).otherwise(text), p["k"]))

        return F.flatten(F.transform(parts, part))

    def whole(root: Column) -> Column:
        own = _errors(root, ROOT, F.lit("payload"), F.lit(None).cast("int")).cast(ERROR)
        return reduce(F.concat, [own, identity(root), *(children(root, s) for s in SECTIONS)])

    broken = F.array(F.struct(F.lit("payload").alias("section"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("field"), F.lit("invalid_json").alias("reason"))).cast(ERROR)
    found = F.transform(F.array(_object(F.col(column))), lambda root: F.when(root.isNull(), broken).otherwise(F.coalesce(whole(root), none)))
    return lines.withColumn(name, found[0])


def payload_errors(lines: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Key, section, pos (of a child, from 0), field and reason of everything that is wrong in lines of payloads."""
    return with_errors(lines.select(key, column), column, "found").select(key, F.explode_outer("found").alias("e")).filter("e is not null").select(key, "e.*")  # outer: a plain explode would have the errors found again for a filter


def checked_payloads(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The payloads of lines that keep every rule, and the other lines with their errors; a payload is taken whole or not at all."""
    rows = with_errors(lines.select(column), column, "errors")
    good = rows.filter(F.size("errors") == 0).select(F.from_json(column, f"struct<{_ddl(PAYLOAD)}>").alias("p"))
    return good.select("p.*"), rows.filter(F.size("errors") > 0)
