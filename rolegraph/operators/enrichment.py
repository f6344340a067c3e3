"""Profile enrichment (E1-E18): normalised children, natural keys, timelines, diffs and upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.functions import dictionaries as D
from rolegraph.functions.text import clean, fold, lit_map
from rolegraph.functions.urls import canonical_url
from rolegraph.operators.candidates import quality
from rolegraph.operators.relational import page_each


def named(c: Column, table: Mapping[str, str]) -> Column:
    """The dictionary's value of a folded name, else the folded name."""
    k = fold(clean(c, unicode=False))
    return F.coalesce(F.try_element_at(lit_map(table), k), k)


def months_between(start: Column, end: Column) -> Column:
    """Calendar months from start to end, both counted."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


def experiences(rows: DataFrame, today: str) -> DataFrame:
    """Rows with normalised columns; `today` ends current ones."""
    text = lambda c: clean(F.col(c), unicode=False)
    skills = {k: v.split("|")[0] for k, v in D.SKILLS.items()}
    end = F.when(F.col("is_current") & F.col("start_date").isNotNull(), F.to_date(F.lit(today))).otherwise(F.col("end_date"))
    return rows.withColumns(
        {
            "position_title_raw": text("position_title_raw"), "position_title_normalized": named(F.col("position_title_raw"), D.TITLES), "external_key": fold(text("external_key")), "company_name": text("company_name"), "company_url": canonical_url(F.col("company_url"))["url"], "location": text("location"),
            "skills_detected": F.array_distinct(F.transform(F.coalesce("skills_detected", F.array().cast("array<string>")), lambda x: F.coalesce(F.try_element_at(lit_map(skills), fold(F.trim(x))), fold(F.trim(x))))), "duration_months": F.coalesce(months_between(F.col("start_date"), end), F.col("duration_months")),
        }
    )


def skills(rows: DataFrame, phrases: Mapping[str, str] = D.SKILLS, caps: Mapping[str, float] = D.SOURCE_CAPS) -> DataFrame:
    """normalized_name, category, and confidence capped by source."""
    entry = F.split(F.try_element_at(lit_map(phrases), fold(clean(F.col("raw_name"), False))), r"\|")
    return rows.withColumns({"normalized_name": F.coalesce(entry[0], fold(clean(F.col("raw_name"), False))), "category": F.coalesce(clean(F.col("category"), False), entry[1]), "confidence": F.least(F.col("confidence"), F.try_element_at(lit_map(caps), F.col("source")))})


def educations(rows: DataFrame) -> DataFrame:
    """E3."""
    text = lambda c: clean(F.col(c), False)
    return rows.withColumns({"institution_name": text("institution_name"), "external_key": fold(text("external_key")), "field_of_study": text("field_of_study"), "field_of_study_normalized": named(F.col("field_of_study"), D.EDUCATION_FIELDS), "degree": text("degree"), "source": fold(text("source"))})


def certifications(rows: DataFrame) -> DataFrame:
    """E4."""
    name = clean(F.col("name"), False)
    text = lambda c: clean(F.col(c), False)
    return rows.withColumns({"name": F.coalesce(F.try_element_at(lit_map(D.CERTIFICATIONS), fold(name)), name), "external_key": fold(text("external_key")), "issuer": text("issuer"), "credential_id": text("credential_id"), "credential_url": canonical_url(F.col("credential_url"))["url"], "source": fold(text("source"))})


def languages(rows: DataFrame) -> DataFrame:
    """E5."""
    return rows.withColumns({"language_normalized": named(F.col("language"), D.LANGUAGES), "proficiency": named(F.col("proficiency"), D.PROFICIENCIES)})


def experience_key() -> Column:
    """The external key, else the fingerprint of title, company, dates and whether it is current."""
    text = lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat_ws("|", text(F.col("position_title_normalized")), text(fold(clean(F.col("company_name"), False))), text(F.col("start_date").cast("string")), text(F.col("end_date").cast("string")), F.when(F.col("is_current"), F.lit("True")).otherwise(F.lit("False")))
    return F.coalesce(F.col("external_key"), F.sha2(whole, 256))


def natural_key(section: str) -> Column:
    """What makes two rows of a candidate's section the same one."""
    text = lambda *cols: F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    low = lambda c: fold(F.col(c))
    external = F.when(F.coalesce(F.col("external_key"), F.lit("")) != "", F.concat(F.lit("external:"), "source", F.lit(":"), "external_key"))
    credential = F.when(F.coalesce(F.col("credential_id"), F.lit("")) != "", F.concat(F.lit("credential:"), low("credential_id")))
    return {
        "experience": experience_key,
        "education": lambda: F.coalesce(external, text(low("institution_name"), F.col("field_of_study_normalized"), low("degree"), F.col("start_year"), F.col("end_year"))),
        "certification": lambda: F.coalesce(external, credential, text(low("name"), low("issuer"), F.col("issue_date"))),
        "skill": lambda: text(F.col("normalized_name"), F.col("source")),
        "language": lambda: F.col("language_normalized"),
    }[section]()


def row_errors(section: str) -> Column:
    """The rules that a normalised row of a section breaks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "experience": {"position_title_required": blank("position_title_raw"), "date_range": F.col("end_date") < F.col("start_date"), "current_with_end": F.col("is_current") & F.col("end_date").isNotNull()},
        "education": {"institution_required": blank("institution_name"), "year_range": F.col("end_year") < F.col("start_year")},
        "certification": {"name_required": blank("name"), "date_range": F.col("expiration_date") < F.col("issue_date")},
        "skill": {"name_required": blank("raw_name"), "negative_endorsements": F.col("endorsement_count") < 0},
        "language": {"language_required": blank("language")},
    }[section]
    rules["confidence"] = ~F.col("confidence").between(0, 1)
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def last_of_key(rows: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Of equal keys the last row, at the place of the first."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"__n": F.row_number().over(w.orderBy(F.desc(pos))), "__p": F.min(pos).over(w)}).filter("__n = 1").withColumn(pos, F.col("__p")).drop("__n", "__p")


def total_months(rows: DataFrame, today: str, key: Sequence[str] = ("start_date", "end_date", "is_current")) -> DataFrame:
    """candidate_id, total_months: calendar months covered by any experience, plus durations without a start.

    Intervals are merged by the running maximum of earlier ends, so no interval is expanded to months.
    """
    once = rows.dropDuplicates(["candidate_id", *key])
    end = F.when(F.col("is_current"), F.to_date(F.lit(today))).otherwise(F.to_date("end_date"))
    index = lambda d: F.year(d) * 12 + F.month(d)
    spans = once.select("candidate_id", index(F.to_date("start_date")).alias("a"), index(end).alias("z"), "duration_months", F.col("start_date").isNull().alias("undated"))
    w = Window.partitionBy("candidate_id").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    dated = spans.filter("a is not null and z is not null and z >= a").withColumn("before", F.coalesce(F.max("z").over(w), F.col("a") - 1))
    covered = dated.groupBy("candidate_id").agg(F.sum(F.greatest(F.lit(0), F.col("z") - F.greatest(F.col("a") - 1, F.col("before")))).alias("months"))
    loose = spans.filter("undated and duration_months is not null").groupBy("candidate_id").agg(F.sum(F.greatest(F.lit(0), F.col("duration_months"))).alias("more"))
    return once.select("candidate_id").distinct().join(covered, "candidate_id", "left").join(loose, "candidate_id", "left").select("candidate_id", (F.coalesce("months", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("total_months"))


def identity_diff(current: DataFrame, incoming: DataFrame, fields: Sequence[str], strategy: str = "fill_empty") -> DataFrame:
    """candidate_id, field, old, new, action for every field that the payload gives."""
    long = lambda df, name: df.select("candidate_id", F.explode(F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", name))
    d = long(incoming, "new").filter("trim(new) <> ''").join(long(current, "old"), ["candidate_id", "field"])
    return d.select("candidate_id", "field", "old", "new", identity_action(F.col("old"), F.col("new"), F.lit(strategy)).alias("action"))


def identity_action(old: Column, new: Column, strategy: Column) -> Column:
    """Unchanged, fill, overwrite or keep; null where nothing new is given."""
    empty = F.coalesce(F.trim(old), F.lit("")) == ""
    action = F.when(F.coalesce(old == new, F.lit(False)), "unchanged").when(empty & (strategy != "keep_existing"), "fill").when(strategy == "overwrite_non_null", "overwrite").otherwise("keep")
    return F.when(F.coalesce(F.trim(new), F.lit("")) != "", action)


def current_position(rows: DataFrame) -> DataFrame:
    """The current experience that starts last, then the first in order."""
    best = F.max_by(F.struct("position_title_raw", "company_name"), F.struct(F.coalesce(F.to_date("start_date"), F.to_date(F.lit("0001-01-01"))), -F.col("sort_order")))
    return rows.filter("is_current").groupBy("candidate_id").agg(best.alias("b")).select("candidate_id", F.col("b.position_title_raw").alias("current_title"), F.col("b.company_name").alias("current_company"))


def collection_diff(existing: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """Per candidate and section create, update, unchanged, delete counts of keys (candidate_id, section, key)."""
    keys = ["candidate_id", "section", "key"]
    both = existing.select(keys).distinct().withColumn("old", F.lit(True)).join(incoming.select(keys).distinct().withColumn("new", F.lit(True)), keys, "full_outer")
    shared = F.count_if(F.col("old") & F.col("new"))
    gone = F.count_if(F.col("new").isNull()) if replace else F.lit(0).cast("long")
    return both.groupBy("candidate_id", "section").agg(F.count_if(F.col("old").isNull()).alias("create_count"), shared.alias("update_count"), shared.alias("unchanged_count"), gone.alias("delete_count"))


def upserted(existing: DataFrame, incoming: DataFrame, payloads: DataFrame, keys: Sequence[str], section: str) -> DataFrame:
    """The collection after import: new rows in, matched ones overwritten, unmatched ones out under replace modes.

    payloads: candidate_id, import_mode, sections_present. keys: the natural key, with candidate_id.
    """
    drop = payloads.filter((F.col("import_mode") == "replace_all") | ((F.col("import_mode") == "replace_sections") & F.array_contains("sections_present", section))).select("candidate_id").distinct()
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti").join(drop, "candidate_id", "left_anti")
    return kept.unionByName(incoming.select(existing.columns))


def settled(existing: DataFrame, incoming: DataFrame, payloads: DataFrame, section: str, tasks: int | None = None) -> DataFrame:
    """A section's stored and incoming rows with their fate, in one order of (candidate_id, key).

    keep, update (a stored row that is overwritten) and delete are stored rows, create and overwrite incoming ones;
    keep, create and overwrite make the collection after import. Incoming rows of candidates without a payload, and all
    but the last of a key, are left out. tasks: to how many the candidates are dealt; Spark's setting without it.
    """
    w = Window.partitionBy("candidate_id", "key").orderBy(F.desc("__new"), F.desc("pos"))
    of_key = lambda c: c.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = existing.withColumn("__new", F.lit(False)).unionByName(incoming.select(existing.columns).withColumn("__new", F.lit(True)))
    both = both.repartition(*([tasks] if tasks else []), "candidate_id")
    both = both.withColumns({"__n": F.row_number().over(w), "__given": of_key(F.max("__new")), "__held": ~of_key(F.min("__new")), "__p": of_key(F.min(F.when(F.col("__new"), F.col("pos"))))})
    replaces = (F.col("import_mode") == "replace_all") | ((F.col("import_mode") == "replace_sections") & F.array_contains("sections_present", section))
    modes = payloads.groupBy("candidate_id").agg(F.coalesce(F.bool_or(replaces), F.lit(False)).alias("__replaces"))
    given, held = (F.col(c) & F.col("key").isNotNull() for c in ("__given", "__held"))
    stored = F.when(F.col("__replaces").isNull(), "keep").when(given, "update").when(F.col("__replaces"), "delete").otherwise("keep")
    fate = F.when(~F.col("__new"), stored).when(F.col("__replaces").isNotNull() & (F.col("__n") == 1), F.when(held, "overwrite").otherwise("create"))
    out = both.join(modes, "candidate_id", "left").withColumn("fate", fate).filter("fate is not null")
    return out.withColumn("pos", F.when(F.col("__new"), F.col("__p")).otherwise(F.col("pos"))).select(*existing.columns, "fate")


def profile_status(mode: Column, complete: Column) -> Column:
    """E15."""
    return F.when((mode == "deep") & complete, "scraped").otherwise("partial")


NORMALISED = {"experience": experiences, "education": lambda rows, today: educations(rows), "skill": lambda rows, today: skills(rows), "certification": lambda rows, today: certifications(rows), "language": lambda rows, today: languages(rows)}


def import_enrichment(
    candidates: DataFrame, stored: Mapping[str, DataFrame], payloads: DataFrame, incoming: Mapping[str, DataFrame], now: str, fields: Sequence[str] = ("full_name", "headline", "about", "location_raw"), preview: bool = False, tasks: int | None = None
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Candidates and their sections after the import, and a run for each payload.

    payloads: candidate_id (once), mode, import_mode, identity_update_strategy, sections_present, is_partial, and the
    identity fields. stored and incoming: by section (the names of NORMALISED) rows with candidate_id and pos. now: a
    timestamp. A payload with a row that breaks a rule changes nothing; its run failed and names the rules. Runs
    count what is created, updated and deleted in each section, and hold the quality before and after. A preview
    gives the runs only. tasks: to how many a section's rows are dealt; Spark's setting without it.
    """
    today, names = now[:10], list(incoming)
    new = {k: NORMALISED[k](incoming[k], today).withColumns({"errors": row_errors(k), "key": natural_key(k)}) for k in names}
    old = {k: NORMALISED[k](stored[k], today).withColumn("key", natural_key(k)) for k in names}
    broken = reduce(DataFrame.unionByName, (r.select("candidate_id", F.explode(F.transform("errors", lambda e: F.concat(F.lit(f"{k}:"), e))).alias("error")) for k, r in new.items()))
    failed = broken.groupBy("candidate_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    good = payloads.join(failed, "candidate_id", "left_anti")
    after, runs = {}, payloads.select("candidate_id", "mode", "import_mode", "is_partial")
    for k, r in new.items():
        rows = settled(old[k], r, good, k, tasks)
        after[k] = rows.filter(F.col("fate").isin("keep", "create", "overwrite")).drop("fate")
        counts = rows.groupBy("candidate_id").agg(F.count_if(F.col("fate") == "create").alias(f"{k}_created"), F.count_if(F.col("fate") == "update").alias(f"{k}_updated"), F.count_if(F.col("fate") == "delete").alias(f"{k}_deleted"))
        runs = runs.join(counts, "candidate_id", "left").fillna(0, [f"{k}_created", f"{k}_updated", f"{k}_deleted"])

    p = good.select("candidate_id", "mode", "is_partial", "identity_update_strategy", *(F.col(f).alias(f"in_{f}") for f in fields))
    out = candidates.join(p, "candidate_id", "left")
    touched = F.col("mode").isNotNull()
    changes = {f: F.when(identity_action(F.col(f), F.col(f"in_{f}"), F.col("identity_update_strategy")).isin("fill", "overwrite"), F.col(f"in_{f}")).otherwise(F.col(f)) for f in fields}
    if "experience" in names:
        spans = total_months(after["experience"], today).withColumnRenamed("total_months", "new_months")
        out = out.join(spans, "candidate_id", "left").join(current_position(after["experience"]).withColumnsRenamed({"current_title": "new_title", "current_company": "new_company"}), "candidate_id", "left")
        changes |= {c: F.when(touched, F.coalesce(n, c)).otherwise(F.col(c)) for c, n in (("total_experience_months", "new_months"), ("current_title", "new_title"), ("current_company", "new_company"))}
    whole = (F.col("mode") == "deep") & ~F.col("is_partial")
    changes["profile_status"] = F.when(touched, profile_status(F.col("mode"), ~F.col("is_partial"))).otherwise(F.col("profile_status"))
    changes["last_scraped_at"] = F.when(touched & whole, F.to_timestamp(F.lit(now))).otherwise(F.col("last_scraped_at"))
    changed = out.withColumns(changes).select(candidates.columns)
    none = candidates.select("candidate_id").limit(0)
    scores = lambda people, sections, name: quality(people, *(sections.get(k, none) for k in ("experience", "education", "skill"))).select("candidate_id", F.col("data_quality_score").alias(name))
    before, now_ = scores(candidates, old, "quality_before"), scores(changed, after, "quality_after")
    status = F.when(F.col("errors").isNotNull(), "failed").when(F.lit(preview), "preview").when(F.col("is_partial"), "partial").otherwise("completed")
    runs = runs.join(before, "candidate_id", "left").join(now_, "candidate_id", "left").join(failed, "candidate_id", "left").withColumn("status", status).drop("is_partial")
    if preview:
        return candidates, dict(stored), runs
    changed = changed.drop("data_quality_score").join(now_.withColumnRenamed("quality_after", "data_quality_score"), "candidate_id", "left").select(candidates.columns)
    return changed, {k: df.drop("key") for k, df in after.items()}, runs


#: What runs may be sorted by.
RUN_SORTS = ["created_at", "completed_at", "status"]


def runs_listed(runs: DataFrame, provider: str | None = None, mode: str | None = None, status: str | None = None, since: str | None = None, until: str | None = None, sort: str = "created_at", descending: bool = True, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page of each candidate's runs with rank, and candidate_id, total, pages, page, page_size."""
    for c, v in (("provider", provider), ("mode", mode), ("status", status)):
        runs = runs if v is None else runs.filter(F.col(c) == v)
    runs = runs if since is None else runs.filter(F.col("created_at") >= since)
    runs = runs if until is None else runs.filter(F.col("created_at") <= until)
    return page_each(runs, "candidate_id", sort, "run_id", RUN_SORTS, descending, page, size)


def profiles(candidates: DataFrame, children: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Candidates with each child table as an array of structs in order; children are aggregated before they join."""

    def add(df: DataFrame, item: tuple) -> DataFrame:
        name, (child, order) = item
        rest = [c for c in child.columns if c != "candidate_id" and c not in order]
        arrays = child.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        return df.join(arrays, "candidate_id", "left").withColumn(name, F.coalesce(name, F.array().cast(arrays.schema[name].dataType)))

    return reduce(add, children.items(), candidates)
