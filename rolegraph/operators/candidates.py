"""Candidate quality, duplicates and merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegraph.functions import dictionaries as D
from rolegraph.sources.scratch import Scratch
from rolegraph.functions.text import clean, fold, headline_parts, location_parts, person_name
from rolegraph.functions.urls import PROFILE_HOST, canonical_url

#: Fields that a merge decides on.
MERGE_FIELDS = "primary_profile_url normalized_profile_url profile_slug full_name headline about discovery_title discovery_snippet location_raw city country current_title current_company total_experience_months open_to_work profile_status last_scraped_at".split()
#: Those that a request may not set itself, and the states of a profile.
PROTECTED_FIELDS = ["normalized_profile_url", "profile_slug", "last_scraped_at"]
PROFILE_STATES = "discovered queued scraped partial unavailable failed".split()


def has_text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def quality(candidates: DataFrame, experiences: DataFrame, educations: DataFrame, skills: DataFrame, weights: Mapping[str, int] = D.QUALITY_WEIGHTS) -> DataFrame:
    """candidate_id, data_quality_score, field_scores, missing_fields, warnings; children are counted before they join."""
    out = candidates
    for df, n in ((experiences, "n_exp"), (educations, "n_edu"), (skills, "n_skill")):
        out = out.join(df.groupBy("candidate_id").agg(F.count(F.lit(1)).alias(n)), "candidate_id", "left")
    out = out.fillna(0, ["n_exp", "n_edu", "n_skill"])
    name, u = person_name(F.col("full_name")), canonical_url(F.col("normalized_profile_url"))
    url_ok = F.coalesce(u["url"].isNotNull() & F.when(u["domain"] == PROFILE_HOST, u["slug"].isNotNull()).otherwise(~u["domain"].isin("google.com", "www.google.com", "bing.com")), F.lit(False))
    present = {
        "full_name": name.isNotNull(), "normalized_profile_url": url_ok, "headline": has_text(F.col("headline")), "location": has_text(F.col("location_raw")) | has_text(F.col("city")) | has_text(F.col("country")), "current_title": has_text(F.col("current_title")), "current_company": has_text(F.col("current_company")),
        "about": has_text(F.col("about")), "discovery_snippet": has_text(F.col("discovery_snippet")), "experience": F.col("n_exp") > 0, "education": F.col("n_edu") > 0, "skills": F.col("n_skill") >= 3,
    }
    out = out.select("candidate_id", "full_name", "normalized_profile_url", *(F.when(c, weights[f]).otherwise(0).alias(f"p_{f}") for f, c in present.items()))
    got = {f: F.col(f"p_{f}") for f in present}
    return out.select(
        "candidate_id", reduce(Column.__add__, got.values()).cast("double").alias("data_quality_score"), F.create_map(*(x for f, c in got.items() for x in (F.lit(f), c))).alias("field_scores"), F.array_compact(F.array(*(F.when(c == 0, F.lit(f)) for f, c in got.items()))).alias("missing_fields"),
        F.array_compact(F.array(F.when(has_text(F.col("full_name")) & (got["full_name"] == 0), F.lit("placeholder_name")), F.when(has_text(F.col("normalized_profile_url")) & (got["normalized_profile_url"] == 0), F.lit("invalid_candidate_profile_url")))).alias("warnings"),
    )


def prepared(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates as they are stored, and rejected ones with a reason."""
    c = candidates.withColumns({"u": canonical_url(F.col("primary_profile_url")), "h": headline_parts(F.col("headline")), "l": location_parts(F.col("location_raw"))})
    page = F.col("primary_profile_url").isNotNull() & (F.col("u.url").isNull() | ((F.col("u.domain") == PROFILE_HOST) & F.col("u.slug").isNull()) | (F.col("u.domain").endswith("." + PROFILE_HOST)))
    text = {f: clean(F.col(f)) for f in ("about", "discovery_title", "discovery_snippet", "location_raw")}
    sure = F.col("h.confidence") >= 0.9
    c = c.withColumns(
        text
        | {
            "normalized_profile_url": F.col("u.url"), "profile_slug": F.col("u.slug"), "full_name": person_name(F.col("full_name")), "headline": F.col("h.headline"), "current_title": F.coalesce(clean(F.col("current_title")), F.when(sure, F.col("h.title"))), "current_company": F.coalesce(clean(F.col("current_company")), F.when(sure, F.col("h.company"))),
            "city": F.coalesce(clean(F.col("city")), F.col("l.city")), "country": F.coalesce(clean(F.col("country")), F.col("l.country")),
        }
    )
    c = c.withColumn("reject_reason", F.when(page, "invalid_profile_url").when(~identified(), "identity_missing")).drop("u", "h", "l")
    return c.filter("reject_reason is null").drop("reject_reason"), c.filter("reject_reason is not null")


def identified() -> Column:
    """A URL, a name or a discovery title."""
    return has_text(F.col("normalized_profile_url")) | has_text(F.col("full_name")) | has_text(F.col("discovery_title"))


def blocked_pairs(candidates: DataFrame, cap: int = 100) -> DataFrame:
    """base_id, other_id that share a URL, a slug or a name (case aside); the oldest `cap` others of each base.

    The reference's request reads no more than that. Keys that a very large group shares are cut before
    they pair: only the oldest cap + 1 rows of a key can be among the oldest cap others of any base, so
    no more than that is joined.
    """
    keyed = [candidates.filter(has_text(F.col(c))).select("candidate_id", "created_at", F.lit(c).alias("kind"), fold(F.col(c)).alias("key")) for c in ("normalized_profile_url", "profile_slug", "full_name")]
    keys = reduce(DataFrame.unionByName, keyed)
    oldest = keys.withColumn("n", F.row_number().over(Window.partitionBy("kind", "key").orderBy("created_at", "candidate_id"))).filter(F.col("n") <= cap + 1)
    both = keys.select(F.col("candidate_id").alias("base_id"), "kind", "key").join(oldest.select(F.col("candidate_id").alias("other_id"), F.col("created_at").alias("other_at"), "kind", "key"), ["kind", "key"]).filter("base_id <> other_id")
    both = both.select("base_id", "other_id", "other_at").distinct()
    return both.withColumn("n", F.row_number().over(Window.partitionBy("base_id").orderBy("other_at", "other_id"))).filter(F.col("n") <= cap).select("base_id", "other_id")


def _block_keys() -> dict[str, Column]:
    return {k: F.when(has_text(F.col(c)), fold(F.col(c))) for k, c in (("b_url", "normalized_profile_url"), ("b_slug", "profile_slug"), ("b_name", "full_name"))}


def blocked_counts(candidates: DataFrame) -> DataFrame:
    """base_id, others: how many share a URL, a slug or a name with each, from the sizes of groups (no pairs are made); candidate_id is unique."""
    keys = list(_block_keys())
    rows = candidates.select("candidate_id", *(c.alias(k) for k, c in _block_keys().items()))
    out, total = rows, F.lit(-1)
    for n in (1, 2, 3):
        for some in combinations(keys, n):
            name = "n_" + "_".join(some)
            size = rows.dropna(subset=list(some)).groupBy(*some).agg(F.count(F.lit(1)).alias(name))
            out = out.join(size, list(some), "left")
            total = total + F.coalesce(F.col(name), F.lit(0)) * (1 if n % 2 else -1)
    return out.select(F.col("candidate_id").alias("base_id"), total.alias("others")).filter("others > 0")


def match_keys(candidates: DataFrame) -> DataFrame:
    """candidate_id, what blocks compare (b_url, b_slug, b_name) and what scores compare, folded; written once where several steps read it."""
    cols = ["normalized_profile_url", "profile_slug", "headline", "city", "current_company"]
    return candidates.select("candidate_id", *(c.alias(k) for k, c in _block_keys().items()), *(fold(clean(F.col(c))).alias(c) for c in cols), fold(person_name(F.col("full_name"))).alias("full_name"))


#: R5's sure scores from the best: score, reason, the columns that are equal.
SURE = [
    (1.0, "exact_profile_url", ["normalized_profile_url"]), (0.99, "exact_profile_slug", ["profile_slug"]),
    (0.95, "exact_name_headline_city", ["full_name", "headline", "city"]), (0.9, "exact_name_company", ["full_name", "current_company"]),
]


def best_duplicates(candidates: DataFrame, min_score: float = 0.8, limit: int = 20) -> DataFrame:
    """Each candidate's best duplicates, ranked, with the columns of duplicate_scores().

    A pair's best level is its score. A level's key that lacks an other which it should have has `limit` smaller ids
    instead, which come first in the ranking too, so that others of a base's best `limit` are never missed or scored low.
    """
    kinds = _levels(min_score)
    scores = _leveled_pairs(candidates, limit, min_score).repartition("base_id").groupBy("base_id", "other_id").agg(F.min("level").alias("level"))
    of = lambda values: F.get(F.array(*values), F.col("level"))
    fields = of([F.array(*map(F.lit, fields)) for *_, fields in kinds])
    return suggestions(scores.select("base_id", "other_id", of([F.lit(k[1]) for k in kinds]).alias("score"), fields.alias("matched_fields"), of([F.lit(k[2]) for k in kinds]).alias("reason")), min_score, limit)


def _levels(min_score: float) -> list[tuple[list[str], float, str, list[str]]]:
    """R4, R5 as keys, best first: columns of match_keys() whose equality gives a pair at least a score, score, reason, matched fields."""
    out = [([block, *level], score, reason, level) for score, reason, level in SURE for block in _block_keys()]
    if min_score <= 0.85:  # near names that share a URL or slug are above; else the names are equal
        out += [(["b_name", *more], 0.85, "fuzzy_name_with_supporting_fields", ["fuzzy_full_name", *more]) for more in (["headline", "city"], ["headline"], ["city"])]
    return out


def _leveled_pairs(candidates: DataFrame, limit: int, min_score: float, keys: DataFrame | None = None) -> DataFrame:
    """base_id, other_id, level (place among _levels()): each base with the smallest limit + 1 ids of each of its keys.

    Rows meet in their key's group in one shuffle; nothing is joined, so no side can be taken for a small one.
    """
    rows = match_keys(candidates) if keys is None else keys
    each = [F.when(reduce(Column.__and__, (F.col(c).isNotNull() for c in level)), F.struct(F.lit(i).alias("level"), F.array(*level).alias("key"))) for i, (level, *_) in enumerate(_levels(min_score))]
    keyed = rows.select(F.col("candidate_id").alias("base_id"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("base_id", "x.level", "x.key")
    group = Window.partitionBy("level", "key")
    ranked = keyed.withColumn("n", F.row_number().over(group.orderBy("base_id")))
    firsts = ranked.withColumn("firsts", F.collect_list(F.when(F.col("n") <= limit + 1, F.col("base_id"))).over(group))
    return firsts.select("base_id", F.explode("firsts").alias("other_id"), "level").filter("base_id <> other_id")


def best_pairs(candidates: DataFrame, limit: int, min_score: float, keys: DataFrame | None = None) -> DataFrame:
    """The pairs of blocked_pairs() without a cap among which each base's best `limit` by R5's score and other_id are.

    Equal keys of a level give at least its score, so of each level's key the smallest limit + 1 ids suffice,
    and what is made grows with the candidates, not with the square of a group. keys: match_keys(), if written already.
    """
    return _leveled_pairs(candidates, limit, min_score, keys).select("base_id", "other_id").distinct()


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; Spark has edit distance only."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def duplicate_scores(pairs: DataFrame, candidates: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """base_id, other_id, score, matched_fields, reason; only pairs of near names with a supporting field reach Python. keys: match_keys(), if written already."""
    cols = ["normalized_profile_url", "profile_slug", "full_name", "headline", "city", "current_company"]
    keyed = Scratch(pairs.sparkSession, "duplicates").keep(match_keys(candidates)) if keys is None else keys  # both sides of a pair read it
    side = lambda p: keyed.select(F.col("candidate_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    rows = pairs.join(side("base"), "base_id").join(side("other"), "other_id")
    same = {c: F.coalesce(F.col(f"base_{c}") == F.col(f"other_{c}"), F.lit(False)) for c in cols}
    rows = rows.select("base_id", "other_id", "base_full_name", "other_full_name", *(same[c].alias(f"s_{c}") for c in cols))
    s = {c: F.col(f"s_{c}") for c in cols}
    sure = F.when(s["normalized_profile_url"], 1.0).when(s["profile_slug"], 0.99).when(s["full_name"] & s["headline"] & s["city"], 0.95).when(s["full_name"] & s["current_company"], 0.9)
    rows = rows.withColumn("sure", sure)
    exact, maybe = rows.filter("sure is not null"), rows.filter("sure is null and (s_headline or s_city)")
    # Equal names have the ratio 1 and need no Python.
    alike = maybe.filter("s_full_name").withColumn("ratio", F.lit(1.0)).unionByName(maybe.filter("not s_full_name").withColumn("ratio", matching_ratio("base_full_name", "other_full_name")))
    fuzzy = alike.filter("ratio >= 0.85").withColumn("sure", F.least(F.lit(0.89), 0.65 + F.col("ratio") * 0.2)).drop("ratio").withColumn("fuzzy", F.lit(True))
    rows = exact.withColumn("fuzzy", F.lit(False)).unionByName(fuzzy)
    some = lambda *xs: F.array_compact(F.array(*xs))
    fields = (
        F.when(F.col("fuzzy"), some(F.lit("fuzzy_full_name"), F.when(s["headline"], F.lit("headline")), F.when(s["city"], F.lit("city"))))
        .when(F.col("sure") == 1.0, F.array(F.lit("normalized_profile_url"))).when(F.col("sure") == 0.99, F.array(F.lit("profile_slug")))
        .when(F.col("sure") == 0.95, F.array(F.lit("full_name"), F.lit("headline"), F.lit("city"))).otherwise(F.array(F.lit("full_name"), F.lit("current_company")))
    )
    reason = F.when(F.col("fuzzy"), "fuzzy_name_with_supporting_fields").when(F.col("sure") == 1.0, "exact_profile_url").when(F.col("sure") == 0.99, "exact_profile_slug").when(F.col("sure") == 0.95, "exact_name_headline_city").otherwise("exact_name_company")
    return rows.select("base_id", "other_id", F.round("sure", 4).alias("score"), fields.alias("matched_fields"), reason.alias("reason"))


def suggestions(scores: DataFrame, min_score: float = 0.8, limit: int = 20) -> DataFrame:
    """Each base's best duplicates, ranked."""
    ranked = scores.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("score"), "other_id")))
    return ranked.filter(F.col("rank") <= limit)


def meaningful(df: DataFrame, c: str) -> Column:
    return has_text(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).isNotNull()


def survivorship(members: DataFrame, fields: Sequence[str] = MERGE_FIELDS) -> DataFrame:
    """cluster_id, the surviving value of each field, conflicts, warnings.

    members: cluster_id, strategy, ord (0: target), updated_at and the fields. keep_target and
    prefer_non_empty take the first value in order, prefer_newest that of the row updated last.
    """
    newest = F.col("strategy") == "prefer_newest"
    rank = F.struct(F.when(newest, -F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62)))).otherwise(0).alias("at"), F.col("ord"))
    picks = [F.min_by(f, F.when(meaningful(members, f), rank)).alias(f) for f in fields]
    many = F.array_compact(F.array(*(F.when(F.count_distinct(F.when(meaningful(members, f), F.col(f))) > 1, F.lit(f)) for f in fields)))
    out = members.groupBy("cluster_id").agg(*picks, many.alias("conflicts"))
    review = F.when(F.array_contains("conflicts", "normalized_profile_url"), F.array(F.lit("profile_url_conflict_requires_identity_review"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("warnings", F.concat(F.transform("conflicts", lambda f: F.concat(F.lit("field_conflict:"), f)), review))


def moved(children: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children under their merge's target, and how many moved to each target. plan: target_id, source_id."""
    m = plan.select(F.col("source_id").alias("candidate_id"), "target_id")
    rows = children.join(m, "candidate_id", "left")
    return rows.withColumn("candidate_id", F.coalesce("target_id", "candidate_id")).drop("target_id"), rows.filter("target_id is not null").groupBy("target_id").agg(F.count(F.lit(1)).alias("moved"))


def merged_skills(skills: DataFrame) -> DataFrame:
    """One row for each candidate, name and source: highest confidence and endorsements."""
    return skills.groupBy("candidate_id", F.lower("normalized_name").alias("normalized_name"), "source").agg(F.max("confidence").alias("confidence"), F.max("endorsement_count").alias("endorsement_count"))


def merged_languages(languages: DataFrame) -> DataFrame:
    """One row for each candidate and language; the first proficiency in order (ord: the target's first)."""
    return languages.groupBy("candidate_id", "language_normalized").agg(F.max("confidence").alias("confidence"), F.min_by("proficiency", F.when(has_text(F.col("proficiency")), F.col("ord"))).alias("proficiency"))


def joined_notes(left: Column, right: Column, label: Column) -> Column:
    """Equal or blank notes collapse, others are joined under a label."""
    l, r = F.trim(F.coalesce(left, F.lit(""))), F.trim(F.coalesce(right, F.lit("")))
    return F.when((r == "") | (l == r), left).when(l == "", right).otherwise(F.concat(left, F.lit("\n\n["), label, F.lit("]\n"), right))


def merged_entries(entries: DataFrame, note: str, arrays: Sequence[str] = ()) -> DataFrame:
    """One row for each job and candidate: the first in order (ord) stays, notes are joined, arrays united."""
    keep = [c for c in entries.columns if c not in ("job_id", "candidate_id", "ord", "label", note, *arrays)]
    by_order = lambda *c: F.array_sort(F.collect_list(F.struct("ord", *c)))
    out = entries.groupBy("job_id", "candidate_id").agg(*(F.min_by(c, "ord").alias(c) for c in keep), by_order(note, "label").alias("notes"), *(F.array_distinct(F.flatten(F.transform(by_order(F.coalesce(F.col(a), F.array().cast("array<string>")).alias("v")), lambda x: x["v"]))).alias(a) for a in arrays))
    text = F.aggregate(F.slice("notes", F.lit(2), F.size("notes")), F.col("notes")[0][note], lambda acc, x: joined_notes(acc, x[note], x["label"]))
    return out.withColumn(note, text).drop("notes")


def plan_errors(plan: DataFrame, candidates: DataFrame, most: int = 20, overrides: DataFrame | None = None) -> DataFrame:
    """cluster_id, errors of each merge plan (cluster_id, target_id, source_id) for itself, and of the values that it sets (overrides: cluster_id and columns)."""
    ids = candidates.select(F.col("candidate_id").alias("known"))
    missing = plan.select("cluster_id", F.explode(F.array("target_id", "source_id")).alias("known")).join(ids, "known", "left_anti").select("cluster_id").distinct().withColumn("missing", F.lit(True))
    n = plan.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("d"), F.max(F.col("source_id") == F.col("target_id")).alias("own"), F.count_distinct("target_id").alias("t")).join(missing, "cluster_id", "left")
    set_, wrong = [c for c in (overrides.columns if overrides is not None else []) if c != "cluster_id"], {}
    if set_:
        rule = {"protected_fields": reduce(Column.__or__, [F.col(c).isNotNull() for c in set_ if c not in MERGE_FIELDS or c in PROTECTED_FIELDS], F.lit(False))}
        rule |= {"invalid_months": F.col("total_experience_months") < 0} if "total_experience_months" in set_ else {}
        rule |= {"invalid_status": ~F.col("profile_status").isin(PROFILE_STATES)} if "profile_status" in set_ else {}
        n = n.join(overrides.groupBy("cluster_id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(f"o_{k}") for k, c in rule.items())), "cluster_id", "left")
        wrong = {k: F.col(f"o_{k}") for k in rule}
    say = lambda cond, what: F.when(cond, F.lit(what))
    errors = {"too_many_sources": F.col("n") > most, "repeated_source": F.col("d") < F.col("n"), "target_is_source": F.col("own"), "several_targets": F.col("t") > 1, "candidate_missing": F.col("missing")} | wrong
    return n.select("cluster_id", F.array_compact(F.array(*(say(c, k) for k, c in errors.items()))).alias("errors")).filter(F.size("errors") > 0)


def resolved(plan: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of the plans that hold (with `at`, their place in order), and cluster_id, errors of the others.

    Plans take effect in the order of plan_ord, then cluster_id (cluster_id alone where plan_ord is missing). A plan
    that names a candidate which an earlier plan that holds has merged away is rejected with candidate_missing. In
    each round the plans are decided that no undecided earlier one can take a candidate from, and those that name one
    just taken; plans that share their target only are decided together. Rounds are as many as the longest chain of
    plans that wait for each other; only ids of undecided plans are kept from one to the next.
    """
    scratch = scratch or Scratch(plan.sparkSession, "merge")
    at = F.struct("plan_ord", "cluster_id") if "plan_ord" in plan.columns else F.struct("cluster_id")
    rows = scratch.keep(plan.withColumn("at", at))
    wrong = scratch.keep(plan_errors(rows, candidates, overrides=overrides))
    pending = scratch.keep(rows.join(wrong, "cluster_id", "left_anti").select("cluster_id", "at", "target_id", "source_id"))
    holding, rejected = [], [wrong]
    while not pending.isEmpty():
        names = pending.select("cluster_id", "at", F.explode(F.array("target_id", "source_id")).alias("candidate_id")).distinct()
        takers = pending.groupBy(F.col("source_id").alias("candidate_id")).agg(F.min("at").alias("first_at"))
        waits = names.join(takers, "candidate_id").filter(F.col("first_at") < F.col("at")).select("cluster_id").distinct()
        ready = scratch.keep(pending.join(waits, "cluster_id", "left_anti"))
        taken = ready.select(F.col("source_id").alias("candidate_id"))
        late = scratch.keep(names.join(ready.select("cluster_id").distinct(), "cluster_id", "left_anti").join(taken, "candidate_id", "left_semi").select("cluster_id").distinct())
        before, pending = pending, scratch.keep(pending.join(ready.select("cluster_id").distinct(), "cluster_id", "left_anti").join(late, "cluster_id", "left_anti"))
        scratch.drop(before)
        holding.append(ready.select("cluster_id").distinct())
        rejected.append(late.select("cluster_id", F.array(F.lit("candidate_missing")).alias("errors")))
    held = reduce(DataFrame.unionByName, holding) if holding else rows.select("cluster_id").limit(0)
    return rows.join(held, "cluster_id", "left_semi"), reduce(DataFrame.unionByName, rejected)


def consolidated(name: str, rows: DataFrame) -> DataFrame:
    """A child table whose rows stand under their targets, without repeats. rows: also ord (0: not moved) and label."""
    if name == "skills":
        return merged_skills(rows)
    if name == "languages":
        return merged_languages(rows)
    if name in ("matches", "shortlist"):
        note, arrays = ("explanation", ["matched_requirements", "missing_requirements", "uncertain_requirements"]) if name == "matches" else ("note", [])
        return merged_entries(rows, note, [a for a in arrays if a in rows.columns])
    return rows.drop("ord", "label")


def _merged_fields(people: DataFrame, plan: DataFrame, fields: Sequence[str], overrides: DataFrame | None) -> DataFrame:
    """R7, R8 for plans of targets of one level: cluster_id, target_id, strategy, at, last (of its target), the target's fields after each plan, conflicts.

    A target's first plan weighs the target and its sources as its strategy says. Then the target is the row updated
    last, so what it has stays, and a later plan gives what it lacks; a value that a plan sets itself always wins.
    """
    first = plan.groupBy("target_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    own = plan.select("cluster_id", "target_id", "strategy", "at").distinct().join(first, "target_id")
    members = plan.select("cluster_id", "strategy", F.col("source_id").alias("candidate_id"), F.col("source_ord").alias("ord")).unionByName(own.filter(F.col("at") == F.col("first_at")).select("cluster_id", "strategy", F.col("target_id").alias("candidate_id"), F.lit(0).alias("ord")))
    members = members.join(people, "candidate_id")
    seen = members.groupBy("cluster_id").agg(*(F.collect_set(F.when(meaningful(members, f), F.col(f))).alias(f"seen_{f}") for f in fields))  # of 21 rows at most
    chosen = survivorship(members, fields).drop("conflicts", "warnings").join(seen, "cluster_id").join(own, "cluster_id")
    given = [f for f in fields if overrides is not None and f in overrides.columns]
    if given:
        chosen = chosen.join(overrides.select("cluster_id", *(F.col(f).alias(f"set_{f}") for f in given)), "cluster_id", "left")
        if "primary_profile_url" in given:
            u = canonical_url(F.col("set_primary_profile_url"))
            for f, part in (("normalized_profile_url", "url"), ("profile_slug", "slug")):
                if f in fields:
                    chosen, given = chosen.withColumn(f"set_{f}", u[part]), [*given, f]
    earlier = Window.partitionBy("target_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    had = {f: F.coalesce(*([F.last(f"set_{f}", True).over(earlier)] if f in given else []), F.first(f, True).over(earlier)) for f in fields}
    chosen = chosen.withColumns({f"had_{f}": c for f, c in had.items()})
    conflicts = F.array_compact(F.array(*(F.when(F.size(F.array_distinct(F.array_compact(F.array_append(f"seen_{f}", F.col(f"had_{f}"))))) > 1, F.lit(f)) for f in fields)))
    after = {f: F.coalesce(*([f"set_{f}"] if f in given else []), f"had_{f}", f) for f in fields}
    return chosen.select("cluster_id", "target_id", "strategy", "at", (F.col("at") == F.col("last_at")).alias("last"), *(c.alias(f) for f, c in after.items()), conflicts.alias("conflicts"))


def merge(candidates: DataFrame, plan: DataFrame, children: Mapping[str, DataFrame], overrides: DataFrame | None = None, preview: bool = False, merged_at: Column | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Candidates after all plans that hold (see resolved()), children under their targets, and an audit row for each of these plans.

    plan: cluster_id, target_id, source_id, source_ord (from 1), strategy, and plan_ord if not by cluster_id. children:
    tables with candidate_id; of skills, languages, matches and shortlist equal rows become one (R10-R14). overrides:
    cluster_id and fields whose values, where not null, win (R7). The result is that of one plan after the other: a
    candidate that is merged away after it was a target takes along what it got. Targets are done level by level, each
    after those of its sources that are targets themselves. Their quality is computed anew where candidates have one,
    and updated_at becomes merged_at (now). A preview gives the audit only.
    """
    spark, merged_at = plan.sparkSession, F.current_timestamp() if merged_at is None else merged_at
    scratch = Scratch(spark, "merge")
    held = scratch.keep(resolved(plan, candidates, overrides, scratch)[0])
    fields = [f for f in MERGE_FIELDS if f in candidates.columns]
    named = scratch.keep(held.select(F.explode(F.array("target_id", "source_id")).alias("candidate_id")).distinct())
    people = scratch.keep(candidates.join(named, "candidate_id", "left_semi"))
    own = {k: scratch.keep(df.join(named, "candidate_id", "left_semi")) for k, df in children.items()}
    todo, audits = held, []
    while not todo.isEmpty():
        open_targets = todo.select(F.col("target_id").alias("source_id")).distinct()
        waits = todo.join(open_targets, "source_id", "left_semi").select("target_id").distinct()
        level = scratch.keep(todo.join(waits, "target_id", "left_anti"))
        todo = scratch.keep(todo.join(waits, "target_id", "left_semi"))
        after = scratch.keep(_merged_fields(people, level, fields, overrides))
        gone = level.select(F.col("source_id").alias("candidate_id"))
        new = after.filter("last").select(F.col("target_id").alias("candidate_id"), *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("merged"))
        stamp = {"updated_at": F.when(F.col("merged"), merged_at.cast(people.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))} if "updated_at" in people.columns else {}
        set_ = {f: F.when(F.col("merged"), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}
        people = scratch.keep(people.join(gone, "candidate_id", "left_anti").join(new, "candidate_id", "left").withColumns(set_ | stamp).select(candidates.columns))
        to = level.select(F.col("source_id").alias("candidate_id"), F.col("target_id").alias("to_id"), "cluster_id", F.struct("at", "source_ord").alias("ord"))
        targets, counts = level.select(F.col("target_id").alias("candidate_id")).distinct(), after.select("cluster_id")
        for name, df in own.items():
            placed = df.join(to, "candidate_id", "left")
            counts = counts.join(placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(f"moved_{name}")), "cluster_id", "left")
            label = F.concat(F.lit("merged from "), F.col("candidate_id").cast("string"))
            first = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in to.schema["ord"].dataType))
            placed = placed.withColumns({"label": label, "ord": F.coalesce("ord", first), "candidate_id": F.coalesce("to_id", "candidate_id")}).drop("to_id", "cluster_id")
            # What lies at none of this level's targets has been consolidated before, or is not merged.
            here, rest = placed.join(targets, "candidate_id", "left_semi"), placed.join(targets, "candidate_id", "left_anti").drop("ord", "label")
            done = consolidated(name, here)
            own[name] = scratch.keep(done.unionByName(rest.select(*(c for c in rest.columns if c in done.columns)), allowMissingColumns=True))
        audits.append(scratch.keep(after.join(counts.fillna(0), "cluster_id").select("cluster_id", "target_id", "strategy", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("merged_fields"), "conflicts", *(f"moved_{k}" for k in own))))
    none = spark.createDataFrame([], T.StructType([*(held.schema[c] for c in ("cluster_id", "target_id", "strategy")), T.StructField("merged_fields", T.StringType()), T.StructField("conflicts", T.ArrayType(T.StringType())), *(T.StructField(f"moved_{k}", T.LongType()) for k in own)]))
    audit = reduce(DataFrame.unionByName, audits, none)
    if preview:
        return candidates, dict(children), audit
    out = {}
    for name, df in children.items():
        rest = df.join(named, "candidate_id", "left_anti")
        if name in ("skills", "languages", "matches", "shortlist"):  # of candidates that no plan names, too
            nothing = F.struct(F.lit(0).alias("ord"))
            rest = consolidated(name, rest.withColumns({"ord": nothing, "label": F.lit("")}))
        out[name] = rest.unionByName(own[name].select(rest.columns))
    rest = candidates.join(named, "candidate_id", "left_anti")
    if "data_quality_score" in people.columns:
        ids = candidates.select("candidate_id").limit(0)
        again = quality(people, *(own.get(k, ids) for k in ("experiences", "educations", "skills"))).select("candidate_id", F.col("data_quality_score").alias("new_score"))
        merged_ = held.select(F.col("target_id").alias("candidate_id"), F.lit(True).alias("merged")).distinct()
        people = people.join(again, "candidate_id", "left").join(merged_, "candidate_id", "left").withColumn("data_quality_score", F.when(F.col("merged"), F.col("new_score")).otherwise(F.col("data_quality_score"))).select(candidates.columns)
    return rest.unionByName(people.select(rest.columns)), out, audit


def profile_flags(candidates: DataFrame, experiences: DataFrame) -> DataFrame:
    """experience_years, has_complete_profile."""
    n = experiences.select("candidate_id").distinct().withColumn("has_exp", F.lit(True))
    full = has_text(F.col("full_name")) & has_text(F.col("headline")) & has_text(F.col("current_title")) & has_text(F.col("current_company"))
    return candidates.join(n, "candidate_id", "left").select("candidate_id", F.round(F.col("total_experience_months") / 12, 2).alias("experience_years"), (full & F.coalesce("has_exp", F.lit(False))).alias("has_complete_profile"))
