"""Boolean sourcing queries for jobs (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.functions import dictionaries as D
from rolegraph.functions.text import collapse, distinct_by_key, fold, lit_map, query_key

MAX_LENGTH, MAX_QUERIES, TARGET = 500, 10, "linkedin.com/in"
#: Fixed values in order: strategy, languages it runs for, source of its titles, how many titles, how many skills, locations, what it needs, precision, intent.
STRATEGIES = [
    ("title_location", "each", "titles", 3, 0, "all", "", 3, "title and location"),
    ("precision", "each", "titles", 2, 3, "all", "skills", 5, "strict title, skill and location"),
    ("title_skills", "each", "titles", 3, 2, "none", "skills", 4, "title and required skills"),
    ("education_location", "first", "education", 2, 0, "all", "education", 3, "education and location"),
    ("industry_title", "last", "titles", 2, -2, "none", "industry", 4, "industry and title"),
    ("required_skills", "last", "titles", 2, 3, "none", "skills", 4, "required skill focus"),
    ("recall", "each", "titles", 4, 0, "last", "", 1, "broad title recall"),
]


def plain_key(c: Column) -> Column:
    return query_key(c, normalized=True)


def quoted(c: Column) -> Column:
    """Q1: a term without quotes inside, in quotes; blank if nothing is left."""
    t = collapse(F.regexp_replace(c, '["“”]+', " "))
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.lit('"'), t, F.lit('"')))


def group(arr: Column) -> Column:
    """Q1: distinct quoted terms joined by OR; no parentheses around one."""
    terms = F.filter(F.transform(distinct_by_key(arr, plain_key), lambda x: quoted(x)), lambda x: x != "")
    return F.when(F.size(terms) > 1, F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")"))).otherwise(F.array_join(terms, ""))


def query_text(titles: Column, skills: Column, locations: Column, target: Column, most: int = MAX_LENGTH) -> Column:
    """Q2: the longest of the query's forms that fits; optional parts leave from the end, then the first title is cut."""
    title = collapse(F.regexp_replace(F.get(titles, F.lit(0)), '["“”]+', " "))
    made = F.array(F.struct(F.concat(F.lit("site:"), target).alias("site"), group(titles).alias("titles"), F.filter(F.array(group(skills), group(locations)), lambda x: x != "").alias("parts"), title.alias("first")))

    def longest(x: Column) -> Column:  # the groups are made once, all forms read them
        forms = [F.array_join(F.concat(F.array(x["site"], x["titles"]), F.slice(x["parts"], 1, F.lit(n))), " ") for n in (2, 1, 0)]
        short = F.concat(x["site"], F.lit(' "'), F.substring(x["first"], F.lit(1), F.lit(most) - F.length(x["site"]) - 4), F.lit('"'))
        return F.trim(F.coalesce(*(F.when(F.length(f) <= most, f) for f in forms), short))

    return F.transform(made, longest)[0]


def query_inputs(jobs: DataFrame, requirements: DataFrame, generic: Sequence[str] = D.GENERIC_SKILLS, places: Mapping[str, str] = D.LOCATION_NAMES) -> DataFrame:
    """Q3, Q5, Q6: canonical, skills, locations, education, industries of each job.

    jobs: job_id, job_title, city, country, required_skills, preferred_skills; requirements: job_id, type,
    normalized_value, importance, weight, confidence, seq. Only required skills count, then those of the job's arrays.
    """
    kind = lambda t: F.col("type") == t
    ordered = lambda cond, *by: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(*by, F.col("normalized_value").alias("v"))))), lambda x: x["v"])
    skill = kind("skill") & (F.col("importance") == "required") & ~fold(F.col("normalized_value")).isin(list(generic))
    per = requirements.groupBy("job_id").agg(
        F.min_by("normalized_value", F.when(kind("title"), F.col("seq"))).alias("canonical"),
        ordered(skill, (-F.col("weight")).alias("a"), (-F.col("confidence")).alias("b"), fold(F.col("normalized_value")).alias("c")).alias("req_skills"),
        *(ordered(kind(t), "seq").alias(f"req_{t}") for t in ("location", "education", "industry")),
    )
    out = jobs.join(per, "job_id", "left")
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    bare = lambda c: F.transform(array(c), lambda x: F.regexp_replace(x, "^[^:]*:", ""))
    skills = F.filter(distinct_by_key(F.concat(array("req_skills"), array("required_skills"), array("preferred_skills")), plain_key), lambda x: ~fold(x).isin(list(generic)))
    named = F.transform(F.concat(F.filter(F.array("city", "country"), lambda x: F.coalesce(x, F.lit("")) != ""), bare("req_location")), lambda x: F.coalesce(F.try_element_at(lit_map(places), F.lower(x)), x))
    return out.withColumns({"canonical": F.coalesce("canonical", F.trim(fold(F.col("job_title")))), "skills": skills, "locations": distinct_by_key(named, plain_key), "education": distinct_by_key(bare("req_education"), plain_key), "industries": distinct_by_key(bare("req_industry"), plain_key)})


def generate(inputs: DataFrame, languages: Sequence[str] = ("en", "tr"), max_queries: int = MAX_QUERIES, target: str = TARGET, titles: Mapping[str, str] = D.QUERY_TITLES) -> DataFrame:
    """Q4, Q7, Q8: jobs times strategies and languages, of equal query keys the first, at most max_queries a job.

    The strategies are a constant table of a few rows, expanded from an array in each job's row.
    """
    rows = []
    for n, (name, which, source, n_titles, n_skills, where, needs, precision, intent) in enumerate(STRATEGIES):
        chosen = {"each": list(languages), "first": list(languages[:1]), "last": list(languages[-1:])}[which]
        rows += [(n * 10 + k, name, lang, source, n_titles, n_skills, where, needs, precision, intent) for k, lang in enumerate(chosen)]
    names = ["seq", "query_type", "language", "source", "n_titles", "n_skills", "where", "needs", "precision_level", "expected_intent"]
    plan = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, r, strict=True))) for r in rows))
    q = inputs.select("*", F.explode(plan).alias("p")).select("*", "p.*").drop("p")
    q = q.filter((F.col("needs") == "") | ((F.col("needs") == "skills") & (F.size("skills") > 0)) | ((F.col("needs") == "education") & (F.size("education") > 0)) | ((F.col("needs") == "industry") & (F.size("industries") > 0)))
    known = F.try_element_at(lit_map(titles), F.col("canonical"))
    listed = F.split(F.split(known, ";")[F.when(F.col("language") == "tr", 1).otherwise(0)], r"\|")
    variants = distinct_by_key(F.coalesce(listed, F.array("job_title", "canonical")), plain_key)
    q = q.withColumns(
        {
            "included_titles": F.when(F.col("source") == "education", F.slice("education", F.lit(1), F.col("n_titles"))).otherwise(F.slice(variants, F.lit(1), F.col("n_titles"))),
            "included_skills": F.when(F.col("n_skills") < 0, F.slice("industries", F.lit(1), -F.col("n_skills"))).otherwise(F.slice("skills", F.lit(1), F.col("n_skills"))),
            "included_locations": F.when(F.col("where") == "all", F.col("locations")).when((F.col("where") == "last") & (F.size("locations") > 0), F.slice("locations", -1, 1)).otherwise(F.array().cast("array<string>")),
        }
    )
    q = q.withColumn("query_text", query_text(F.col("included_titles"), F.col("included_skills"), F.col("included_locations"), F.lit(target)))
    q = q.withColumn("normalized_query_key", query_key(F.col("query_text")))
    q = q.withColumn("again", F.row_number().over(Window.partitionBy("job_id", "normalized_query_key").orderBy("seq"))).filter("again = 1")
    q = q.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).filter(F.col("n") <= max_queries)
    return q.select("job_id", F.col("n").alias("position"), "query_type", "language", "precision_level", "expected_intent", "included_titles", "included_skills", "included_locations", "query_text", "normalized_query_key")


def persist(generated: DataFrame, stored: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q9: the queries to append, and per job generated, created, existing; draft and archived jobs get none."""
    allowed = generated.join(jobs.filter(~F.col("status").isin("draft", "archived")).select("job_id"), "job_id", "left_semi")
    marked = allowed.join(stored.select("job_id", "normalized_query_key").distinct().withColumn("stored", F.lit(True)), ["job_id", "normalized_query_key"], "left")
    counts = marked.groupBy("job_id").agg(F.count(F.lit(1)).alias("generated"), F.count_if(F.col("stored").isNull()).alias("created"), F.count_if("stored").alias("existing"))
    return marked.filter("stored is null").drop("stored"), counts


def backfilled_keys(queries: DataFrame, most: int = 1000) -> DataFrame:
    """Q10: unique keys for stored queries: the oldest keeps the key, later ones get their id as suffix."""
    k = plain_key(F.coalesce("query_text", F.lit("")))
    base = F.when(k == "", F.concat(F.lit("query:"), F.col("query_id").cast("string"))).otherwise(F.left(k, F.lit(most)))
    rows = queries.withColumn("base", base).withColumn("again", F.row_number().over(Window.partitionBy("job_id", "base").orderBy("created_at", "query_id")))
    suffix = F.concat(F.lit(":"), F.col("query_id").cast("string"))
    return rows.withColumn("normalized_query_key", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat(F.left("base", F.lit(most) - F.length(suffix)), suffix))).drop("base", "again")
