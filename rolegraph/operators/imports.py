"""Search-result imports (I1-I8) and candidate discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.functions import dictionaries as D
from rolegraph.functions.text import bound, clean, headline_parts, location_parts, person_name, place_in, title_parts
from rolegraph.functions.urls import PROFILE_HOST, canonical_url
from rolegraph.operators.candidates import quality
from rolegraph.sources.scratch import Scratch

RECORD = "query_id, pos, url, title, snippet, displayed_name, displayed_headline, displayed_location, rank"


def normalized_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result rows, and the records whose URL is not valid. records: the columns of RECORD."""
    # The URL is made by a generator, so that the filter on it does not make it a second time.
    r = records.select("*", F.explode(F.array(canonical_url(F.col("url")))).alias("u")).withColumn("parts", title_parts(F.col("title")))
    text = lambda c: clean(F.col(c), unicode=False)
    good = r.filter("u.url is not null").select(
        "query_id", "pos", F.trim("url").alias("source_url"), F.col("u.url").alias("normalized_url"), F.col("u.domain").alias("source_domain"), F.col("u.slug").alias("candidate_profile_slug"), text("title").alias("title"), text("snippet").alias("snippet"),
        F.coalesce(text("displayed_name"), "parts.name").alias("displayed_name"), F.coalesce(text("displayed_headline"), "parts.headline").alias("displayed_headline"), F.coalesce(text("displayed_location"), place_in(F.col("snippet"))).alias("displayed_location"), F.col("rank").alias("result_rank"),
    )
    return good, r.filter("u.url is null").drop("u", "parts")


def first_of_url(results: DataFrame) -> DataFrame:
    """The first row of each query and URL."""
    return results.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "normalized_url").orderBy("pos"))).filter("n = 1").drop("n")


def merged(new: DataFrame, stored: DataFrame, mode: str = "merge") -> DataFrame:
    """The rows to insert. merge: only URLs that the query lacks; replace: all of them (see kept_on_replace)."""
    return new if mode == "replace" else new.join(stored.select("query_id", "normalized_url"), ["query_id", "normalized_url"], "left_anti")


def kept_on_replace(new: DataFrame, stored: DataFrame) -> DataFrame:
    """I4: stored rows of queries that the import does not replace."""
    return stored.join(new.select("query_id").distinct(), "query_id", "left_anti")


def cross_query_duplicates(results: DataFrame) -> DataFrame:
    """is_duplicate, duplicate_of_id: the earliest row of the URL, if another query has it. results: result_id, query_id, normalized_url, discovered_at."""
    first = results.groupBy("normalized_url").agg(F.min(F.struct("discovered_at", "result_id", "query_id")).alias("f"))
    other = F.col("f.query_id") != F.col("query_id")
    return results.join(first, "normalized_url").withColumns({"is_duplicate": other, "duplicate_of_id": F.when(other, F.col("f.result_id"))}).drop("f")


#: Buckets of URLs: what a batch may touch of the storage, as numbers that can be broadcast (4 MB at most).
BUCKETS = 1 << 20


def of_urls(stored: DataFrame, urls: DataFrame) -> DataFrame:
    """The stored rows whose normalized_url is among urls; others mostly leave by bucket, before anything is shuffled."""
    # Never null, so that no filter for that is put into the reading of the URLs.
    bucket = F.coalesce(F.pmod(F.xxhash64("normalized_url"), F.lit(BUCKETS)).cast("int"), F.lit(0))
    urls = urls.select("normalized_url").distinct()
    touched = F.broadcast(urls.select(bucket.alias("bucket")).distinct())  # at most BUCKETS rows
    return stored.withColumn("bucket", bucket).join(touched, "bucket", "left_semi").drop("bucket").join(urls, "normalized_url", "left_semi")


def import_batch(records: DataFrame, stored: DataFrame, mode: str = "merge") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows to insert, stored rows that stay, records without a valid URL, and the summary of each query.

    records: the columns of imports.RECORD; stored: query_id, normalized_url. merge inserts the URLs that the query lacks,
    replace all, in place of the query's stored rows. Imports take effect in order of query_id: a URL that another query
    has stored, or that an earlier query of the batch brings, is inserted and counts as a duplicate. Summary: received,
    valid, invalid, duplicate (in the batch, stored, of other queries), inserted, total (the query's rows afterwards).
    A null URL is invalid; records of a null query_id are no import and left out.
    """
    if mode not in ("merge", "replace"):
        raise ValueError("mode is merge or replace")
    key = ["query_id", "normalized_url"]
    valid, invalid = normalized_records(records.filter("query_id is not null"))
    new, batch = first_of_url(valid), records.filter("query_id is not null").select("query_id").distinct()
    # URLs are made once for the summary: all of it comes from these counts, whose column n each use reads, so that their exchange is the same one.
    counted = valid.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    urls = counted.groupBy("normalized_url").agg(F.min(F.struct("query_id", "n")).alias("f")).filter("f.n > 0").select("normalized_url", F.col("f.query_id").alias("first"))
    # What the storage has of the batch's URLs, as a few numbers for each URL.
    seen = of_urls(stored.select(*key), urls).join(batch.withColumn("own", F.lit(True)), "query_id", "left")
    other = F.when(F.col("own").isNull(), F.col("query_id")) if mode == "replace" else F.col("query_id")
    by_url = seen.groupBy("normalized_url").agg(F.min(other).alias("low"), F.max(other).alias("high"), F.max(F.when(F.col("own"), F.col("query_id"))).alias("later"))
    mine = F.lit(False) if mode == "replace" else F.col("has")
    n = counted.join(by_url, "normalized_url", "left").join(urls, "normalized_url")
    if mode == "merge":
        n = n.join(seen.filter("own").select(*key).distinct().withColumn("has", F.lit(True)), key, "left").withColumn("has", F.coalesce("has", F.lit(False)))
    q = F.col("query_id")
    elsewhere = F.coalesce(F.col("low") != q, F.lit(False)) | F.coalesce(F.col("high") != q, F.lit(False)) | (F.col("first") < q)
    elsewhere = elsewhere | F.coalesce(F.col("later") > q, F.lit(False)) if mode == "replace" else elsewhere
    counts = n.groupBy("query_id").agg(F.sum("n").alias("valid"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(mine).alias("stored"), F.count_if(~mine & elsewhere).alias("elsewhere"), F.count_if(~mine).alias("inserted"))
    before = stored.join(batch, "query_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("before"))
    out = records.filter("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("received")).join(counts, "query_id", "left").join(before, "query_id", "left").fillna(0)
    total = F.col("inserted") + (F.lit(0) if mode == "replace" else F.col("before"))
    summary = out.select("query_id", "received", "valid", (F.col("received") - F.col("valid")).alias("invalid"), (F.col("repeated") + F.col("stored") + F.col("elsewhere")).alias("duplicate"), "inserted", total.alias("total"))
    if mode == "replace":
        return new, stored.join(batch, "query_id", "left_anti"), invalid, summary
    return new.join(of_urls(stored.select(*key), new), key, "left_anti"), stored, invalid, summary


def import_summary(records: DataFrame) -> DataFrame:
    """The summary of an import into empty storage."""
    return import_batch(records, records.select("query_id", F.col("url").alias("normalized_url")).limit(0))[3]


def recounted(queries: DataFrame, results: DataFrame) -> DataFrame:
    """result_count of each query as stored now; queries with results are completed at their last discovery."""
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("discovered_at").alias("at"))
    return queries.drop("result_count", "executed_at").join(n, "query_id", "left").select("*", F.coalesce("n", F.lit(0)).alias("result_count"), F.col("at").alias("executed_at")).withColumn("status", F.when(F.col("n") > 0, F.lit("completed")).otherwise(F.col("status"))).drop("n", "at")


def distinct_urls(results: DataFrame, queries: DataFrame) -> DataFrame:
    """I8: per job."""
    return results.join(queries.select("query_id", "job_id"), "query_id").groupBy("job_id").agg(F.count_distinct("normalized_url").alias("distinct_urls"))


# Source types and reasons, and the confidence that goes with them, by case; of several that hold the first counts.
ELIGIBILITY = [
    # case, eligible, source_type, confidence, reason
    ("no_url", False, "unsupported", 0.0, "invalid_profile_url"),
    ("engine", False, "unsupported", 0.0, "search_engine_result"),
    ("network_blocked", False, "unsupported", 0.0, "non_person_linkedin_page"),
    ("network_person_named", True, "linkedin_profile", 0.98, "linkedin_profile_url"),
    ("network_person", True, "linkedin_profile", 0.9, "linkedin_profile_url"),
    ("network_other", False, "unsupported", 0.0, "non_profile_linkedin_url"),
    ("code_described", True, "github_profile", 0.8, "github_user_profile"),
    ("code", False, "github_profile", 0.3, "missing_person_metadata"),
    ("described", True, "personal_profile", 0.7, "personal_profile_metadata"),
    ("other", False, "unsupported", 0.2, "missing_person_metadata"),
]
CODE_HOSTS = ["github.com", "www.github.com"]


def eligibility(url: Column, slug: Column, name: Column, headline: Column, title: Column, blocked: Sequence[str] = D.BLOCKED_PATHS, engines: Sequence[str] = D.SEARCH_ENGINES) -> Column:
    """Struct of eligible, source_type, confidence, reason."""
    host, path = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), F.lower(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1))
    named = person_name(name).isNotNull()
    known = F.struct(url.alias("url"), slug.alias("slug"), host.alias("host"), path.alias("path"), named.alias("named"), (named | clean(headline).isNotNull() | clean(title).isNotNull()).alias("described"))
    row = lambda ok, kind, sure, why: F.struct(F.lit(ok).alias("eligible"), F.lit(kind).alias("source_type"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))

    def of(x: Column) -> Column:
        host, path, named, described = x["host"], x["path"], x["named"], x["described"]
        network = (host == PROFILE_HOST) | host.endswith("." + PROFILE_HOST)
        code = host.isin(CODE_HOSTS) & ~F.contains(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"))
        person = network & (x["slug"] != "") & path.startswith("/in/")
        holds = {
            "no_url": x["url"].isNull() | (host == ""), "engine": host.isin(list(engines)), "network_blocked": network & path.rlike("^(?:" + "|".join(blocked) + ")"), "network_person_named": person & named,
            "network_person": person, "network_other": network, "code_described": code & described, "code": code, "described": described, "other": F.lit(True),
        }
        return F.coalesce(*(F.when(holds[case], row(*values)) for case, *values in ELIGIBILITY))

    return bound(known, of)


def skip_reason(e: Column, result_id: Column, min_confidence: float = 0.7, include: Sequence | None = None, exclude: Sequence = ()) -> Column:
    """Null for rows to work on."""
    out = F.when(~e["eligible"], e["reason"]).when(e["confidence"] < min_confidence, F.lit("below_min_confidence"))
    out = F.when(result_id.isin(list(exclude)), F.lit("excluded")).otherwise(out) if exclude else out
    return F.when(~result_id.isin(list(include)), F.lit("not_included")).otherwise(out) if include is not None else out


def work(results: DataFrame, queries: DataFrame, most: int = 200, only_unlinked: bool = True) -> DataFrame:
    """D3: a job's results in order of URL and id, at most `most` a job (the request's size)."""
    rows = results.join(queries.select("query_id", "job_id"), "query_id")
    rows = rows.filter("candidate_id is null") if only_unlinked else rows
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("normalized_url", "result_id"))).filter(F.col("n") <= most).drop("n")


def discover(rows: DataFrame, candidates: DataFrame, min_confidence: float = 0.7, dry_run: bool = False) -> DataFrame:
    """What to do with each result: action, candidate_id, leader_id, and the new candidate's columns.

    rows: result_id, job_id, normalized_url, candidate_profile_slug, displayed_name, displayed_headline,
    displayed_location, title, snippet; candidates: candidate_id, normalized_profile_url, profile_slug,
    created_at. A result is linked to the candidate with its URL, else to the oldest one with its slug, else
    to the first result of its identity, which creates one. A dry run plans by exact URL only.
    """
    # Written once: the rows and their leaders both read it.
    e = eligibility(F.col("normalized_url"), F.col("candidate_profile_slug"), F.col("displayed_name"), F.col("displayed_headline"), F.col("title"))
    parts = F.struct(e.alias("e"), headline_parts(F.col("displayed_headline")).alias("h"), location_parts(F.col("displayed_location")).alias("l"), person_name(F.col("displayed_name")).alias("name"))
    r = rows.select("result_id", "job_id", "normalized_url", "candidate_profile_slug", F.explode(F.array(parts)).alias("__parts")).select("result_id", "job_id", "normalized_url", "candidate_profile_slug", "__parts.*")
    r = r.withColumns({"skip": skip_reason(F.col("e"), F.col("result_id"), min_confidence), "slug": F.lower("candidate_profile_slug")})
    r = Scratch(rows.sparkSession, "discovery").keep(r)
    by_url = candidates.filter("normalized_profile_url is not null").groupBy(F.col("normalized_profile_url").alias("normalized_url")).agg(F.min_by("candidate_id", F.struct("created_at", "candidate_id")).alias("by_url"))
    by_slug = candidates.filter("profile_slug is not null").groupBy(F.lower("profile_slug").alias("slug")).agg(F.min_by("candidate_id", F.struct("created_at", "candidate_id")).alias("by_slug"))
    r = r.join(by_url, "normalized_url", "left").join(by_slug, "slug", "left")
    known = F.col("by_url") if dry_run else F.coalesce("by_url", "by_slug")
    identity = F.col("normalized_url") if dry_run else F.coalesce("slug", "normalized_url")
    r = r.withColumns({"known": known, "identity": identity})
    leaders = r.filter("skip is null and known is null").groupBy("identity").agg(F.min_by("result_id", F.struct("normalized_url", "result_id")).alias("leader_id"))
    # As many as there are new identities, so not to be sent to every task, however small the written rows are as files.
    r = r.join(leaders.hint("merge"), "identity", "left")
    action = F.when(F.col("skip").isNotNull(), "skip").when(F.col("known").isNotNull(), "link").when(F.col("result_id") == F.col("leader_id"), "create").otherwise("link")
    action = F.when(F.lit(dry_run), F.concat(F.lit("would_"), action)).otherwise(action)
    sure = F.col("h.confidence") >= 0.9
    return r.select(
        "result_id", "job_id", action.alias("action"), F.col("known").alias("candidate_id"), F.when(F.col("skip").isNull() & F.col("known").isNull(), F.col("leader_id")).alias("leader_id"), F.coalesce("skip", "e.reason").alias("reason"), F.col("e.confidence").alias("confidence"), F.col("e.source_type").alias("source"),
        "normalized_url", F.col("candidate_profile_slug").alias("profile_slug"), F.col("name").alias("full_name"), F.col("h.headline").alias("headline"), F.when(sure, F.col("h.title")).alias("current_title"), F.when(sure, F.col("h.company")).alias("current_company"), F.col("l.location_raw").alias("location_raw"), F.col("l.city").alias("city"), F.col("l.country").alias("country"),
    )


def new_candidates(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """The candidates that discover() creates, with data_quality_score (R1 of what a result shows; there are no children yet).

    results: result_id, title, snippet, source_url. candidate_id is the result's id until the storage gives one; of rows
    that repeat an id the one with the smallest values counts, URLs first.
    """
    once = lambda df, first: df.groupBy("result_id").agg(F.min(F.struct(first, *(c for c in df.columns if c not in ("result_id", first)))).alias("x")).select("result_id", "x.*")
    seen = once(results.select("result_id", F.col("title").alias("discovery_title"), F.col("snippet").alias("discovery_snippet"), F.col("source_url").alias("primary_profile_url")), "primary_profile_url")
    made = once(decisions.filter("action = 'create'").drop("candidate_id"), "normalized_url").join(seen, "result_id")
    made = made.withColumns({"candidate_id": F.col("result_id"), "normalized_profile_url": F.col("normalized_url"), "about": F.lit(None).cast("string"), "profile_status": F.lit("discovered")})
    none = made.select("candidate_id").limit(0)
    score = quality(made, none, none, none).select("candidate_id", "data_quality_score")
    return made.drop("action", "leader_id", "reason", "confidence", "normalized_url").join(score, "candidate_id")


def discover_single(rows: DataFrame, candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """result_id, action (linked_existing or created), candidate_id, leader_id, reason, confidence, error for each wanted result_id.

    rows: those of discover() with candidate_id. A result that is linked already stays so with confidence 1.0; ids without a
    result and results that are not eligible are errors. Of results of one new identity the first creates the candidate.
    Ids asked for several times are answered once.
    """
    asked = wanted.select("result_id").distinct()
    mine = rows.join(asked, "result_id", "left_semi")
    linked = mine.filter("candidate_id is not null").select("result_id", F.lit("linked_existing").alias("action"), "candidate_id", F.lit(None).cast(mine.schema["result_id"].dataType).alias("leader_id"), F.lit("search_result_already_linked").alias("reason"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("error"))
    d = discover(mine.filter("candidate_id is null"), candidates, min_confidence=0.0)
    skip, made = F.col("action") == "skip", F.col("action") == "create"
    open_ = d.select(
        "result_id", F.when(made, "created").when(~skip, "linked_existing").alias("action"), "candidate_id", "leader_id", F.when(skip, F.col("reason")).when(made, "candidate_created").otherwise("exact_candidate_identity_match").alias("reason"),
        F.when(~skip, F.col("confidence")).alias("confidence"), F.when(skip, "search_result_not_eligible").alias("error"),
    )
    missing = asked.join(rows.select("result_id"), "result_id", "left_anti").withColumn("error", F.lit("search_result_not_found"))
    return linked.unionByName(open_).unionByName(missing, allowMissingColumns=True)


def discovery_summary(decisions: DataFrame) -> DataFrame:
    """Per job received, eligible, created, linked, skipped."""
    is_ = lambda a: F.col("action").endswith(a)
    return decisions.groupBy("job_id").agg(F.count(F.lit(1)).alias("received"), F.count_if(~is_("skip")).alias("eligible"), F.count_if(is_("create")).alias("created"), F.count_if(is_("link")).alias("linked"), F.count_if(is_("skip")).alias("skipped"), F.count_if(F.col("reason") == "invalid_profile_url").alias("invalid"))


def results_of_candidates(results: DataFrame, queries: DataFrame, jobs: DataFrame) -> DataFrame:
    """With query and job, in order of discovery."""
    q = queries.select("query_id", "job_id", "query_text")
    return results.filter("candidate_id is not null").join(q, "query_id").join(jobs.select("job_id", F.col("title").alias("job_title")), "job_id").orderBy("candidate_id", "discovered_at", "result_id")


def relinked(results: DataFrame, changes: DataFrame) -> DataFrame:
    """candidate_id from changes (result_id, new_candidate_id; null detaches). Of changes that repeat a result the largest candidate counts, null last."""
    c = changes.groupBy("result_id").agg(F.max("new_candidate_id").alias("new_candidate_id")).withColumn("changed", F.lit(True))
    return results.join(c, "result_id", "left").withColumn("candidate_id", F.when(F.col("changed"), F.col("new_candidate_id")).otherwise(F.col("candidate_id"))).drop("changed", "new_candidate_id")
