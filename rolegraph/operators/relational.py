"""Listing, filtering, counting and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.sources.scratch import Scratch


def with_counts(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """L1: a count column for each child table (name: table, foreign key), each aggregated before it joins."""

    def add(df: DataFrame, item: tuple) -> DataFrame:
        name, (child, fk) = item
        n = child.groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias(name))
        return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))

    return reduce(add, children.items(), parents)


def equals(df: DataFrame, **values) -> DataFrame:
    """L2: text columns equal a value, case aside; None is no filter."""
    for c, v in values.items():
        df = df if v is None else df.filter(F.lower(c) == v.lower() if isinstance(v, str) else F.col(c) == v)
    return df


def contains(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """L3: rows where any column contains the term, case aside; the term has no wildcards."""
    return df.filter(reduce(Column.__or__, (F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns)))


def between(df: DataFrame, column: str, lowest=None, highest=None) -> DataFrame:
    """L4: inclusive range; null values drop out where a bound is given."""
    df = df if lowest is None else df.filter(F.col(column) >= F.lit(lowest))
    return df if highest is None else df.filter(F.col(column) <= F.lit(highest))


def flagged(df: DataFrame, column: str, present: bool) -> DataFrame:
    """L5."""
    return df.filter(F.col(column).isNotNull() if present else F.col(column).isNull())


def having(df: DataFrame, child: DataFrame, key: str, fk: str, exists: bool = True) -> DataFrame:
    """Rows with (or without) a matching child."""
    return df.join(child.select(F.col(fk).alias(key)).distinct(), key, "left_semi" if exists else "left_anti")


def page(df: DataFrame, sort: str, key: str, allowed: Sequence[str], descending: bool = False, number: int = 1, size: int = 20, at_least_one: bool = False) -> tuple[DataFrame, DataFrame]:
    """One page of rows, and total, pages, page, page_size. Nulls come last ascending and first descending."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    rows = df.orderBy(F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last(), key).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total") / size).cast("long")
    meta = df.agg(F.count(F.lit(1)).alias("total")).select("total", (F.greatest(pages, F.lit(1)) if at_least_one else pages).alias("pages"), F.lit(number).alias("page"), F.lit(size).alias("page_size"))
    return rows, meta


class Ordered:
    """A table put in order once, for pages at any depth.

    Rows are dealt to tasks by ranges of the sort column and the key, so no task holds more than its range, and each
    gets its place: the range's number and its place there. A page is found from the counts of the ranges (a number
    for each task comes to the driver) and read by place, from the files of the ranges that it lies in.
    """

    def __init__(self, df: DataFrame, sort: str, key: str, allowed: Sequence[str], descending: bool = False, partitions: int | None = None, scratch: Scratch | None = None):
        if sort not in allowed:
            raise ValueError(f"cannot sort by {sort}")
        order = [F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last(), F.col(key)]
        self.columns, self.place = df.columns, "_place"
        while self.place in df.columns:
            self.place = f"_{self.place}"
        rows = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).withColumn(self.place, F.monotonically_increasing_id())
        self.rows = (scratch or Scratch(df.sparkSession, "ordered")).keep(rows)
        counts = self.rows.groupBy(F.shiftright(self.place, 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.ranges = sorted((r["range"], r["n"]) for r in counts)
        self.total = sum(n for _, n in self.ranges)

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """One page, in order; empty beyond the last one."""
        low, high, before, wanted = (number - 1) * size, number * size, 0, F.lit(False)
        for r, n in self.ranges:
            a, z = max(low, before) - before, min(high, before + n) - before
            if a < z:
                wanted = wanted | F.col(self.place).between((r << 33) + a, (r << 33) + z - 1)
            before += n
        return self.rows.filter(wanted).orderBy(self.place).select(*(F.col(f"`{c}`") for c in self.columns))


def page_each(df: DataFrame, group: str, sort: str, key: str, allowed: Sequence[str], descending: bool = False, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """L7 for each group: a page of its rows with rank, and group, total, pages, page, page_size. Nulls come last ascending and first descending.

    Spark keeps only the page's highest ranks of each task's rows before it shuffles them; totals are a count of their own.
    """
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    order = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    ranked_ = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).filter(F.col("rank") <= number * size)
    meta = df.groupBy(group).agg(F.count(F.lit(1)).alias("total")).select(group, "total", F.ceil(F.col("total") / size).cast("long").alias("pages"), F.lit(number).alias("page"), F.lit(size).alias("page_size"))
    return ranked_.filter(F.col("rank") > (number - 1) * size), meta


def count_by(child: DataFrame, parent: DataFrame, on: str, by: str) -> DataFrame:
    """Children of the filtered parents, counted by a parent's column."""
    return child.join(parent.select(on, by), on).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def job_duplicates(jobs: DataFrame) -> DataFrame:
    """job_id, first_id, copies of jobs that repeat company, title, source, and URL or (without URLs) description."""
    norm = lambda c: F.lower(F.trim(c))
    key = F.struct(norm("company").alias("c"), norm("title").alias("t"), F.col("source").alias("s"), F.col("source_url").isNull().alias("n"), F.coalesce("source_url", F.sha2(norm("description"), 256)).alias("u"))
    groups = jobs.filter("company is not null and title is not null").groupBy(key.alias("k")).agg(F.min("job_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return jobs.withColumn("k", key).join(groups, "k").select("job_id", "first_id", "copies")


def by_key(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """L10."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def cascade(deleted: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Child tables after rows of `deleted` go; children: table, foreign key, "cascade" or "set_null"."""
    out, gone = {}, deleted.select(F.col(key).alias("__gone")).distinct()
    for name, (child, fk, rule) in children.items():
        if rule == "cascade":
            out[name] = child.join(gone, F.col(fk) == F.col("__gone"), "left_anti")
        else:
            out[name] = child.join(gone, F.col(fk) == F.col("__gone"), "left").withColumn(fk, F.when(F.col("__gone").isNull(), F.col(fk))).drop("__gone")
    return out


def distribution(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    """A1: value, n; blank and null values count as unknown."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(unknown)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def buckets(df: DataFrame, column: str, edges: Sequence[tuple[str, float]] = (("low", float("-inf")), ("medium", 60.0), ("high", 80.0))) -> DataFrame:
    """A2: bucket, n for fixed lower edges; empty buckets stay."""
    one = df.agg(*(F.count_if((F.col(column) >= lo) & (F.col(column) < hi)).alias(name) for (name, lo), (_, hi) in zip(edges, [*edges[1:], ("", float("inf"))], strict=True)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(n).alias("n")) for n, _ in edges))).alias("x")).select("x.*")


def dashboard(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """A3: one row of totals."""
    a = jobs.agg(F.count(F.lit(1)).alias("jobs"), *(F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in ("parsed", "sourcing", "completed")))
    return a.crossJoin(candidates.agg(F.count(F.lit(1)).alias("candidates")))  # one row by one row


def requirement_label(r: Column) -> Column:
    """A4: the first of label, value, type of a struct, else the struct as JSON."""
    return F.coalesce(r["label"], r["value"], r["type"], F.to_json(r))


def violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """V1: df with the names of the rules (SQL conditions) that each row breaks; an unknown condition is kept."""
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(p), F.lit(True)), F.lit(n)) for n, p in rules.items()))))


def split_valid(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """V1: valid rows, and rejected rows with their violations."""
    v = violations(df, rules)
    return v.filter(F.size("violations") == 0).drop("violations"), v.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    return violations(df, rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V2: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """V3: children whose parent is missing; a null reference is none."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(fk) == F.col("__k"), "left_anti")
