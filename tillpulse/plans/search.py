"""Sale search: keyword and day filter, facets by buyer age and gender, pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.functions.scalars import AGE_BUCKETS, UNKNOWN, age_bucket, match_all_terms, on_date, trunc_pct
from tillpulse.session import written

Day = str | dt.date

# Day searched when none is given, size of a page.
DEFAULT_DATE = "2019-03-04"
PAGE_SIZE = 10

# Facet titles and labels of the result document.
AGE_TITLE, GENDER_TITLE = "用户年龄占比", "用户性别占比"
AGE_LABELS = {"<20": "20岁以下", "20-29": "20岁到30岁", ">=30": "30岁及以上", UNKNOWN: "未知"}
GENDER_LABELS = {"M": "男", "F": "女", UNKNOWN: "未知"}


def sale_search(sales: DataFrame, date: Day | None = DEFAULT_DATE, keyword: str = "") -> DataFrame:
    """Sale details of a day (``None``: all days) whose product name holds every keyword term."""
    hits = on_date(sales, date, "dt")
    if not keyword:
        return hits
    return hits.where(match_all_terms(F.col("sku_name"), keyword))


def total_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("total"))


def _terms(hits: DataFrame, column: str, size: int | None) -> DataFrame:
    counts = hits.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.desc("n"), column)
    return ranked if size is None else ranked.limit(size)


def gender_terms(hits: DataFrame, size: int | None = None) -> DataFrame:
    """Genders by frequency, all or the ``size`` most frequent; hits without one are not counted."""
    return _terms(hits, "user_gender", size)


def age_terms(hits: DataFrame, size: int | None = None) -> DataFrame:
    """Ages in years by frequency, all or the ``size`` most frequent."""
    return _terms(hits, "user_age", size)


def _profile(hits: DataFrame) -> DataFrame:
    """Hit counts by gender and age group: one partial aggregate, a handful of rows, from which
    total and both facets follow."""
    known = F.col("user_gender").isin(*[g for g in GENDER_LABELS if g != UNKNOWN])
    gender = F.when(known, F.col("user_gender")).otherwise(UNKNOWN).alias("user_gender")
    return hits.groupBy(gender, age_bucket(F.col("user_age")).alias("age_group")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _facet(profile: DataFrame, name: str, tests: dict[str, Column]) -> DataFrame:
    """One row per bucket, also for buckets without hits; the ratio refers to all hits."""
    counts = [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"b{i}") for i, test in enumerate(tests.values())]
    wide = profile.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *counts)
    buckets = F.array(
        *[
            F.struct(
                F.lit(label).alias("bucket"),
                F.col(f"b{i}").alias("count"),
                trunc_pct(F.col(f"b{i}"), F.col("total")).alias("ratio"),
            )
            for i, label in enumerate(tests)
        ]
    )
    return wide.select(F.lit(name).alias("facet"), F.explode(buckets).alias("x")).select("facet", "x.*")


def _age_tests() -> dict[str, Column]:
    return {b: F.col("age_group") == b for b in (*AGE_BUCKETS, UNKNOWN)}


def _gender_tests() -> dict[str, Column]:
    return {g: F.col("user_gender") == g for g in sorted(GENDER_LABELS)}


def age_facet(hits: DataFrame) -> DataFrame:
    """Hits per age group; hits without a known age form a group of their own."""
    return _facet(_profile(hits), "age", _age_tests())


def gender_facet(hits: DataFrame) -> DataFrame:
    return _facet(_profile(hits), "gender", _gender_tests())


def sale_page(hits: DataFrame, page: int = 1, size: int = PAGE_SIZE, after: str | None = None) -> DataFrame:
    """Page ``page`` (from 1) in the order of the line id: every task keeps its first rows only.

    To walk far into the hits pass the last id of the page before as ``after``: then a task keeps one
    page, however far the walk has come.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    if after is not None:
        hits = hits.where(F.col("order_detail_id") > after)
    return hits.orderBy("order_detail_id").offset((page - 1) * size).limit(size)


def sale_search_document(
    sales: DataFrame, date: Day | None = DEFAULT_DATE, keyword: str = "", page: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """Total, facets and one page as a single JSON document.

    The hits are worked out once and written to the shared folder; counts and page are two passes over
    those. What reaches the last task is a handful of counts and the rows of the page.
    """
    hits = written(sale_search(sales, date, keyword), "search-hits")
    profile = _profile(hits).select(
        F.struct("user_gender", "age_group", "n").alias("counts"), F.lit(None).cast(hits.schema).alias("hit")
    )
    rows = sale_page(hits, page, size).select(
        F.lit(None).cast(profile.schema["counts"].dataType).alias("counts"), F.struct(*hits.columns).alias("hit")
    )

    def count(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("counts.n"))), F.lit(0))

    total = F.coalesce(F.sum("counts.n"), F.lit(0))
    options = {AGE_TITLE: [], GENDER_TITLE: []}
    for bucket, label in AGE_LABELS.items():
        options[AGE_TITLE].append((label, count(F.col("counts.age_group") == bucket)))
    for code, label in GENDER_LABELS.items():
        options[GENDER_TITLE].append((label, count(F.col("counts.user_gender") == code)))

    named = {f"{title}/{label}": n for title, pairs in options.items() for label, n in pairs}
    wide = profile.unionByName(rows).agg(
        total.alias("total"),
        F.sort_array(F.collect_list("hit")).alias("detail"),
        *[n.alias(name) for name, n in named.items()],
    )
    stat = F.array(
        *[
            F.struct(
                F.lit(title).alias("title"),
                F.array(
                    *[
                        F.struct(F.lit(label).alias("name"), trunc_pct(F.col(f"`{title}/{label}`"), F.col("total")).alias("value"))
                        for label, _ in pairs
                    ]
                ).alias("options"),
            )
            for title, pairs in options.items()
        ]
    )
    return wide.select(F.to_json(F.struct("total", stat.alias("stat"), "detail")).alias("document"))
