import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tillpulse import functions as fn


def test_mask_phone_by_length(spark):
    df = spark.createDataFrame([("13812345678",), ("1234567",), ("12345",), (None,)], "tel string")
    assert rows(df.select(fn.mask_phone(F.col("tel")))) == [("138****5678",), ("123****",), (None,), (None,)]


def test_create_time_is_split(spark):
    df = spark.createDataFrame([("2024-03-05 07:08:09",), ("2024-03-05",), ("rubbish",), (None,)], "create_time string")
    got = rows(fn.with_create_time(df).select("create_date", "create_hour"))
    assert got == [(dt.date(2024, 3, 5), "07"), (dt.date(2024, 3, 5), None), (None, None), (None, None)]


def test_log_time_is_cut_in_utc(spark):
    df = spark.createDataFrame([(1704067199999,), (1704067200000,)], "ts bigint")
    got = rows(fn.with_log_time(df).select("log_date", "log_hour"))
    assert got == [(dt.date(2023, 12, 31), "23"), (dt.date(2024, 1, 1), "00")]


def test_age_counts_years_of_365_days_and_buckets(spark):
    as_of = dt.date(2024, 1, 1)
    days = [20 * 365 - 1, 20 * 365, 30 * 365 - 1, 30 * 365]
    df = spark.createDataFrame([(as_of - dt.timedelta(days=d),) for d in days] + [(None,)], "birthday date")
    age = fn.age_years(F.col("birthday"), as_of)
    got = rows(df.select(age, fn.age_bucket(age)))
    assert got == [(19, "<20"), (20, "20-29"), (29, "20-29"), (30, ">=30"), (None, "unknown")]


def test_percentage_is_cut_not_rounded(spark):
    df = spark.createDataFrame([(2, 3), (1, 3), (3, 3), (0, 0)], "n bigint, total bigint")
    assert rows(df.select(fn.trunc_pct(F.col("n"), F.col("total")))) == [(66.6,), (33.3,), (100.0,), (None,)]


def test_keyword_needs_every_term(spark):
    df = spark.createDataFrame([("Small Ring",), ("small-ring, blue",), ("ringlet small",), ("荣耀 手机",), (None,)], "name string")

    def hits(keyword):
        return [r[0] for r in rows(df.where(fn.match_all_terms(F.col("name"), keyword)))]

    assert hits("ring SMALL") == ["Small Ring", "small-ring, blue"]
    assert hits("small") == ["Small Ring", "small-ring, blue", "ringlet small"]
    assert hits("手机") == ["荣耀 手机"]
    assert hits("nothing") == []
    assert len(hits("")) == 5 and len(hits(" - ")) == 5


def test_alert_id_is_device_and_minute(spark):
    df = spark.sql("select 'm' as mid, timestamp_seconds(125) as window_end")
    assert rows(fn.with_alert_id(df).select("alert_id")) == [("m_2",)]


def test_previous_day_crosses_the_year():
    assert fn.previous_day("2024-01-01") == dt.date(2023, 12, 31)
