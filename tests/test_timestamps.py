from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recallspark.operators import timestamps as ts


def micros(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2024-03-05T06:07:08Z", None, None, micros(2024, 3, 5, 6, 7, 8)),
    ("  2024-03-05t06:07:08z ", None, None, micros(2024, 3, 5, 6, 7, 8)),
    ("2024-03-05T06:07:08.123456789Z", None, None, micros(2024, 3, 5, 6, 7, 8) + 123456),
    ("2024-03-05T06:07:08+05:30", None, None, micros(2024, 3, 5, 0, 37, 8)),
    ("2024-03-05 06:07:08.500 -0330", None, None, micros(2024, 3, 5, 9, 37, 8) + 500000),
    ("2024-03-05T06:07:08[Europe/Berlin]", None, None, micros(2024, 3, 5, 5, 7, 8)),
    ("Wed, 08 Mar 2023 17:56:00 +0200", None, None, micros(2023, 3, 8, 15, 56)),
    ("9 Sep 2023 19:18:18 UTC+10", None, None, micros(2023, 9, 9, 9, 18, 18)),
    ("2 Apr 2023, 1:58 am", "UTC", None, micros(2023, 4, 2, 1, 58)),
    ("12/11/2024 12:08:38 AM", "UTC", "MDY", micros(2024, 12, 11, 0, 8, 38)),
    ("12/11/2024 10:08:38", "UTC", "DMY", micros(2024, 11, 12, 10, 8, 38)),
    ("12/11/2024 10:08:38", "UTC", None, None),
    ("19.06.2024", "Europe/Berlin", None, micros(2024, 6, 18, 22)),
    ("2024年3月6日 上午12:24", "Asia/Shanghai", None, micros(2024, 3, 5, 16, 24)),
    ("2024年3月6日 下午1:05", "UTC", None, micros(2024, 3, 6, 13, 5)),
    ("20240305T060708Z", None, None, micros(2024, 3, 5, 6, 7, 8)),
    ("20240305 060708", "UTC", None, micros(2024, 3, 5, 6, 7, 8)),
    ("1702949113", None, None, 1702949113_000000),
    ("1702949113.755", None, None, 1702949113_755000),
    ("1702949113000", None, None, 1702949113_000000),
    ("1702949113000123", None, None, 1702949113_000123),
    ("12345", "UTC", None, None),
    # New York: the hour from one to two comes twice on 3 November 2024, the one from two to three is skipped on 10 March.
    ("2024-11-03 01:30:00", "America/New_York", None, micros(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "America/New_York", None, micros(2024, 3, 10, 7, 30)),
    ("2024-03-05 06:07:08", None, None, None),
    ("2024-03-05 06:07:08", "No/Where", None, None),
    ("2024-02-30 08:15:00", "UTC", None, None),
    ("2024-06-31T25:61:00+00:00", None, None, None),
    ("0000-00-00 00:00:00", "UTC", None, None),
    ("yesterday", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
]


def test_cases(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES) if c[1] != "No/Where"]
    df = spark.createDataFrame(rows, "i int, t string, z string, o string")
    got = {r.i: r.m for r in df.select("i", ts.utc_micros(F.col("t"), F.col("z"), F.col("o")).alias("m")).collect()}
    assert got == {i: CASES[i][3] for i, *_ in rows}


@pytest.mark.parametrize("policy,expected", [({"ambiguous": "last"}, micros(2024, 11, 3, 6, 30)), ({"ambiguous": "null"}, None)])
def test_policy_for_twice(spark, policy, expected):
    df = spark.createDataFrame([("2024-11-03 01:30:00",)], "t string")
    assert df.select(ts.utc_micros(F.col("t"), F.lit("America/New_York"), **policy).alias("m")).first().m == expected


def test_policy_for_skipped(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",)], "t string")
    assert df.select(ts.utc_micros(F.col("t"), F.lit("America/New_York"), nonexistent="null").alias("m")).first().m is None


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([], "utc string, zone string, date_order string")
    assert ts.normalize(df, "utc", zone="zone", date_order="date_order").count() == 0
