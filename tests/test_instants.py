from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from carryover.functions.instants import not_exact_utc, utc_micros

B = "Europe/Berlin"


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-01-02T03:04:05Z", None, us(2024, 1, 2, 3, 4, 5)),
    (" 2024-01-02t03:04:05z\n", None, us(2024, 1, 2, 3, 4, 5)),
    (" 2024-01-02T03:04:05.1234567+05:30", None, us(2024, 1, 1, 21, 34, 5, micro=123456)),
    ("2024-01-02 03:04:05,9-0800", B, us(2024, 1, 2, 11, 4, 5, micro=900000)),
    ("2024-08-16T13:35:56−04:00", None, us(2024, 8, 16, 17, 35, 56)),
    ("2024-02-06T22:42:25+01:00[Europe/Berlin]", None, us(2024, 2, 6, 21, 42, 25)),
    ("2024-07-01 12:00:00 Europe/Berlin", "Asia/Tokyo", us(2024, 7, 1, 10)),
    ("2024-07-01 12:00", B, us(2024, 7, 1, 10)),
    ("2024-10-27 02:30:00", B, us(2024, 10, 27, 0, 30)),  # occurs twice: the earlier
    ("2024-03-31 02:30:00", B, None),  # never occurs
    ("2024-07-01 12:00:00", None, None),
    ("2024-07-01 12:00:00", "No/Zone", None),
    ("2024-07-01", B, None),
    ("2024-02-30T00:00:00Z", B, None),
    ("2024-01-22T25:55:02Z", B, None),
    ("0000-00-00 00:00:00", B, None),
    ("20240102T030405Z", None, us(2024, 1, 2, 3, 4, 5)),
    ("Tue, 06 Jan 2026 15:54:48 GMT", None, us(2026, 1, 6, 15, 54, 48)),
    ("Sat, 5 Jul 2025 05:42:29 +1000", None, us(2025, 7, 4, 19, 42, 29)),
    ("02.07.2023 08:06:51", "UTC", us(2023, 7, 2, 8, 6, 51)),
    ("23/12/2023 05:00", "UTC", us(2023, 12, 23, 5)),
    ("9/21/2023 2:15 PM", "UTC", us(2023, 9, 21, 14, 15)),
    ("9/21/2023, 12:05AM", "UTC", us(2023, 9, 21, 0, 5)),
    ("9/21/2023 13:05 PM", "UTC", None),
    ("1/2/2023 05:00", "UTC", None),  # day or month first?
    ("Jul 24, 2025 7:15 pm", "UTC", us(2025, 7, 24, 19, 15)),
    ("1. Mai 2024, 07:57 Uhr", "UTC", us(2024, 5, 1, 7, 57)),
    ("2024年10月3日 17:00", "UTC", us(2024, 10, 3, 17)),
    ("1717922301", None, 1717922301 * 10**6),
    ("1730229071652", None, 1730229071652000),
    ("1721371797718514", None, 1721371797718514),
    ("1721371797718514999", None, 1721371797718514),
    ("1767307602.6454899", None, 1767307602645489),
    ("2025-07-07 10:37:16 CEST", B, us(2025, 7, 7, 8, 37, 16)),
    ("2025-01-29 15:54:39 CST", "America/Chicago", us(2025, 1, 29, 21, 54, 39)),
    ("2025-01-29 15:54:39 CST", "Asia/Shanghai", us(2025, 1, 29, 7, 54, 39)),
    ("2025-01-29 15:54:39 CST", None, None),
    ("2012-07-01 12:00:00 MSK", "Europe/Moscow", us(2012, 7, 1, 8)),  # four hours from 2011 to 2014
    ("2020-07-01 12:00:00 MSK", "Europe/Moscow", us(2020, 7, 1, 9)),
    ("2009-07-01 12:00:00 MSD", "Europe/Moscow", us(2009, 7, 1, 8)),
    ("2025-07-07 10:37:16 CET", B, us(2025, 7, 7, 9, 37, 16)),
    ("1945-06-01 12:00:00 CEMT", B, us(1945, 6, 1, 9)),
    ("2025-01-29 15:54:39 EST", B, None),  # never used there
    ("2025-01-29 15:54:39 UTC", None, us(2025, 1, 29, 15, 54, 39)),
    ("yesterday", B, None),
    ("", B, None),
    (None, B, None),
    ("9" * 100_000, B, None),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(k, v, z) for k, (v, z, _) in enumerate(CASES)], "k int, v string, z string")
    return dict(df.select("k", utc_micros(F.col("v"), F.col("z"))).collect())


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(results, k):
    assert results[k] == CASES[k][2], CASES[k][:2]


def test_exact_form_is_strict(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05Z\n",), ("2024-01-02t03:04:05z",)], "v string")
    assert [r[0] for r in df.select(not_exact_utc(F.col("v"))).collect()] == [False, True, True]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "c string, zone string, y string")
    assert df.select("*", utc_micros(F.col("c"), F.col("zone")).alias("u")).count() == 0
