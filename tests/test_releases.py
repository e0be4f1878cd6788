from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from depvital.functions.versions import is_stable_looking, semver_key
from depvital.operators import releases

SCHEMA = "package_id BIGINT, version STRING, published_at TIMESTAMP, is_default BOOLEAN, is_deprecated BOOLEAN"


def day(n):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=n)


def test_slots(spark):
    rows = [
        (1, "1.0.0", day(1), True, False), (1, "1.1.0", day(9), False, False), (1, "2.0.0-rc.1", day(8), False, False),
        (2, "1.0.0-alpha", day(1), False, False), (2, "1.0.0-beta", day(2), False, True),
        (3, "r2021", day(1), False, False), (3, "r2022", day(2), False, False),
        (4, "1.9.0", day(5), False, False), (4, "1.10.0", day(4), False, False), (4, "1.10.0-rc.2", day(3), False, False),
        (5, "1.0.0", day(1), False, False), (5, "0.9.0", None, False, False),
    ]
    slots = releases.release_slots(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "1.1.0"), (2, None)], "package_id BIGINT, version STRING")
    )
    got = {r.package_id: r for r in slots.collect()}
    assert got[1].stable.version == "1.0.0" and got[1].prerelease.version == "2.0.0-rc.1"
    assert got[1].max_semver.version == "2.0.0-rc.1" and got[1].requested.version == "1.1.0"
    assert got[2].stable is None and got[2].prerelease.version == "1.0.0-beta" and got[2].requested is None
    assert got[3].max_semver.version == "r2022"
    assert got[4].stable.version == "1.9.0" and got[4].max_semver.version == "1.10.0"
    assert got[5].stable.version == "1.0.0"


def test_semver_order(spark):
    ordered = ["0.9", "v1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1",
               "1.0.0", "1.9.0", "1.10.0", "v2"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v STRING")
    assert [r.v for r in df.orderBy(semver_key(F.col("v"))).collect()] == ordered
    odd = spark.createDataFrame([("r2021",), ("1.2.3.4",), ("",)], "v STRING")
    assert odd.where(semver_key(F.col("v")).isNull()).count() == 3


def test_stable_words(spark):
    df = spark.createDataFrame([("1.0",), ("1.0-SNAPSHOT",), ("march-1",), ("1.0.dev3",), ("",)], "v STRING")
    assert [r[0] for r in df.select(is_stable_looking(F.col("v"))).collect()] == [True, False, False, False, False]


def test_fallback_and_yanked(spark):
    rows = [(1, "2.0.0", day(1), False, False), (1, "1.5.0", day(2), False, True), (1, "3.0.0-rc.1", day(3), False, False),
            (1, "1.0.0", day(4), False, False), (1, "nightly", day(5), False, False)]
    versions = spark.createDataFrame(rows, SCHEMA)
    tried = spark.createDataFrame([(1, "2.0.0")], "package_id BIGINT, version STRING")
    got = [r.version for r in releases.fallback_versions(versions, tried, 3).orderBy("position").collect()]
    assert got == ["1.0.0", "nightly", "3.0.0-rc.1"]
    files = spark.createDataFrame(
        [(1, "a", False, True), (1, "a", False, True), (1, "b", False, True), (1, "b", False, False), (1, "c", True, False),
         (1, "d", False, None)], "package_id BIGINT, version STRING, version_yanked BOOLEAN, file_yanked BOOLEAN")
    got = {r.version: r.yanked for r in releases.yanked_versions(files).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}
