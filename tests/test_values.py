import datetime as dt
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from glosswork.operators import grading, measurements, reports, timestamps, versions

UTC = dt.timezone.utc


def found(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(measurements.measurements(F.col("t")).alias("m")).first()
    return [(set(m["values"]), m["unit"]) for m in row.m]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("1.000.000 mg", [{1e6}]), ("6.500 mg", [{6500.0, 6.5}]), ("12.75 kg", [{12.75}]), ("1,250.5 m3", [{1250.5}]), ("1.250,5 m3", [{1250.5}]),
        ("pH 6,5", [{6.5}]), ("５００ ppm", [{500.0}]), ("保留 5 厘米", [{5.0}]), ("8.1", []), ("2026", []), ("250 hours", []), ("5 mgx900", []), ("", []), (None, []),
    ],
)
def test_measurements(spark, text, values):
    assert [v for v, _ in found(spark, text)] == values


def test_unmatched_uses_each_counterpart_once(spark):
    m = measurements.measurements
    row = spark.createDataFrame([("6.5 mg then 6.5 mg", "6,5 mg")], "a string, b string").select(measurements.unmatched(m(F.col("a")), m(F.col("b"))).alias("x")).first()
    assert [x.raw for x in row.x] == ["6.5 mg"]


def test_unmatched_against_brute_force(spark):
    rng, pool = random.Random(3), ["6.5 mg", "6,5 kg", "6.500 mg", "6500 g", "6,500 kg", "12 bar", "１２ bar", "pH 7"]
    rows = [(" und ".join(rng.choices(pool, k=rng.randint(0, 6))), " und ".join(rng.choices(pool, k=rng.randint(0, 6)))) for _ in range(120)]
    m = measurements.measurements
    df = spark.createDataFrame(rows, "a string, b string").select(m(F.col("a")).alias("a"), m(F.col("b")).alias("b"))
    for r in df.select("a", "b", measurements.unmatched(F.col("a"), F.col("b")).alias("x")).collect():
        left, missing = [set(o["values"]) for o in r.b], []
        for one in r.a:
            hit = next((k for k, o in enumerate(left) if o & set(one["values"])), None)
            if hit is None:
                missing.append(one["raw"])
            else:
                left.pop(hit)
        assert [x["raw"] for x in r.x] == missing


@pytest.mark.parametrize(("text", "unit"), [("5\u205fbar", "bar"), ("54.\u200c0 kg", "kg"), ("3 ㎎", "mg"), ("10³ kPa", "kpa")])
def test_units_behind_any_blank(spark, text, unit):
    assert [u for _, u in found(spark, text)] == [unit]


@pytest.mark.parametrize(("en", "id_", "zh", "score", "status"), [(500, 480, 300, 100.0, "PASS"), (8000, 900, 1000, 81.79, "PASS"), (16000, 120, 1000, 65.97, "PARTIAL"), (500, 0, 0, 33.33, "FAIL"), (500, 40, 300, 72.22, "PARTIAL")])
def test_scores(spark, en, id_, zh, score, status):
    rows = spark.createDataFrame([(1, "en", en), (1, "id", id_), (1, "zh", zh), (1, None, 7)], "doc_id bigint, language string, characters int")
    got = grading.verdicts(rows).first()
    assert (got.score, got.status) == (score, status)


def instants(spark, values, zone="Europe/Berlin", order="dmy"):
    sources = spark.createDataFrame([(1, {"time_zone": zone, "date_order": order})], "id bigint, configuration map<string,string>")
    facts = spark.createDataFrame([("document", i, 1, v) for i, v in enumerate(values)], "record string, record_id bigint, source_id bigint, value string")
    got = {r.record_id: r.utc_us for r in timestamps.normalise(facts, sources).collect()}
    return [got.get(i) for i in range(len(values))]


def us(*args, zone=UTC, fold=0):
    return int(dt.datetime(*args, tzinfo=zone, fold=fold).timestamp()) * 1_000_000


def test_formats(spark):
    berlin = zoneinfo.ZoneInfo("Europe/Berlin")
    values = [
        "2024-05-03T10:00:00Z", "2024-05-03 10:00:00", "03/05/2024 10:00", "03.05.24 10:00", "05/13/2024 10:00", "2024年5月3日 下午1:05", "2024年5月3日 上午12:59",
        "3 Mei 2024 pukul 10.00 WIB", "Fri, 03 May 2024 10:00:00 +0200", "1714723200", "1714723200123", "133591968000000009", "20240503100000",
        "2024-05-03 10:00:00[Asia/Tokyo]", "2024-05-03T10:00:00.1234567Z", "unknown", "", None, "1/0/1900", "31/02/2024 10:00", "03-May-2024 10:00:00 CET",
    ]
    t = us(2024, 5, 3, 10)
    assert instants(spark, values) == [
        t, us(2024, 5, 3, 10, zone=berlin), us(2024, 5, 3, 10, zone=berlin), us(2024, 5, 3, 10, zone=berlin), us(2024, 5, 13, 10, zone=berlin),
        us(2024, 5, 3, 13, 5, zone=berlin), us(2024, 5, 3, 0, 59, zone=berlin), us(2024, 5, 3, 3), us(2024, 5, 3, 8), 1714723200_000000, 1714723200_123000,
        (133591968000000009 - 116444736000000000) // 10, us(2024, 5, 3, 10, zone=berlin), us(2024, 5, 3, 1), t + 123456, None, None, None, None, None, us(2024, 5, 3, 9),
    ]


def test_daylight_saving(spark):
    berlin = zoneinfo.ZoneInfo("Europe/Berlin")
    first = us(2024, 10, 27, 2, 30, zone=berlin, fold=0)
    assert instants(spark, ["2024-10-27 02:30:00", "27-Oct-2024 02:30:00 CET", "2024-03-31 02:30:00"]) == [first, us(2024, 10, 27, 1, 30), us(2024, 3, 31, 1, 30)]
    assert instants(spark, ["01/02/2024 10:00 CST", "01-Feb-2024 10:00:00 CST"], "Asia/Shanghai", "mdy") == [us(2024, 1, 2, 2), us(2024, 2, 1, 2)]


def test_unknown_order_follows_its_neighbours(spark):
    values = ["13/02/2024 00:00", "03/04/2024 00:00", "25/04/2024 00:00", "02/05/2024 00:00"]
    assert instants(spark, values, "UTC", "") == [us(2024, 2, 13), us(2024, 4, 3), us(2024, 4, 25), us(2024, 5, 2)]


def least_prior(spark, values):
    """What the readings alone give, without the pass."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    read = timestamps.interpretations(F.col("v"), F.lit("UTC"), F.lit(None).cast("string"), F.create_map(F.lit("x"), F.lit(1)))
    got = {r.i: r.r for r in rows.select("i", read.alias("r")).collect()}
    return [min(got[i], key=lambda x: x["prior"])["utc_us"] for i in range(len(values))]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["01/25/2024 00:00", "02/03/2024 00:00", "02/20/2024 00:00"], [us(2024, 1, 25), us(2024, 2, 3), us(2024, 2, 20)]),  # the order of what stands around
        (["2024-06-10 00:00", "07/06/2024 00:00", "2024-07-08 00:00", "09/07/2024 00:00"], [us(2024, 6, 10), us(2024, 7, 6), us(2024, 7, 8), us(2024, 9, 7)]),  # time does not run backwards
    ],
)
def test_the_pass_decides_without_a_set_order(spark, values, want):
    assert instants(spark, values, "UTC", "") == want != least_prior(spark, values)
    assert instants(spark, values, "UTC", "mdy") == want


def test_a_set_order_is_kept(spark):
    assert instants(spark, ["01/25/2024 00:00", "02/03/2024 00:00", "02/20/2024 00:00"], "UTC", "dmy")[1] == us(2024, 3, 2)


def test_blocks_agree_with_one_pass(spark):
    values = [f"{1 + i % 12:02d}/{1 + (i * 5) % 12:02d}/2024 0{i % 10}:00" for i in range(60)] + ["25/01/2024 00:00"]
    facts = spark.createDataFrame([("document", i, 1, v) for i, v in enumerate(values)], "record string, record_id bigint, source_id bigint, value string")
    read = timestamps.interpretations(F.col("value"), F.lit("UTC"), F.lit(None).cast("string"), F.create_map(F.lit("x"), F.lit(1)))
    rows = facts.select("record", "source_id", "record_id", read.alias("readings"))
    whole = {r.record_id: r.utc_us for r in timestamps.choose_readings(rows, 10_000).collect()}
    parts = {r.record_id: r.utc_us for r in timestamps.choose_readings(rows, 7).collect()}
    assert whole == parts and len(whole) == len(values)


LISTING = "source_id bigint, item_id string, etag string, size bigint, modified timestamp, hash string, is_remote boolean"
INDEX = "source_id bigint, item_id string, etag string, size bigint, modified timestamp, hash string, active boolean"


def test_snapshot_diff(spark):
    t = dt.datetime(2024, 1, 1)
    new = [(1, "a", "1", 5, t, "h", False), (1, "b", None, 5, t, None, False), (1, "c", None, 6, t, "x", False), (1, "n", None, 1, t, "y", False), (1, None, None, 1, t, None, False), (1, "a", "1", 5, t, "h", False), (1, "r", None, 9, t, None, True)]
    old = [(1, "a", "2", 5, t, "h", True), (1, "b", None, 5, t, "h", True), (1, "c", None, 5, t, "h", True), (1, "gone", None, 5, t, "h", True), (1, "off", None, 5, t, "h", False), (1, "r", None, 8, t, "h", True)]
    diff = versions.snapshot_diff(spark.createDataFrame(new, LISTING), spark.createDataFrame(old, INDEX))
    assert {r.item_id: r.outcome for r in diff.collect()} == {"a": "MODIFIED", "b": "UNCHANGED", "c": "MODIFIED", "n": "NEW", "gone": "MISSING", "r": "MODIFIED"}
    counts = versions.scan_counters(diff).first()
    assert (counts.total_found, counts.queued_for_analysis, counts.deleted_files) == (5, 4, 1)
    have = spark.createDataFrame([(1, "a", 3)], "source_id bigint, item_id string, version_number int")
    assert {r.item_id: r.version_number for r in versions.next_versions(diff, have).collect()} == {"a": 4, "c": 1, "n": 1, "r": 1}


def test_reports(spark):
    rows = spark.createDataFrame([(1, "PASS"), (2, "FAIL"), (3, "PENDING")], "id bigint, s string")
    assert reports.share(rows, "s", "PASS", ["PASS", "FAIL"]).first().percent == 50.0
    assert reports.share(rows.limit(0), "s", "PASS", ["PASS"]).first().percent is None
    assert [r.n for r in reports.count_by(rows, "s", ["ERROR", "PASS"]).orderBy("position").collect()] == [0, 1]
    kept = reports.settings(spark.createDataFrame([("k", "1", "integer"), ("l", "2", "integer")], "key string, value string, type string"), spark.createDataFrame([(1, "k", "5"), (2, "k", "6")], "id bigint, key string, value string"))
    assert {r.key: (r.value, r.overridden) for r in kept.collect()} == {"k": ("6", True), "l": ("2", False)}
