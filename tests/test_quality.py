import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from costlens.functions.currencies import currencies, named_currencies
from costlens.operators import quality


def test_clean_data_passes(make_billing):
    report = quality.quality_report(make_billing()).first()
    assert (report.overall_status, report.issues, report.warnings) == ("PASS", [], [])
    assert report.null_rate_by_field["billed_cost"] == 0.0


def test_missing_required_fields_fail(spark):
    rows = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "dataset_id string, SomeRandomColumn long")
    report = quality.quality_report(rows).first()
    assert report.overall_status == "FAIL"
    assert report.issues == [
        "Missing required fields: ['billed_cost', 'charge_period_start', 'charge_period_end', 'currency']"
    ]
    assert report.duplicate_rows == 0


def test_credits_copies_and_currencies_warn(make_billing):
    rows = make_billing(10).withColumn(
        "billed_cost", F.when(F.col("service") == "service_2", -F.col("billed_cost")).otherwise(F.col("billed_cost"))
    )
    rows = rows.unionByName(rows.limit(4)).unionByName(rows.where("service = 'service_0'").withColumn("currency", F.lit("EUR")).limit(1))
    report = quality.quality_report(rows).first()
    assert report.overall_status == "WARN"
    assert report.duplicate_rows == 5 and report.valid_rows == 30
    assert report.warnings[-1] == "Multiple currencies detected: ['EUR', 'USD']"
    assert any(w.startswith("billed_cost: 1") and w.endswith("negative values (may be credits)") for w in report.warnings)


def test_issues_in_report_order(make_billing):
    gone = F.dayofmonth("charge_period_start") <= 10
    rows = make_billing(30, 1).withColumns(
        {
            "billed_cost": F.when(~gone, F.col("billed_cost")),
            "charge_period_end": F.when(F.dayofmonth("charge_period_start") == 20, F.lit("2020-01-01").cast("timestamp_ntz")).when(
                F.dayofmonth("charge_period_start") != 21, F.col("charge_period_end")
            ),
        }
    )
    report = quality.quality_report(rows).first()
    assert report.issues == [
        "billed_cost: 10 missing values (33.3%)",
        "charge_period_end: 1 invalid or missing dates",
        "1 rows have charge_period_start > charge_period_end",
        "10 rows have missing billed_cost",
    ]


def test_both_profiles_agree(make_billing):
    rows = make_billing(20).withColumn("region", F.when(F.col("service") != "service_1", F.col("region")))
    columns = ["overall_status", "null_rate_by_field", "issues", "warnings", "duplicate_rows"]
    exact = quality.quality_report(rows).select(columns).collect()
    assert exact == quality.quality_report(rows, "none").select(columns).collect()
    near = {r.field_name: r.unique_count for r in quality.approximate_distinct(rows).collect()}
    true = {r.field_name: r.unique_count for r in quality.field_profile(rows).collect()}
    assert near["service"] == true["service"] == 3 and near["region"] == true["region"] == 1


def test_distinct_values_of_every_type(spark):
    rows = spark.createDataFrame(
        [
            ("d", 0.0, "a", 1, True, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), Decimal("1.10"), ["x"]),
            ("d", -0.0, "b", 1, None, dt.date(2024, 1, 2), dt.datetime(2024, 1, 1, 0, 0, 0, 1), Decimal("1.1"), ["x", "y"]),
            ("d", 2.5, "", 2, False, None, None, Decimal("2"), ["x, y"]),
            ("d", None, None, None, None, None, None, None, None),
            ("e", 1.0, "a", 7, True, None, None, None, []),
        ],
        "dataset_id string, billed_cost double, word string, whole int, flag boolean, day date, charge_period_start timestamp_ntz, price decimal(10,2), list array<string>",
    )
    found = {(r.dataset_id, r.field_name): (r.unique_count, r.null_count) for r in quality.field_profile(rows).collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == "d"} == {
        "billed_cost": (2, 1), "word": (3, 1), "whole": (2, 1), "flag": (2, 2), "day": (2, 2), "charge_period_start": (2, 2),
        "price": (2, 1), "list": (3, 1),
    }
    assert found["e", "day"] == (0, 1) and found["e", "word"] == (1, 0)


def test_equal_hashes_are_told_apart(spark, make_billing, monkeypatch):
    rows = make_billing(30).unionByName(make_billing(3))
    texts = rows.withColumn("resource", F.concat("resource", F.date_format("charge_period_start", "dd")))
    true = {r.field_name: r.unique_count for r in quality.field_profile(texts).collect()}
    checks = quality.row_checks(texts).collect()
    assert true["resource"] == 90 and checks[0].duplicate_rows == 9
    monkeypatch.setattr(quality, "_key", lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(3)))
    words = [f.name for f in texts.schema.fields if f.dataType.typeName() == "string" and f.name != "dataset_id"]
    forced = {r.field_name: r.unique_count for r in quality.field_profile(texts).collect()}
    assert {w: forced[w] for w in words} == {w: true[w] for w in words}
    assert quality.row_checks(texts).collect() == checks


def test_missing_keys_are_not_other_keys(spark):
    rows = spark.createDataFrame(
        [("d", "a", None), ("d", None, "a"), ("d", "ab", "c"), ("d", "a", "bc"), ("d", None, None), ("d", None, None)],
        "dataset_id string, account string, service string",
    )
    assert quality.row_checks(rows).first().duplicate_rows == 1


def test_many_currencies_are_counted_and_some_named(spark, make_billing):
    rows = make_billing(4).withColumn("currency", F.concat(F.lit("C"), F.dayofmonth("charge_period_start"), F.col("service")))
    found = named_currencies(rows, 5).first()
    assert (found.currency_count, len(found.currencies)) == (12, 5) and found.currencies == sorted(found.currencies)
    assert currencies(rows).count() == 12
    assert quality.quality_report(rows).first().currency_consistency is False
    none = quality.quality_report(rows.drop("currency")).first()
    assert none.currency_consistency is True


def _scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan")


def test_charges_are_read_once(make_billing, tmp_path):
    path = str(tmp_path / "charges")
    make_billing(10).write.parquet(path)
    billing = make_billing(1).sparkSession.read.parquet(path)
    status = quality.quality_report(billing).select("dataset_id", "overall_status", "valid_rows", "issues", "warnings")
    assert _scans(status) == 1
    for frame in (quality.findings(billing), quality.row_consistency(billing), quality.field_profile(billing)):
        assert _scans(frame) == 1
    assert _scans(quality.quality_report(billing)) == 2


def test_names_of_many_currencies_are_the_first_ones(make_billing):
    rows = make_billing(40).withColumn("currency", F.concat(F.lit("C"), F.dayofyear("charge_period_start"), F.col("service")))
    found = quality._counted(rows, quality._field_cells(rows, "none"), 5).where("name_count > 0").first()
    assert (found.name_count, found.names) == (120, sorted(r.currency for r in currencies(rows).collect())[:5])
