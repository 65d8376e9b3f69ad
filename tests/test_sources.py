import hashlib
import time

import pytest
from pyspark.sql import functions as F

from costlens import plans, schema, session, sources
from costlens.operators import filters, quality, spend

HEADER = "BilledCost,EffectiveCost,ChargePeriodStart,ChargePeriodEnd,BillingCurrency,ProviderName,BillingAccountId,ServiceName"
ROWS = [
    "10.5,10.0,2024-01-01T00:00:00Z,2024-01-01T23:59:59Z,USD,AWS,007,EC2",
    '20.0,19.0,2024-01-02T00:00:00Z,2024-01-02T23:59:59Z,USD,AWS,007,"S3, ""cold"""',
]


@pytest.fixture()
def csv(tmp_path):
    def write(*rows, header=HEADER, name="export.csv"):
        path = tmp_path / name
        path.write_text("\n".join([header, *rows]) + "\n")
        return str(path)

    return write


def test_version_by_column_names():
    raw = HEADER.split(",")
    assert schema.detect_version(raw) == "1.0"
    assert schema.detect_version([*raw, "PricingUnit"]) == "1.0.1"
    assert schema.detect_version(schema.REQUIRED_FIELDS) == "1.0"
    assert schema.detect_version(["SomeRandomColumn"]) == "unknown"


def test_two_row_export_end_to_end(spark, csv):
    billing = sources.to_canonical(sources.read_billing(spark, csv(*ROWS)), dataset_id="d")
    assert {r.service for r in billing.collect()} == {"EC2", 'S3, "cold"'}
    assert {r.account for r in billing.collect()} == {"007"}
    report = quality.quality_report(billing).first()
    assert (report.overall_status, report.total_rows) == ("PASS", 2)
    assert spend.spend_totals(billing).first().total_billed_cost == 30.5
    assert spend.spend_trend(billing).count() == 2


def test_junk_becomes_null(spark, csv):
    rows = ["n/a,1d,bad,2024-01-01T01:00:00+02:00,NULL,NA,,x", "1e2,1.5f,2024-01-01,,USD,p,a,nan"]
    got = sources.to_canonical(sources.read_billing(spark, csv(*rows)), dataset_id="d").collect()
    first, second = got
    assert (first.billed_cost, first.effective_cost, first.charge_period_start) == (None, None, None)
    assert str(first.charge_period_end) == "2023-12-31 23:00:00"
    assert (first.currency, first.provider, first.account) == (None, None, None)
    assert (second.billed_cost, second.effective_cost, second.service) == (100.0, None, None)


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        sources.read_billing(spark, "/somewhere/export.xlsx")


def test_other_time_zone_is_refused(spark, make_billing):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            sources.to_canonical(make_billing(1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_table_keeps_other_datasets(spark, make_billing, tmp_path):
    path = str(tmp_path / "table")
    sources.write_canonical(make_billing(40, dataset_id="007").unionByName(make_billing(5, dataset_id="b")), path)
    sources.write_canonical(make_billing(2, dataset_id="b"), path)
    assert sources.scan_dataset(spark, path, "007").count() == 120
    assert sources.scan_dataset(spark, path, "b").count() == 6
    assert all("/dataset_id=b/" in name for name in sources.scan_dataset(spark, path, "b").inputFiles())
    for missing in (path, str(tmp_path / "nowhere")):
        with pytest.raises(sources.DatasetMissing, match="DATASET_STORAGE_MISSING"):
            sources.scan_dataset(spark, missing, "c")


def test_table_drops_months_that_are_gone(spark, make_billing, tmp_path):
    path = str(tmp_path / "table")
    odd = "a b/c=é%"
    for name in ("x", odd):
        sources.write_canonical(make_billing(60, dataset_id=name), path)
    later = make_billing(60, dataset_id=odd).where("charge_period_start >= TIMESTAMP_NTZ '2024-02-10'")
    sources.write_canonical(later, path)
    got = sources.read_table(spark, path).groupBy("dataset_id", "charge_month").count().collect()
    assert {(r.dataset_id, r.charge_month): r["count"] for r in got} == {
        ("x", "2024-01"): 93, ("x", "2024-02"): 87, (odd, "2024-02"): 60,
    }
    assert sources.scan_dataset(spark, path, odd).count() == 60


def content(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def test_readers_see_one_whole_version(spark, make_billing, tmp_path):
    path = str(tmp_path / "table")
    first, second = make_billing(40, dataset_id="x"), make_billing(40, services=2, dataset_id="x")
    assert sources.write_canonical(first, path)["x"].number == 1
    begun, whole = sources.scan_dataset(spark, path, "x"), sources.read_table(spark, path)
    assert sources.write_canonical(second, path)["x"].number == 2
    assert begun.count() == whole.count() == 120 and sources.scan_dataset(spark, path, "x").count() == 80
    assert sources.scan_dataset(spark, path, "x", 1).count() == 120
    assert [(v.number, v.row_count) for v in sources.versions(spark, path, "x")] == [(1, 120), (2, 80)]
    # two versions back is gone
    sources.write_canonical(first, path)
    assert [v.number for v in sources.versions(spark, path, "x")] == [2, 3]
    with pytest.raises(sources.DatasetMissing):
        sources.scan_dataset(spark, path, "x", 1)
    assert content(sources.read_table(spark, path).drop("charge_month")) == content(first)


def test_nothing_changes_before_the_manifest(spark, make_billing, tmp_path, monkeypatch):
    from costlens.sources import table

    path = str(tmp_path / "table")
    sources.write_canonical(make_billing(5, dataset_id="x"), path)

    def lost(*_):
        raise RuntimeError("lost between the two steps")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_publish", lost)
        with pytest.raises(RuntimeError):
            sources.write_canonical(make_billing(9, dataset_id="x"), path)
    assert sources.scan_dataset(spark, path, "x").count() == 15
    # a number taken by another writer meanwhile: the next one is used
    with monkeypatch.context() as patched:
        patched.setattr(table, "_numbers", lambda *_: [])
        assert sources.write_canonical(make_billing(7, dataset_id="x"), path)["x"].number == 2
    assert sources.scan_dataset(spark, path, "x").count() == 21


def test_an_empty_write_empties_a_dataset(spark, make_billing, tmp_path):
    path = str(tmp_path / "table")
    sources.write_canonical(make_billing(5, dataset_id="x").unionByName(make_billing(5, dataset_id="y")), path)
    sources.write_canonical(make_billing(5, dataset_id="x").limit(0), path, datasets=["x"])
    with pytest.raises(sources.DatasetMissing):
        sources.scan_dataset(spark, path, "x")
    assert sources.read_table(spark, path).select("dataset_id").distinct().collect() == [("y",)]
    sources.write_canonical(make_billing(5, dataset_id="y").limit(0), path, datasets=["y"])
    assert sources.read_table(spark, path).count() == 0


def test_datasets_with_other_columns(spark, make_billing, tmp_path):
    path = str(tmp_path / "table")
    sources.write_canonical(make_billing(2, dataset_id="x"), path)
    sources.write_canonical(make_billing(2, dataset_id="y").drop("region").withColumn("team", F.lit("a")), path)
    found = {r.dataset_id: (r.region, r.team) for r in sources.read_table(spark, path).collect()}
    assert found == {"x": ("us-east-1", None), "y": (None, "a")}
    sources.write_canonical(make_billing(2, dataset_id="z").withColumn("region", F.lit(1)), path)
    with pytest.raises(ValueError, match="region"):
        sources.read_table(spark, path)


def test_dates_by_the_vote_of_their_column(spark, csv):
    header = HEADER + ",BillingPeriodStart,BillingPeriodEnd"
    rows = [
        "1,1,01/05/2024,20240105,USD,p,a,s,25/12/2023,\"Jan 5, 2024\"",
        "1,1,01/25/2024 13:30,20240106,USD,p,a,s,31/12/2023,\"March 6, 2024\"",
        "1,1,2024-02-01T00:00:00Z,20241306,USD,p,a,s,01/02/2024,5 Jan 2024",
        "1,1,junk,,USD,p,a,s,,",
    ]
    raw = sources.read_billing(spark, csv(*rows, header=header))
    votes = sources.date_votes(raw)
    assert {c: (v.format, v.present, v.iso, v.parsed, v.ambiguous) for c, v in votes.items()} == {
        "charge_period_start": ("month_first", 4, 1, 2, False),
        "charge_period_end": ("compact", 3, 0, 2, False),
        "billing_period_start": ("day_first", 3, 0, 3, False),
        "billing_period_end": ("month_name", 3, 0, 2, False),
    }
    got = sources.to_canonical(raw, dataset_id="d", date_formats={c: v.format for c, v in votes.items()}).collect()
    spelt = [[str(r[c]) for r in got] for c in ("charge_period_start", "charge_period_end", "billing_period_start", "billing_period_end")]
    assert spelt == [
        ["2024-01-05 00:00:00", "2024-01-25 13:30:00", "2024-02-01 00:00:00", "None"],
        ["2024-01-05 00:00:00", "2024-01-06 00:00:00", "None", "None"],
        ["2023-12-25 00:00:00", "2023-12-31 00:00:00", "2024-02-01 00:00:00", "None"],
        ["2024-01-05 00:00:00", "2024-03-06 00:00:00", "None", "None"],
    ]


@pytest.mark.parametrize("text,name,when", [
    ("2024/1/5", "year_first", "2024-01-05 00:00:00"), ("1/5/2024 1:30 PM", "month_first", "2024-01-05 13:30:00"), ("5.1.2024", "day_first", "2024-01-05 00:00:00"),
    ("5-Jan-2024", "day_month_name", "2024-01-05 00:00:00"), ("JAN 5, 2024 07:08:09", "month_name", "2024-01-05 07:08:09"), ("1/5/24", "month_first", "2024-01-05 00:00:00"),
    ("20240105103000", "compact", "2024-01-05 10:30:00"), ("2024", "iso", "2024-01-01 00:00:00"), ("2024-01-05 10:00:00+02:00", "iso", "2024-01-05 08:00:00"),
])
def test_spellings(spark, text, name, when):
    raw = spark.createDataFrame([(text,)], "charge_period_start string")
    vote = sources.date_votes(raw)["charge_period_start"]
    assert vote.format == name and (vote.ambiguous or "/" not in text or name == "year_first")
    got = sources.to_canonical(raw, dataset_id="d", date_formats={"charge_period_start": vote.format}).first()
    assert str(got.charge_period_start) == when


def test_vote_on_nothing(spark):
    assert sources.date_votes(spark.createDataFrame([(1,)], "a int")) == {}
    empty = sources.date_votes(spark.createDataFrame([(None,), ("?",)], "charge_period_start string"))["charge_period_start"]
    assert (empty.format, empty.present, empty.parsed, empty.ambiguous) == ("iso", 1, 0, False)


def test_ingest_of_other_dates(spark, tmp_path):
    path, table = tmp_path / "export.csv", str(tmp_path / "table")
    path.write_text(HEADER + "\n" + "\n".join(r.replace("2024-01-01T00:00:00Z", "01/13/2024").replace("2024-01-02T00:00:00Z", "01/02/2024") for r in ROWS) + "\n")
    got = plans.ingest(spark, str(path), table, dataset_id="x")
    assert {str(r.charge_period_start) for r in got.rows.collect()} == {"2024-01-13 00:00:00", "2024-01-02 00:00:00"}
    assert [(v.format, v.ambiguous) for v in got.date_votes.values()] == [("month_first", False)]
    assert got.quality.first().total_rows == 2
    assert [v.number for v in sources.versions(spark, table, "x")] == [1]
    assert len(list((tmp_path / "table" / "data").iterdir())) == 1


def test_periods_on_month_folders(spark, make_billing, tmp_path):
    path = str(tmp_path / "table")
    plain = make_billing(60)
    sources.write_canonical(plain, path)
    for bounds in (("2024-1-02", None), (None, "2024"), ("2024", "2024-2-3"), ("2024-01-31 12:00:00", "2024-02-01")):
        for inclusive in (False, True):
            want = filters.in_period(plain, *bounds, end_inclusive=inclusive).count()
            assert filters.in_period(sources.read_table(spark, path), *bounds, end_inclusive=inclusive).count() == want
    plan = filters.in_period(sources.read_table(spark, path), "2024-2-1")._jdf.queryExecution().executedPlan().toString()
    assert "charge_month" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_hash_in_several_chunks(spark, tmp_path):
    content = bytes(range(256)) * 50
    (tmp_path / "big.bin").write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.content_hash) for r in sources.file_hashes(spark, str(tmp_path), "*.bin", chunk=1000).collect()}
    assert got == {"big.bin": (12800, hashlib.sha256(content).hexdigest())}


def test_provenance_of_a_file(spark, make_billing, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    hashes = sources.file_hashes(spark, str(tmp_path))
    columns = ["BilledCost", "ChargePeriodStart", "ChargePeriodEnd", "BillingCurrency", "PricingUnit"]
    got = sources.provenance(make_billing(2), raw_columns=columns, hashes=hashes).first()
    assert (got.focus_version, got.content_hash, got.row_count) == ("1.0.1", hashlib.sha256(b"x").hexdigest(), 6)
    assert got.ingested_at is not None


def test_hashes_and_unseen_files(spark, tmp_path):
    for name in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / name).write_text(name)
    found = sources.file_hashes(spark, str(tmp_path), "*.csv")
    got = {r.path.rsplit("/", 1)[-1]: r.content_hash for r in found.collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.csv", "b.csv")}
    known = spark.createDataFrame([(got["a.csv"],)], "content_hash string")
    assert [r.path[-5:] for r in sources.unseen_files(found, known).collect()] == ["b.csv"]


def test_hash_of_many_files(spark):
    def of(names, width=1024, parts=3):
        rows = [(hashlib.sha256(n.encode()).hexdigest(),) for n in names]
        return sources.combined_hash(spark.createDataFrame(rows, "content_hash string").repartition(parts), width)

    names = [f"file {i}" for i in range(300)]
    plain = hashlib.sha256("\n".join(sorted(hashlib.sha256(n.encode()).hexdigest() for n in names)).encode()).hexdigest()
    assert of(names) == plain and of(["a"]) == hashlib.sha256(b"a").hexdigest() and of([]) is None
    # a tree of three levels, whatever the order
    tree = of(names, 4)
    assert tree != plain and tree == of(names[::-1], 4, 5)
    assert len({tree, of(names[1:], 4), of([*names, "file 7"], 4), of(["x", *names[1:]], 4)}) == 4
    assert len({of(["a", "a"]), of(["a"]), of(["a", "a", "a"])}) == 3


def test_provenance_names_all_currencies(spark, make_billing):
    rows = make_billing(25, services=1).withColumn("currency", F.concat(F.lit("C"), F.dayofyear("charge_period_start")))
    got = sources.provenance(rows).first()
    assert got.currency == ",".join(sorted(f"C{i}" for i in range(1, 26))) and got.currency_count == 25
    none = sources.provenance(rows.drop("currency")).first()
    assert (none.currency, none.currency_count, none.row_count) == (None, 0, 25)


def test_provenance_falls_back_to_billing_period(spark):
    rows = spark.sql(
        "SELECT 'd' AS dataset_id, CAST(NULL AS timestamp_ntz) AS charge_period_start, "
        "CAST('2024-02-01' AS timestamp_ntz) AS billing_period_start, c AS currency FROM VALUES ('USD'), ('EUR'), (NULL) AS t(c)"
    )
    got = sources.provenance(rows).first()
    assert (got.row_count, got.currency, str(got.date_range_end)) == (3, "EUR,USD", "2024-02-01 00:00:00")


def test_ingest_reads_checks_and_records(spark, tmp_path):
    path, table = tmp_path / "export.csv", str(tmp_path / "table")
    path.write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    got = plans.ingest(spark, str(path), table, dataset_id="x")
    report, record = got.quality.first(), got.provenance.first()
    assert (report.total_rows, report.overall_status, got.rows.count()) == (2, "PASS", 2)
    assert record.content_hash == hashlib.sha256(path.read_bytes()).hexdigest()
    assert (record.row_count, record.focus_version, record.source_url) == (2, "1.0", str(path))
    path.write_text(HEADER + "\n" + ROWS[0] + "\n")
    assert plans.ingest(spark, str(path), table, dataset_id="x").rows.count() == 1
    path.write_text(HEADER + "\n")
    with pytest.raises(plans.IngestError, match="no rows"):
        plans.ingest(spark, str(path), table, dataset_id="x")
    with pytest.raises(sources.DatasetMissing):
        sources.scan_dataset(spark, table, "x")
    path.write_text(HEADER + "\n" + ROWS[0] + "\n")
    plans.ingest(spark, str(path), table, dataset_id="x")
    path.write_text("ServiceName,BilledCost\na,1\n")
    with pytest.raises(plans.IngestError, match="charge_period_start"):
        plans.ingest(spark, str(path), table, dataset_id="x")
    assert sources.read_table(spark, table).count() == 1


def test_arranged_rows_are_written_without_a_shuffle(spark, make_billing, tmp_path):
    """Rows read from the table lie by dataset and month already; writing them again gives the same rows."""
    path = str(tmp_path / "table")
    sources.write_canonical(make_billing(40), path)
    stored = sources.read_table(spark, path)
    before = sorted(map(str, stored.collect()))
    hints = []
    kind, hint = type(stored), type(stored).hint

    def noted(frame, name, *more):
        hints.append(name)
        return hint(frame, name, *more)

    kind.hint = noted
    try:
        sources.write_canonical(stored, path, arranged=True)
    finally:
        kind.hint = hint
    assert not hints and sorted(map(str, sources.read_table(spark, path).collect())) == before


def test_second_writes_read_the_first_version(spark, monkeypatch):
    """The tables behind the charges are joined once for both writes."""
    from verification import QUERIES, source_queries

    made = []
    everything = source_queries.everything
    monkeypatch.setattr(source_queries, "everything", lambda *given, **named: made.append(named) or everything(*given, **named))
    written = []
    write = source_queries.sources.write_canonical
    monkeypatch.setattr(source_queries.sources, "write_canonical", lambda df, *given, **named: written.append(df) or write(df, *given, **named))
    QUERIES["emptied_dataset"](spark, "/root/testdata/sf0.001").collect()
    assert made == [{"arranged": True}]
    assert all("/data/version=" in name for name in written[1].inputFiles())


@pytest.fixture()
def order_tables(spark, tmp_path):
    """Order lines of two years, some without a date, a part or an order, a part that stands twice, one without a key; and events."""
    day = "TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(CAST(id * 7 % 730 AS INT))"
    texts = {
        "region": "SELECT CAST(id AS INT) r_regionkey, concat('R', id) r_name FROM range(2)",
        "nation": "SELECT CAST(id AS INT) n_nationkey, concat('N', id) n_name, CAST(id % 2 AS INT) n_regionkey FROM range(5)",
        "customer": "SELECT id c_custkey, concat('S', id % 3) c_mktsegment, sha2(string(id), 256) c_name FROM range(900)",
        "supplier": "SELECT id s_suppkey, CAST(id % 6 AS INT) s_nationkey FROM range(9)",
        "part": "SELECT nullif(id % 800, 7) p_partkey, concat('B', id % 4) p_brand, concat(sha2(string(id), 256), ' T') p_type FROM range(801)",
        "orders": "SELECT id o_orderkey, id % 950 o_custkey, sha2(string(id), 256) o_comment FROM range(1200)",
        "lineitem": f"""SELECT nullif(id % 1300, 3) l_orderkey, CAST(id % 8 AS INT) l_linenumber, nullif(id * 13 % 820, 5) l_partkey, id % 11 l_suppkey,
            double(id % 50) l_quantity, id * 1.25D l_extendedprice, 0.05D l_discount, 0.02D l_tax, 'R' l_returnflag, 'O' l_linestatus,
            CASE WHEN id % 97 > 0 THEN {day} END l_shipdate FROM range(4000)""",
        "events": "SELECT TIMESTAMP_NTZ '2024-01-05 01:00:00' ts, id user_id, 'view' event_type, 1.5D value FROM range(20)",
    }
    for name, text in texts.items():
        spark.sql(text).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_arranged_lines_move_for_orders_and_parts_only(spark, order_tables):
    """The join with the parts brings the months together: no shuffle of whole lines follows it, and no row is lost or doubled."""
    from verification import inputs

    joins = {"spark.sql.autoBroadcastJoinThreshold": "6000", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    with session.during(spark, joins | inputs.MONTH_BINS):
        lines = inputs.tpch(spark, order_tables, keep=("l_orderkey", "l_linenumber"), arranged=True)
        plan = lines._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sum("SortMergeJoin" in line for line in plan) == 3
        moved = [line for line in plan if "Exchange hashpartitioning" in line]
        assert len(moved) == 6 and sum("l_orderkey" in line for line in moved) == 2
        assert not any("p_partkey" in line and "month(" in line for line in moved)
        month = F.coalesce(F.month("charge_period_start"), F.lit(1))
        held = lines.groupBy(F.spark_partition_id(), month).count().count()
        assert held <= 12 * (24 // 12)
        arranged = sorted(map(str, lines.collect()))
    plain = inputs.tpch(spark, order_tables, keep=("l_orderkey", "l_linenumber"))
    assert arranged == sorted(map(str, plain.collect())) and len(arranged) > 4000


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name.split("/shuffle_")[1].split("_")[0] for name in files.split("\n") if "/shuffle_" in name}


def test_a_write_leaves_no_shuffle_files(spark, make_billing, tmp_path):
    """What a write has shuffled is gone when it ends, and the session's settings are as before."""
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "3")
    before, changed = _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    billing = make_billing(60).repartition(3)
    sources.table.stage(billing, str(tmp_path / "table"))
    end = time.monotonic() + 20
    while (left := len(_shuffled(spark) - before)) > 1 and time.monotonic() < end:
        time.sleep(0.2)
    assert left <= 1  # that of the count that follows the write
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "3" and spark.conf.get(changed) == "false"
    spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")
    assert billing.count() == 180


def test_stored_content_counts_distinct_resources_apart(spark, make_billing):
    """The rows are those of one aggregation, and no shuffled row has the sums beside a resource."""
    from verification import source_queries

    rows = make_billing(9).withColumn("resource", F.when(F.col("service") != "service_1", F.col("resource")))
    billing = rows.unionByName(rows.withColumns({"dataset_id": F.lit("e"), "resource": F.lit(None).cast("string")}))
    apart, whole = source_queries._stored_content(billing), source_queries._content(billing)
    assert apart.schema.names == whole.schema.names
    assert sorted(apart.collect()) == sorted(whole.collect())
    assert not any("partial_sum" in line and "resource" in line for line in apart._jdf.queryExecution().executedPlan().toString().split("\n"))
