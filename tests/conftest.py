import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from costlens import session  # noqa: E402
from verification.check import session as local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session.configure(local_session("4", 4))


@pytest.fixture()
def make_panel(spark):
    """A panel from ``{entity: [cost, ...]}``, one row per day from 2024-01-01."""

    def build(series, partitions=None, first=dt.date(2024, 1, 1)):
        rows = [
            ("d", "service", name, first + dt.timedelta(days=i), None if cost is None else float(cost))
            for name, costs in series.items()
            for i, cost in enumerate(costs)
        ]
        frame = spark.createDataFrame(
            rows, "dataset_id string, entity_type string, entity_value string, day date, cost double"
        )
        return frame.repartition(partitions) if partitions else frame

    return build


@pytest.fixture()
def make_billing(spark):
    """Canonical charges of 60 days and three services, as in the reference's fixture."""

    def build(days=60, services=3, spike=None, dataset_id="d"):
        start = dt.datetime(2024, 1, 1)
        rows = []
        for day in range(days):
            at = start + dt.timedelta(days=day)
            for i in range(services):
                cost = 100.0 + day * 0.5 + (50.0 if i == 0 else 0.0)
                if spike is not None and day == spike and i == 1:
                    cost *= 20
                rows.append(
                    (dataset_id, cost, 95.0 + day * 0.5, 1.0, "TestProvider", "test_account", f"service_{i}",
                     f"resource_service_{i}", "us-east-1", at, at + dt.timedelta(days=1), "USD")
                )
        return spark.createDataFrame(
            rows,
            "dataset_id string, billed_cost double, effective_cost double, quantity double, provider string, "
            "account string, service string, resource string, region string, charge_period_start timestamp_ntz, "
            "charge_period_end timestamp_ntz, currency string",
        )

    return build
