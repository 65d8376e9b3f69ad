"""Canonical billing schema and the FOCUS column names it is filled from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# FOCUS 1.0 column -> canonical column.
FOCUS_1_0 = {
    "BilledCost": "billed_cost",
    "EffectiveCost": "effective_cost",
    "ListCost": "list_cost",
    "ContractedCost": "contracted_cost",
    "ConsumedQuantity": "quantity",
    "ProviderName": "provider",
    "BillingAccountId": "account",
    "SubAccountId": "sub_account",
    "ServiceName": "service",
    "ServiceCategory": "category",
    "ResourceId": "resource",
    "RegionId": "region",
    "SkuId": "sku",
    "ChargeCategory": "charge_category",
    "PricingCategory": "pricing_category",
    "ChargePeriodStart": "charge_period_start",
    "ChargePeriodEnd": "charge_period_end",
    "BillingPeriodStart": "billing_period_start",
    "BillingPeriodEnd": "billing_period_end",
    "BillingCurrency": "currency",
}

# Columns FOCUS 1.0.1 adds.
FOCUS_1_0_1_EXTRA = {
    "ConsumedUnit": "consumed_unit",
    "PricingUnit": "pricing_unit",
    "PricingQuantity": "pricing_quantity",
    "ResourceName": "resource_name",
    "ResourceType": "resource_type",
    "CommitmentDiscountId": "commitment_discount_id",
    "CommitmentDiscountType": "commitment_discount_type",
    "CommitmentDiscountCategory": "commitment_discount_category",
}

# A file that has any of these is FOCUS 1.0.1.
FOCUS_1_0_1_MARKERS = ("ResourceName", "ResourceType", "CommitmentDiscountId", "PricingUnit")

# Required, numeric and date fields, dimensions, fields of a duplicate.
REQUIRED_FIELDS = ("billed_cost", "charge_period_start", "charge_period_end", "currency")
NUMERIC_FIELDS = ("billed_cost", "effective_cost", "list_cost", "contracted_cost", "quantity")
DATE_FIELDS = (
    "charge_period_start",
    "charge_period_end",
    "billing_period_start",
    "billing_period_end",
)

#: Dimensions of the spend summary and of driver attribution.
SUMMARY_DIMENSIONS = ("provider", "account", "service", "region")

#: Dimensions a resource breakdown accepts.
BREAKDOWN_DIMENSIONS = (
    "provider",
    "account",
    "sub_account",
    "service",
    "category",
    "resource",
    "region",
    "sku",
    "charge_category",
)

#: Fields that identify a charge for duplicate detection.
DUPLICATE_KEYS = ("charge_period_start", "account", "service", "resource", "billed_cost")

#: Stand-in for a missing dimension value.
UNKNOWN = "unknown"

CANONICAL = T.StructType(
    [T.StructField("dataset_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_FIELDS]
    + [T.StructField(c, T.StringType()) for c in BREAKDOWN_DIMENSIONS]
    + [T.StructField("pricing_category", T.StringType())]
    + [T.StructField(c, T.TimestampNTZType()) for c in DATE_FIELDS]
    + [T.StructField("currency", T.StringType())]
)


def detect_version(columns: Iterable[str]) -> str:
    """``1.0.1``, ``1.0`` or ``unknown``, judged by column names alone."""
    present = set(columns)
    if present & set(FOCUS_1_0_1_MARKERS):
        return "1.0.1"
    raw_names = {raw for raw, name in FOCUS_1_0.items() if name in REQUIRED_FIELDS}
    if raw_names <= present or set(REQUIRED_FIELDS) <= present:
        return "1.0"
    return "unknown"


def column_mapping(version: str) -> dict[str, str]:
    """Raw-to-canonical names; an unknown version uses the 1.0 names."""
    return FOCUS_1_0 | FOCUS_1_0_1_EXTRA if version == "1.0.1" else dict(FOCUS_1_0)


def missing_required(columns: Iterable[str]) -> list[str]:
    present = set(columns)
    return [c for c in REQUIRED_FIELDS if c not in present]
