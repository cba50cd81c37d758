"""Registered queries against their SQL at the smallest scale; `python -m
tests.check` runs all of them."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from catalogspark.plans import oracle, registry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = [
    "entitled_datasets_by_class", "deny_reason_counts", "caller_admission", "claim_classes",
    "visible_quad_counts", "roundtrip_datasets", "bgp_dataset_service", "path_closure",
    "literal_aggregates", "policy_json", "scalar_render", "participant_status", "stream_expiry", "stream_ingest",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, con, name):
    ok, detail = compare(spark, con, name, SF)
    assert ok, detail
