"""Parameter bounds, bound values, not-found, readiness."""

from __future__ import annotations

import pytest

from fixture import raw_tables
from tradelens.plans import serving
from tradelens.plans.models import build_models


@pytest.fixture(scope="module")
def models(spark):
    return build_models(raw_tables(spark))


@pytest.mark.parametrize("limit", [1, 100])
def test_limits_in_range(models, limit):
    assert serving.top_sellers(models, limit).count() <= limit


@pytest.mark.parametrize("limit", [0, -1, 101, "abc", "1.5", 1.5, True, None])
def test_limits_out_of_range(models, limit):
    with pytest.raises(ValueError):
        serving.top_sellers(models, limit)


def test_seller_id_bounds(models):
    with pytest.raises(ValueError):
        serving.seller_by_id(models, "x" * 33)
    with pytest.raises(ValueError):
        serving.seller_by_id(models, "")


def test_injection_text_is_a_value(models):
    assert serving.seller_by_id(models, "' OR 1=1 --").count() == 0
    with pytest.raises(serving.NotFoundError):
        serving.seller_performance(models, "' OR 1=1 --")


def test_seller_lookup(models):
    assert serving.seller_performance(models, "s2")["total_orders"] == 2


def test_readiness_resolves_every_source(models):
    rows = {r["source"]: r["sample_rows"] for r in serving.readiness(models).collect()}
    assert set(rows) == set(serving.SERVING_SOURCES)
    assert all(v == 1 for v in rows.values())
