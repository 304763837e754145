"""Laws that hold for any harvest."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyvine import plans
from tallyvine.operators import filter_rows, production_by, total_by_campaign

SCHEMA = "campaign int, farm_id int, zone int, mode int, production double"
row = st.tuples(
    st.integers(14, 16),
    st.one_of(st.none(), st.integers(1, 5)),
    st.one_of(st.none(), st.integers(-2, 3)),
    st.integers(1, 2),
    st.one_of(st.none(), st.integers(-(10**6), 10**8).map(lambda c: c / 100)),
)
few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@few
@given(rows=st.lists(row, min_size=1, max_size=40), partitions=st.sampled_from([1, 3, 17]))
def test_reports(spark, rows, partitions):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    categories = plans.farm_profile(df, "mode").categories.collect()
    assert sum(r.n for r in categories) == len(rows)
    assert abs(sum(r.share for r in categories) - 100) <= 0.005 * len(categories) + 1e-9
    by_campaign = {r.campaign: r.production for r in total_by_campaign(df).collect()}
    by_both = production_by(df, "mode", "total").collect()
    for campaign, total in by_campaign.items():
        parts = [r.production for r in by_both if r.campaign == campaign]
        assert math.fsum(parts) == pytest.approx(total, abs=1e-6)
    report = plans.production_report(df, "zone", 15, "mean").collect()
    zones = sorted({r[2] for r in rows if r[0] == 15 and r[2] is not None})
    assert [(r.zone, r.code) for r in report] == list(zip(zones, range(len(zones))))


@few
@given(rows=st.lists(row, min_size=1, max_size=40), value=st.integers(-2, 3))
def test_comparisons_complement_each_other(spark, rows, value):
    df = spark.createDataFrame(rows, SCHEMA)

    def kept(comparison):
        return sorted(map(repr, filter_rows(df, "zone", comparison, str(value)).collect()))

    everything = sorted(map(repr, df.collect()))
    known = sorted(map(repr, df.where("zone IS NOT NULL").collect()))
    assert sorted(kept("igual a") + kept("distinto de")) == everything
    assert sorted(kept("mayor que") + kept("menor o igual que")) == known
    assert sorted(kept("mayor o igual que") + kept("menor que")) == known
