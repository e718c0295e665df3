"""Plan checks: pruned scans, broadcast where the small side is bounded, a narrow
flagship.  (`test_oracle` looks for row-at-a-time Python in every plan it runs.)"""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_narrow_and_pruned(spark):
    df = E.queries()["score_mailbox"](spark, SF)
    p = plan(df)
    assert "Exchange hashpartitioning" not in p
    assert "Generate" not in p  # no explode of URLs
    scan = [line for line in p.splitlines() if "documents.parquet" in line or "FileScan parquet" in line]
    assert scan and all("n_chars" not in line for line in scan)


def test_decontamination_anti_join_broadcasts(spark):
    p = plan(E.queries()["prefix_decontaminate"](spark, SF))
    assert "BroadcastHashJoin" in p and "LeftAnti" in p


def test_filters_reach_scan(spark):
    p = plan(E.queries()["filter_by_label"](spark, SF))
    assert "PushedFilters" in p
