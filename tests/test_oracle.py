"""Every SQL-expressible key against its DuckDB oracle on sf0.001, and its plan."""

import hashlib
import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no row-at-a-time Python
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    sh, sk = digest(sdf.columns, srows)
    dh, dk = digest(dcols, drows)
    assert sh == dh, (sorted(set(sk) - set(dk))[:2], sorted(set(dk) - set(sk))[:2])
