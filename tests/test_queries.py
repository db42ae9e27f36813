"""Every query with a SQL twin gives the twin's rows."""

import os

import duckdb
import pandas as pd
import pytest

from kerbline.plans import catalog, elements, searches, snapping  # noqa: F401  (these add their queries to the catalog)

DATA = "/root/testdata/sf0.001"
#: Compared with plain Python elsewhere (test_pairing, test_snapping, test_search), or like another.
ELSEWHERE = {"distances_between", "odd_node_pairing", "sweep_length_bounds", "pocket_report", "components_by_size", "largest_component", "shortest_path_multi_source", "closest_target"}


def rows(df):
    show = lambda v: "~" if v is None or (not isinstance(v, str) and pd.isna(v)) else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__.startswith(("int", "float")) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in ELSEWHERE])
def test_twin(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
