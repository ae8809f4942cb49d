import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
# COMPARE_ALL=1 compares every registered query with its SQL (some 40 minutes); before a change of the views is committed
COMPARED = "/root/testdata/sf0.01"
SOME = ["g5_shortest_path", "g7_one_path", "g24_colouring", "f7_quantifiers", "a9_degrees", "g1_reachable", "g10_condensation", "h8_j3_possible_targets", "k2_v2_may_in", "l20_states_in_log", "o2_compare", "x2_descriptors"]


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v is not None else v


def test_every_operator_family_is_registered():
    q, o = entry_point.queries(), entry_point.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert {re.match(r"[a-z]", n).group() for n in q} >= set("afghjklopswxrv") - {"v"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()) if os.environ.get("COMPARE_ALL") else SOME)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from graphfacts.plans.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{COMPARED}/{t}.parquet'")
    df = entry_point.queries()[name](spark, COMPARED)
    r = con.execute(entry_point.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda x: repr(x)
    assert sorted([plain(tuple(x)) for x in df.select(*cols).collect()], key=key) == sorted([plain(x) for x in r.fetchall()], key=key)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_entry(spark):
    assert set(entry_point.entry(spark).columns) == {"graph_id", "nodes", "edges", "alarmed"}


def test_oracle_needs_no_session():
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.strip().splitlines()[-1]) > 150, out.stderr[-500:]
