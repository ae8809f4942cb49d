"""Sites and the interfaces of their callers meet by key."""

import __spark_entry__ as entry_point


def test_sites_meet_interfaces_of_the_calling_class_only(spark, make, tmp_path):
    kinds = ["PROMO", "STANDARD", "LARGE"]
    parts = [(i, f"old {'ring' if i % 2 else 'nut'}", f"Brand{i % 2}", kinds[i % 3], 7) for i in range(12)]
    make.table([*parts, (None, None, None, "PROMO", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    lines = [(o, (o * 5 + 2 * n) % 12, o, n) for o in range(12) for n in range(4)]
    make.table([*lines, (1, None, 1, 9)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = entry_point.queries()["h2_assignable"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def up(k):
        found = {f"P{k}"} | ({f"Brand{k % 2}"} if k % 3 == 0 else set())
        return found | (up(k // 2) if k else set())

    expected = {("part", f"P{b}", f"Brand{a % 2}") for o, a, _, n in lines for p, b, _, m in lines
                if p == o and m == n + 1 and a % 3 == 0 and a % 2 == b % 2 and f"Brand{a % 2}" in up(b)}
    assert expected and sorted(expected) == sorted(tuple(r) for r in df.select("graph_id", "sub", "sup").collect())
