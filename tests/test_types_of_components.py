"""Types along flows with cycles."""

from conftest import rows

from graphfacts.operators import dataflow


def test_values_on_a_cycle_share_one_set_of_types(make, monkeypatch):
    ring = [(i, (i + 1) % 20) for i in range(20)] + [(i, (i + 7) % 20) for i in range(20)]
    flow = make.edges({"g": ring + [(3, 50), (60, 50), (60, 5)], "h": [(3, 4)]})
    extends = make.edges({"g": [(f"T{i}", "Low" if i < 20 else "Base") for i in range(21)] + [("Low", "Base")], "h": [("T3", "Base")]},
                         "string", cols=("sub", "sup"))
    known = make.table([("g", i, f"T{i}") for i in range(20)] + [("g", 60, "T1"), ("g", 50, "T20"), ("g", 70, "T20"), ("h", 3, "T3")],
                       "graph_id string, value long, type string")
    expected = [("g", i, "Low") for i in range(20)] + [("g", 50, "Base"), ("g", 60, "T1"), ("g", 70, "T20"), ("h", 3, "T3"), ("h", 4, "T3")]
    kept, plain = [], dataflow.accumulate

    def counted(*given):
        reach = plain(*given)
        kept.append(reach.count())
        return reach

    monkeypatch.setattr(dataflow, "accumulate", counted)
    assert rows(dataflow.infer_types(flow, known, extends), "graph_id", "value", "type") == expected
    assert max(kept) < 60  # 20 types of the ring at its 20 values would be 400
