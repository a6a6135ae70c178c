"""Items without a parent are not dealt by their missing parent."""

from traceloom.operators import traverse as tr


def test_roots_stay_out_of_the_first_join(rows, monkeypatch):
    """Before, all items without a parent met in the one task of the NULL key."""
    plans, real = [], tr.materialize
    monkeypatch.setattr(tr, "materialize", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    items = rows([("a", None), ("b", "a"), ("c", "c"), ("d", "lost"), ("e", None)], "id string, parent_id string")
    assert rows.of(tr.parent_faults(items), "id", "fault") == [("c", "cycle"), ("d", "dangling")]
    first = next(p for p in plans if "Join LeftOuter" in p)
    assert "Union" in first and "isnotnull(ptr" in first
