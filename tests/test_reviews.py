"""Claim reviews: only what a caller asks for is computed."""

import pytest

from traceloom.operators import evidence as ev
from traceloom.operators import reviews as rw

ROWS = """graph_id string, edge string, claim_id string, status string, support_label string, claim_found boolean, source_found boolean,
 source_id string, family string, content_hash string, kind string, support_type string, span string, published_at timestamp_ntz,
 observed_at timestamp_ntz, extracted_at timestamp_ntz, retrieved_at timestamp_ntz"""


def row(graph, edge, claim, status="accepted", label="directly_supported"):
    return (graph, edge, claim, status, label, True, True, "s" + claim, "f" + claim, "h" + claim, "web", "supports", "x", None, None, None, None)


@pytest.fixture
def case(rows):
    lines = rows([row("g", "e1", "a"), row("g", "e1", "b", label="user_asserted"), row("g", "e2", "c"), row("h", "e3", "a"), row("h", "e4", "d")], ROWS)
    reviews = rows([("r1", "a", "accept", "n", 1), ("r2", "a", "reject", "n", 2), ("r3", "c", "accept", "n", 3), ("r4", "gone", "reject", "n", 4),
                    ("r5", "d", "praise", "n", 5)], "review_id string, claim_id string, verdict string, note string, created_at long")
    return lines, reviews, rows([("g", 3), ("h", 7)], "graph_id string, revision long")


def test_notes_and_revisions_score_nothing(case, rows, monkeypatch):
    """Before, every edge was scored for each of these tables."""
    lines, reviews, graphs = case
    monkeypatch.setattr(rw, "score_edges", lambda *a: pytest.fail("an edge was scored"))
    done = rw.review(lines, None, reviews, graphs, ["edge"])
    assert [(r.claim_id, r.status_before, r.status, len(r.notes)) for r in done.claims.orderBy("claim_id").collect()] == [
        ("a", "accepted", "rejected", 2), ("c", "accepted", "accepted", 1)]
    assert rows.of(done.revisions, "graph_id", "review_id", "revision_after") == [
        ("g", "r1", 4), ("g", "r2", 5), ("g", "r3", 6), ("h", "r1", 8), ("h", "r2", 9)]


def test_changes_score_touched_edges_only(case, rows, monkeypatch):
    lines, reviews, graphs = case
    given = rw.review(lines, ev.score_edges(lines, ["edge"]), reviews, graphs, ["edge"])
    real, seen = rw.score_edges, []

    def score(df, *rest):
        seen.extend(r.edge for r in df.select("edge").distinct().collect())
        return real(df, *rest)

    monkeypatch.setattr(rw, "score_edges", score)
    done = rw.review(lines, None, reviews, graphs, ["edge"])
    assert rows.of(done.changes, *done.changes.columns) == rows.of(given.changes, *given.changes.columns)
    assert rows.of(done.labels, "graph_id", "support_label", "change") == rows.of(given.labels, "graph_id", "support_label", "change")
    assert set(seen) == {"e1", "e3"}
    assert rows.of(done.scores, *done.scores.columns) == rows.of(given.scores, *given.scores.columns)


def test_whole_scores_without_a_view_score_each_edge_once(case, rows, monkeypatch):
    """Before, all edges were scored as they were and the touched ones again, from rows joined anew for each."""
    lines, reviews, graphs = case
    want = rw.review(lines, ev.score_edges(lines, ["edge"]), reviews, graphs, ["edge"]).scores
    real, calls = rw.score_edges, []
    monkeypatch.setattr(rw, "score_edges", lambda df, *rest: (calls.append(df), real(df, *rest))[1])
    for some in (reviews, reviews.where("false")):
        del calls[:]
        got = rw.review(lines, None, some, graphs, ["edge"]).scores
        assert len(calls) == 1
        assert {(r.claim_id, r.status) for r in calls[0].collect()} == {
            ("a", "accepted" if some is not reviews else "rejected"), ("b", "accepted"), ("c", "accepted"), ("d", "accepted")}
        if some is reviews:
            assert rows.of(got, *got.columns) == rows.of(want, *got.columns)
