"""Evidence scores, labels, groups and contradictions on small literal tables."""

import random
from datetime import datetime

import pytest

from traceloom.operators import components as co
from traceloom.operators import evidence as ev

SCHEMA = (
    "edge string, claim_id string, claim_found boolean, status string, support_label string, observed_at timestamp, "
    "source_id string, source_found boolean, support_type string, span string, extracted_at timestamp, kind string, "
    "family string, content_hash string, published_at timestamp, retrieved_at timestamp"
)
SEEN = datetime(2026, 9, 5)


def line(n, published="2026-01-01", status="accepted", label="directly_supported", family=None, digest=None, kind="web", support="supports", found=True, source=True, span="text", claim=None):
    when = datetime.fromisoformat(published) if published else None
    return (
        "e", claim or f"c{n}", found, status, label, SEEN, f"s{n}", source, support, span, SEEN, kind,
        family or f"family-{n}", digest or f"hash-{n}", when, SEEN,
    )


CASES = {
    "one source": ([line(1)], 0.7, 1),
    "same family": ([line(1), line(2, family="family-1")], 0.7, 1),
    "same hash": ([line(1), line(2, digest="hash-1")], 0.7, 1),
    "two independent": ([line(1), line(2)], 0.8, 2),
    "three independent": ([line(1), line(2), line(3)], 0.9, 3),
    "capped corroboration": ([line(i) for i in range(1, 6)], 0.9, 5),
    "bridge joins groups": ([line(1), line(2), line(3), line(4), line(5, family="family-4", digest="hash-1")], 0.9, 3),
    "unknown date": ([line(1, published=None)], 0.65, 1),
    "future date": ([line(1, published="2030-01-01")], 0.65, 1),
    "over two years": ([line(1, published="2023-01-01")], 0.6, 1),
    "over five years": ([line(1, published="2019-01-01")], 0.5, 1),
    "contradicted": ([line(1), line(2), line(3), line(4, support="contradicts")], 0.25, 3),
    "upload only": ([line(1, label="user_asserted", kind="upload")], 0.25, 0),
    "missing claim": ([line(1), line(2, found=False, source=False)], 0.0, 1),
    "missing source": ([line(1), line(2, source=False)], 0.0, 1),
    "one rejected": ([line(1), line(2, status="rejected")], 0.7, 1),
    "all rejected": ([line(1, status="rejected"), line(2, status="rejected")], 0.0, 0),
    "blank span": ([line(1, span="  ")], 0.0, 0),
}


def test_scores(spark):
    rows = [(name, *r[1:]) for name, (lines, _, _) in CASES.items() for r in lines]
    out = {r.edge: r for r in ev.score_edges(spark.createDataFrame(rows, SCHEMA), ["edge"]).collect()}
    for name, (_, confidence, groups) in CASES.items():
        assert out[name].confidence == pytest.approx(confidence), name
        assert out[name].supporting_families == groups, name
    assert out["contradicted"].contradiction == -0.45
    assert (out["one source"].date, out["one source"].time) == ("2026-09-05", "00:00:00.000Z")


def test_created_at_is_the_last_clock(spark):
    row = list(line(1, found=False, source=False))
    row[5] = row[10] = row[15] = None
    df = spark.createDataFrame([tuple(row)], SCHEMA)
    got = ev.score_edges(df, ["edge"], datetime(2026, 2, 3)).first()
    assert (got.confidence, got.date) == (0.0, "2026-02-03")
    assert ev.score_edges(df, ["edge"]).first().date is None


def test_lineage_flags_missing_records(spark):
    edge_claims = spark.createDataFrame([("e", "c1"), ("e", "c2")], "edge string, claim_id string")
    claims = spark.createDataFrame([("c1", "accepted")], "claim_id string, status string")
    evidence = spark.createDataFrame([("c1", "s1"), ("c1", "s2")], "claim_id string, source_id string")
    sources = spark.createDataFrame([("s1", "f")], "source_id string, family string")
    out = ev.lineage(edge_claims, claims, evidence, sources, ["edge"])
    got = {(r.claim_id, r.source_id, r.claim_found, r.source_found) for r in out.collect()}
    assert got == {("c1", "s1", True, True), ("c1", "s2", True, False), ("c2", None, False, False)}
    assert [r.claim_id for r in ev.missing_claims(edge_claims, claims, ["edge"]).collect()] == ["c2"]
    assert [r.source_id for r in ev.missing_sources(evidence, sources).collect()] == ["s2"]


def brute_groups(pairs):
    groups = []
    for left, right in pairs:
        merged, rest = {("l", left), ("r", right)}, []
        for group in groups:
            if group & merged:
                merged |= group
            else:
                rest.append(group)
        groups = rest + [merged]
    return len(groups)


@pytest.mark.parametrize("limit", [256, 0])
def test_groups_fold_and_contraction_agree_with_brute_force(spark, limit):
    rng = random.Random(7)
    data = {k: {(f"f{rng.randrange(12)}", f"h{rng.randrange(14)}") for _ in range(rng.randrange(1, 14))} for k in range(12)}
    data[99] = {(f"f{i}", f"h{i}") for i in range(40)} | {(f"f{i}", f"h{i + 1}") for i in range(39)}  # one long chain
    df = spark.createDataFrame([(k, *p) for k, ps in data.items() for p in ps], "k int, l string, r string")
    got = {r.k: r.groups for r in co.count_groups(df, ["k"], "l", "r", limit).collect()}
    assert got == {k: brute_groups(ps) for k, ps in data.items()}


def test_reviews_relabel_only_touched_edges(spark):
    claims = spark.createDataFrame(
        [("e1", "a", "accepted", "directly_supported"), ("e1", "b", "accepted", "user_asserted"), ("e2", "c", "accepted", "weakly_inferred")],
        "edge string, claim_id string, status string, support_label string",
    )
    reviews = spark.createDataFrame([("a", "accept", 1), ("a", "reject", 2)], "claim_id string, verdict string, created_at int")
    done = ev.apply_reviews(claims, reviews)
    out = ev.relabel_reviewed_edges(claims, done, ["edge"]).collect()
    assert [tuple(r) for r in out] == [("e1", "directly_supported", "user_asserted")]


def test_contradictions(spark):
    claims = spark.createDataFrame(
        [("k1", "a", "accepted", "supports"), ("k1", "b", "accepted", "contradicts"), ("k1", "c", "accepted", "supports"), ("k2", "d", "accepted", "contradicts")],
        "k string, claim_id string, status string, support_type string",
    )
    out = {r.claim_id: (r.contradiction_count, r.status_after, r.has_edge) for r in ev.contradiction_state(claims, ["k"]).collect()}
    assert out == {"a": (1, "disputed", True), "b": (2, "disputed", True), "c": (1, "disputed", True), "d": (0, "accepted", False)}


def test_summary_counts_families_and_sources(spark):
    rows = spark.createDataFrame([line(1), line(2, family="family-1"), line(3, source=False), line(1, claim="c9")], SCHEMA)
    out = ev.evidence_summary(rows, ["edge"]).first()
    assert (out.source_count, out.independent_family_count, out.has_contradiction) == (2, 1, False)
    kinds = {r.source_id: r.support_types for r in ev.edge_sources(rows, ["edge"]).collect()}
    assert kinds == {"s1": "supports", "s2": "supports", "s3": "supports"}
