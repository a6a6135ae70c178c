"""Places against the packaged gazetteer, production shares, distributions and sites."""

import pytest
from pyspark.sql import functions as F

from traceloom.operators import places as pl
from traceloom.operators import shares as sh
from traceloom.sources.readers import production_names, read_gazetteer, read_production

PLACES = [
    (("Harrodsburg, Kentucky", None), ("US", "city", "Harrodsburg")),
    (("Hsinchu Science Park", None), ("TW", "city", "Hsinchu")),
    (("Pencoed, South Wales", None), ("GB", "city", "Pencoed")),
    (("Kentucky", None), ("US", "region", None)),
    (("Taiwan", None), ("TW", "country", None)),
    (("Somewhere", "US"), ("US", "country", None)),
    (("Nowhere", None), (None, None, None)),
    (("10000 Old Carefree Hwy, Peoria, AZ 85383, USA", None), ("US", "city", "Peoria")),
    (("AZ", None), (None, None, None)),
    (("Somewhere", "AZ"), ("AZ", "country", None)),
    (("Paris, Texas", None), ("US", "region", None)),
    (("Kunshan, Jiangsu", None), ("CN", "city", "Kunshan")),
]


def test_gazetteer(spark):
    asked = spark.createDataFrame([p for p, _ in PLACES], "label string, hint string")
    out = pl.resolve_places(asked, *read_gazetteer(spark)).collect()
    got = {(r.label, r.hint): (r.country_iso2, r.precision, r.city) for r in out}
    assert got == dict(PLACES)
    texas = next(r for r in out if r.label == "Paris, Texas")
    assert texas.admin1 == "Texas"


def test_coordinates_are_filled_but_never_replaced(spark):
    layers = spark.createDataFrame(
        [
            ("a", "Zhengzhou factory", "Zhengzhou, Henan, China", "CN", None, None, None, "address"),
            ("b", "x", "Somewhere obscure", "CN", None, None, None, "address"),
            ("c", "x", "Zhengzhou", "CN", None, 34.7, 113.6, "address"),
            ("d", "x", "Kunshan", "US", None, None, None, "address"),
        ],
        "id string, label string, address string, country_iso2 string, admin1 string, lat double, lon double, precision string",
    )
    out = {r.id: (r.lat, r.lon, r.precision, r.geocoding) for r in pl.fill_coordinates(layers, *read_gazetteer(spark)).collect()}
    assert out["a"] == (34.75, 113.63, "city", "gazetteer_v1")
    assert out["b"][0] == 35.9 and out["b"][2] == "country"
    assert out["c"] == (34.7, 113.6, "address", None)
    assert out["d"][2] == "country"


def test_place_fields_and_same_place(spark):
    asked = spark.createDataFrame([("Kunshan, Jiangsu", None), ("Atlantis", "ZZ"), ("Atlantis", None)], "label string, hint string")
    gaz = read_gazetteer(spark)
    out = {(r.label, r.hint): (r.country_iso2, r.precision, r.method) for r in pl.place_fields(asked, *gaz).collect()}
    assert out == {("Kunshan, Jiangsu", None): ("CN", "city", "gazetteer_v1"), ("Atlantis", "ZZ"): ("ZZ", "country", "extractor_country_code")}
    places = pl.resolve_places(spark.createDataFrame([("Kunshan", "CN")], "label string, hint string"), *gaz)
    known = spark.createDataFrame([("g1", "CN", "city", "Kunshan", "Jiangsu"), ("g2", "CN", "country", "", "")], "id string, country_iso2 string, precision string, city string, admin1 string")
    assert [r.node_id for r in pl.same_place(places, known).collect()] == ["g1"]


def test_evidenced_and_unlocated(spark):
    nodes = spark.createDataFrame([("f1", "facility", "CN", None), ("f2", "facility", "CN", None), ("f3", "facility", None, None), ("g", "geography", None, "CN"), ("h", "geography", None, "US")], "id string, kind string, country_iso2 string, iso2 string")
    claims = spark.createDataFrame(
        [("c1", "f1", "g", "LOCATED_IN", "accepted", "directly_supported", 1), ("c2", "f2", "g", "LOCATED_IN", "rejected", "x", 1), ("c3", "f2", "h", "LOCATED_IN", "accepted", "x", 1), ("c4", "f2", "g", "LOCATED_IN", "accepted", "x", 0)],
        "claim_id string, subject_id string, object_id string, predicate string, status string, support_label string, evidence int",
    )
    good = pl.evidenced_locations(nodes, claims)
    assert [(r.node_id, r.claim_id) for r in good.collect()] == [("f1", "c1")]
    assert [r.id for r in pl.unlocated_facilities(nodes, good).collect()] == ["f2", "f3"]


def test_inherited_places(spark):
    subjects = spark.createDataFrame([("a", "facility", None, None), ("b", "facility", "CN", "city"), ("c", "component", None, None)], "id string, kind string, country_iso2 string, precision string")
    subjects = subjects.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("admin1", "string"), ("city", "string"), ("lat", "double"), ("lon", "double"))])
    offers = spark.createDataFrame([("a", "c1", 1, "CN", "country"), ("a", "c2", 2, "CN", "city"), ("a", "c3", 3, "CN", "region"), ("a", "c4", 4, "US", "country"), ("b", "c5", 1, "CN", "city"), ("c", "c6", 1, "CN", "city")], "subject_id string, claim_id string, ord long, country_iso2 string, precision string")
    offers = offers.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("admin1", "string"), ("city", "string"), ("lat", "double"), ("lon", "double"))])
    out = {r.subject_id: (r.claim_id, r.precision, r.later_claims) for r in pl.inherit_places(subjects, offers).collect()}
    assert out == {"a": ("c2", "city", 1), "b": (None, "city", 1)}


def test_tin_concentration(spark, tmp_path):
    text = (
        '[{"commodity": "tin", "aliases": ["sn"], "year": 2024, "stage": "mine", "unit": "t", "production": {"AU": 9900, "BO": 21000, "BR": 29000, '
        '"MM": 34000, "CN": 69000, "CD": 25000, "ID": 50000, "LA": 1500, "MY": 3000, "NG": 7000, "PE": 31000, "RU": 3000, "RW": 3600, "VN": 6700}, "unallocated_production": 1800}]'
    )
    (tmp_path / "p.json").write_text(text)
    rows = read_production(spark, str(tmp_path / "p.json"))
    by = ["commodity", "year", "stage"]
    totals = sh.country_totals(rows, by)
    out = sh.concentration(totals, by).first()
    assert out.hhi == pytest.approx(0.1318148997512032, abs=1e-12)
    assert out.top_share == pytest.approx(0.233502538071066, abs=1e-12) and out.top_country == "CN"
    assert out.coverage_pct == pytest.approx(99.39086294416244, abs=1e-9)
    ranked = sh.country_shares(totals, by).orderBy("rank").collect()
    assert [r.country for r in ranked][:2] == ["CN", "ID"] and [r.country for r in ranked][-2:] == ["RU", "LA"]
    assert sh.invalid_production(rows).count() == 0
    labels = spark.createDataFrame([("n1", "sn"), ("n2", "copper")], "node_id string, label_key string")
    names = production_names(rows)
    assert [tuple(r) for r in sh.match_production(labels, names).select("node_id", "commodity", "year").collect()] == [("n1", "tin", 2024)]
    assert sh.match_production(labels, names, year=1900).count() == 0 and sh.match_production(labels, names, stage="export").count() == 0


def test_invalid_production(spark):
    rows = spark.createDataFrame(
        [("d1", "a", 1, "mine", "CN", 1.0), ("d2", "a", 1, "mine", "CN", 1.0), ("d3", "b", 1, "mine", "cn", 1.0), ("d4", "c", 1, "mine", "CN", -1.0), ("d5", "d", 1, "mine", "CN", 0.0)],
        "dataset_id string, commodity string, year int, stage string, country string, quantity double",
    )
    assert {(r.commodity, r.reason) for r in sh.invalid_production(rows).collect()} == {("a", "duplicate_dataset"), ("b", "country_code"), ("c", "negative_quantity"), ("d", "total_not_positive")}


def test_sites(spark):
    nodes = spark.createDataFrame(
        [("w", "product", "Widget", None, None, None), ("o", "organization", "Pegatron", None, None, None), ("f", "facility", "Kunshan plant", "CN", 31.39, 120.98), ("f2", "facility", "Other plant", "CN", 1.0, 1.0), ("c", "component", "Chip", None, None, None)],
        "id string, kind string, label string, country string, lat double, lon double",
    )
    edges = spark.createDataFrame(
        [("o", "w", "MANUFACTURES", 0.3), ("f", "w", "MANUFACTURES", None), ("o", "f", "OPERATES", None), ("f2", "o", "OWNED_BY", None), ("o", "c", "PRODUCES", None)],
        "source_node_id string, target_node_id string, predicate string, weight double",
    )
    dist = {(r.source_node_id, r.target_node_id): (r.weight, r.share_estimate, r.stated_total, r.unassigned) for r in sh.graph_distributions(edges, nodes).collect()}
    assert dist[("o", "w")] == (0.3, None, 0.3, 0.7) and dist[("f", "w")] == (None, 0.7, 0.3, 0.7)
    makes = {(r.node_id, r.target_node_id): (r.share, r.share_basis, r.via_organization_id) for r in sh.site_makes(nodes, edges).collect()}
    assert makes == {
        ("f", "w"): (0.7, "uniform_prior", None),
        ("f2", "w"): (0.15, "stated_over_plants", "o"),
        ("f", "c"): (0.5, "uniform_prior_over_plants", "o"),
        ("f2", "c"): (0.5, "uniform_prior_over_plants", "o"),
    }
    pins = {r.node_id: (r.role, r.makes, r.operators) for r in sh.site_summary(nodes, sh.site_makes(nodes, edges), sh.operator_plants(edges, nodes)).collect()}
    assert pins == {"f": ("plant", 2, 1), "f2": ("plant", 2, 1)}


def test_enrichment(spark):
    nodes = spark.createDataFrame([("m", "material", "tin"), ("c", "component", "chip"), ("x", None, None)], "node_id string, kind string, label_key string")
    have = spark.createDataFrame([("m",)], "node_id string")
    none = have.where("false")
    out = pl.enrichment_outcomes(nodes, ["concentration", "geography", "market"], have, none)
    got = {(r.node_id, r.layer): (r.outcome, r.reason) for r in out.collect()}
    assert got[("m", "concentration")] == ("filled", None) and got[("m", "market")] == ("filled", None)
    assert got[("c", "concentration")] == ("skipped", "not_a_material") and got[("x", "market")] == ("unresolved", "node_removed")
    assert pl.job_status(out.withColumn("job", F.lit(1)), ["job"]).first().status == "partial"
