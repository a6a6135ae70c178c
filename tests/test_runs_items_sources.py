"""Runs, items, documents, readers and sinks on small literal tables."""

import json
from collections import Counter
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom.operators import documents as dc
from traceloom.operators import items as it
from traceloom.operators import runs as rn
from traceloom.operators.running import first_per_key, running_totals, top_per_key
from traceloom.sources import readers, sinks

START = datetime(2026, 1, 1)


def test_running_totals_match_a_plain_sum(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", i, START + timedelta(minutes=rng.randrange(6000)), rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, id long, ts timestamp, v int")
    out = running_totals(df, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), {"rank": F.lit(1), "total": F.col("v")})
    got = {r.id: (r["rank"], r.total) for r in out.collect()}
    state = {}
    for k, i, _, v in sorted(data, key=lambda d: (d[2], d[1])):
        n, t = state.get(k, (0, 0))
        state[k] = (n + 1, t + v)
        assert got[i] == state[k]


def test_first_and_top_per_key(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "k string, o int, v string")
    assert {tuple(r) for r in first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "x"), ("b", 5, "z")}
    assert top_per_key(df, ["k"], ["o"], 1).count() == 2


def test_streaks(spark):
    kinds = "mmhmmmmhmeqeee"
    df = spark.createDataFrame([("s", i, START + timedelta(minutes=20 * i), k) for i, k in enumerate(kinds)], "stream_id string, event_id long, ts timestamp, kind string")
    stale = rn.since_reset(df, F.col("kind") != "h", F.col("kind") == "h")
    got = [r.streak for r in stale.orderBy("event_id").collect()]
    want, run = [], 0
    for k in kinds:
        run = 0 if k == "h" else run + 1
        want.append(run)
    assert got == want
    outage = rn.since_reset(df, F.col("kind") == "e", F.col("kind") == "h")
    assert rn.first_reaching(outage, 4).first().event_id == 13


def test_budget_stops_at_the_first_failing_charge(spark):
    df = spark.createDataFrame([("r", i, START + timedelta(hours=i), a) for i, a in enumerate([4, 3, 5, 1, 0])], "stream_id string, event_id long, ts timestamp, amount long")
    cut = rn.budget_cut(df, 8)
    assert [r.fits for r in cut.orderBy("event_id").collect()] == [True, True, False, False, False]
    assert tuple(rn.binding_limits(cut).first()) == ("r", 2, 7, True)


def test_retry_and_leases(spark):
    tasks = spark.createDataFrame([("r", "n", x, "task.planned") for x in ("a", "a", "b")] + [("r", "n", "a", "task.finished")], "run_id string, target_id string, relation string, type string")
    tried = rn.attempts(tasks)
    assert {(r.relation, r.times, r.attempts) for r in tried.collect()} == {("a", 2, 3), ("b", 1, 3)}
    assert [(r.relation, r.attempts) for r in rn.retried(tried, ["a"]).collect()] == [("b", 1)]
    jobs = spark.createDataFrame([("j1", "running", 5), ("j2", "running", 50), ("j3", "completed", 5)], "job_id string, status string, lease_until int")
    lost = rn.expired_leases(jobs, 10)
    assert [(r.job_id, r.status) for r in lost.collect()] == [("j1", "partial")]
    wanted = spark.createDataFrame([("j1", "n1", "geography"), ("j1", "n2", "geography"), ("j2", "n1", "geography")], "job_id string, node_id string, kind string")
    have = wanted.where("node_id = 'n1'")
    assert [(r.node_id, r.outcome) for r in rn.unfinished_results(lost, wanted, have).collect()] == [("n2", "unresolved")]


def test_chat_context(spark):
    nodes = spark.createDataFrame([("g", f"n{i}", f"part {i}", "n0") for i in range(6)] + [("g", "x", "tin solder", "n0")], "graph_id string, id string, label string, root_id string")
    ask = spark.createDataFrame([("q", "g")], "request_id string, graph_id string")
    focus = spark.createDataFrame([("q", "n4")], "request_id string, id string")
    words = spark.createDataFrame([("q", "solder"), ("q", "tin")], "request_id string, word string")
    shown = rn.chat_nodes(nodes, ask, focus, words, 3)
    assert [r.id for r in shown.orderBy("rank").collect()] == ["n4", "x", "n0"]
    edges = spark.createDataFrame([("g", "e1", "x", "n0"), ("g", "e2", "n4", "n0"), ("g", "e3", "n5", "n0")], "graph_id string, edge_id string, source_node_id string, target_node_id string")
    none = ask.where("false").select("request_id", F.lit("").alias("edge_id"))
    lines = rn.chat_edges(edges, shown, none)
    assert [r.edge_id for r in lines.orderBy("rank").collect()] == ["e2", "e1"]
    claims = spark.createDataFrame([("e1", f"c{i}", i) for i in range(5)], "edge_id string, claim_id string, ord int")
    evidence = spark.createDataFrame([(f"c{i}", f"v{i}{j}") for i in range(5) for j in range(3)], "claim_id string, evidence_id string")
    assert rn.chat_evidence(claims, evidence, lines).count() == 6
    assert [r.id for r in rn.selection_faults(spark.createDataFrame([("n1",), ("zz",)], "id string"), nodes).collect()] == ["zz"]


RAW = "request_id string, ordinal int, name string, category string, quantity double, unit string, material string, manufacturer string, part_number string, notes string, parent_name string, evidence_ids array<string>, general_knowledge boolean, confidence string"


def raw(n, name, ids, confidence="high", quantity=None, parent=None, general=False):
    return ("q", n, name, "component", quantity, None, None, None, None, None, parent, ids, general, confidence)


def test_item_projection(spark):
    rows = spark.createDataFrame(
        [
            raw(0, "Main PCB", []), raw(1, "Chip", ["E1", "E1", "E999"], quantity=1.0), raw(2, "Battery", ["S1"], parent="Battery"), raw(3, "Ribbon cable", ["E1"], parent=" chip "),
            raw(4, "CHIP", ["S1"], "low", quantity=7.0), raw(5, "Screw", ["E1"], general=True), raw(6, "Overflow", ["E1"]), raw(7, "battery ", ["E1"], "low", quantity=3.0),
        ],
        RAW,
    )
    registry = spark.createDataFrame([("q", "E1", "web_page", "p1"), ("q", "S1", "search_snippet", "s1")], "request_id string, evidence_id string, ref_type string, ref string")
    items, sources, unknown = it.project_items(rows, registry, 5)
    got = {r.name: (r.basis, r.confidence, r.quantity, r.parent_key) for r in items.collect()}
    assert got == {
        "Main PCB": ("guessed", "medium", None, None), "Chip": ("evidenced", "high", 1.0, None), "Battery": ("evidenced", "low", 3.0, None),
        "Ribbon cable": ("evidenced", "high", None, "chip"), "Screw": ("evidenced", "high", None, None),
    }
    assert [r.evidence_id for r in unknown.collect()] == ["E999"]
    kinds = {(r.name_key, r.ref_type, r.ref) for r in sources.collect()}
    assert {k for k in kinds if k[0] == "chip"} == {("chip", "web_page", "p1"), ("chip", "search_snippet", "s1")}
    assert ("main pcb", "model_knowledge", "no_source") in kinds and ("screw", "model_knowledge", "some_fields") in kinds


def test_items_of_hot_requests_are_as_others(spark, monkeypatch):
    """Before, all rows were dealt by what they cite, written, and dealt again by name and by parent."""
    rng = random.Random(4)
    rows = [(f"q{i % 3}", *raw(i, rng.choice(["Chip", "chip ", "Bolt", "Cable"]), rng.sample(["E1", "S1", "E9"], rng.randint(0, 3)), rng.choice(["low", "high"]),
                               rng.choice([None, 1.0, 2.0]), rng.choice([None, "bolt", "chip"]), rng.random() < 0.5)[1:]) for i in range(60)]
    frame = spark.createDataFrame(rows, RAW)
    registry = spark.createDataFrame([(f"q{i}", e, t, "x") for i in range(3) for e, t in (("E1", "web_page"), ("S1", "search_snippet"))],
                                     "request_id string, evidence_id string, ref_type string, ref string")
    got = [[sorted(map(repr, t.collect())) for t in it.project_items(frame, registry, by_request=True, hot_rows=n)] for n in (5, 10**6)]
    assert got[0] == got[1] and all(got[0])
    real, written = it.materialize, []
    monkeypatch.setattr(it, "materialize", lambda df: (written.append(df.columns), real(df))[1])
    it.project_items(frame, registry, by_request=True)
    assert written == [["request_id"]]


def test_fallback_items(spark):
    schema = "request_id string, ordinal int, name string, category string, quantity double, unit string, material string, manufacturer string, part_number string, notes string, ref_type string, ref string"
    fill = (None,) * 6
    rows = spark.createDataFrame([("q", 1, "Lens", "component", *fill, "image_analysis", "i1"), ("q", 2, "LENS", "component", *fill, "web_page", "w1"), ("q", 3, "Case", "component", *fill, "image_analysis", "i1"), ("q", 4, None, "component", *fill, "web_page", "w2"), ("q", 5, "Third", "component", *fill, "web_page", "w2")], schema)
    got = {r.name: (r.basis, r.confidence, r.sources) for r in it.fallback_items(rows, 2).collect()}
    assert got == {"Lens": ("evidenced", "medium", 2), "Case": ("inferred", "low", 1)}


@pytest.mark.parametrize("quotes", [["ab cd ef gh ij", "cd ef", "gh", "f gh i", "zz top", "cd ef gh ij kl"]])
def test_quotes_are_found_without_a_cross_join(spark, quotes):
    rng = random.Random(2)
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "xab"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for i in range(30)] + [(99, "xab cd ef gh ijz")]
    found = dc.find_quotes(
        spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string"), spark.createDataFrame(docs, "doc_id int, body string")
    )
    assert {(r.quote_id, r.doc_id) for r in found.collect()} == {(q, d) for q, quote in enumerate(quotes) for d, body in docs if quote in body}


def test_page_ranking_and_host_cap(spark):
    pages = spark.createDataFrame(
        [(0, "https://shop.example.com/buy-widget", "Buy Widget", "x"), (1, "https://www.ifixit.com/Teardown/Widget", "Widget Teardown", "x"), (2, "https://acme.com/docs/widget-datasheet.pdf", "Datasheet", "x"), (3, "https://news.org/widget", "Widget news", None)],
        "pos int, url string, title string, body string",
    )
    out = dc.rank_pages(pages.withColumn("k", F.lit(1)), ["k"], 4, source_types=["datasheet"], product="Widget", company="Acme").orderBy("rank").collect()
    assert [r.pos for r in out][:2] == [2, 1] and out[-1].pos == 0
    hits = spark.createDataFrame([(i, f"https://a.org/{i}", "q") for i in range(5)] + [(9, "https://a.org/4", "r"), (10, "https://b.org/", "q"), (11, "https://www.reddit.com/", "q")], "pos int, url string, query string")
    ranked = dc.rank_hits(hits)
    capped = dc.cap_per_host(ranked, 10, fetched=spark.createDataFrame([("https://a.org/0",)], "url string"))
    assert [r.url for r in capped.collect()] == ["https://a.org/4", "https://a.org/1", "https://b.org/"]


def test_reused_findings(spark):
    findings = spark.createDataFrame([("h", "A1x", None, None, None), ("h", "B1x", "Whole", "component", None), ("h", "C1x", None, None, "span_not_found")], "content_hash string, label string, object_label string, object_kind string, rejection string")
    analysed = spark.createDataFrame([("h", "Widget", "product")], "content_hash string, first_target_label string, first_target_kind string")
    targets = spark.createDataFrame([("h", "t2")], "content_hash string, target_id string")
    got = {(r.label, r.object_label, r.object_kind, r.target_id) for r in dc.reusable_findings(findings, analysed, targets).collect()}
    assert got == {("A1x", "Widget", "product", "t2"), ("B1x", "Whole", "component", "t2")}


def write(tmp_path, text, name="b.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bom_csv(spark, tmp_path):
    path = write(tmp_path, "component,quantity,unit\n" + "".join(f"part {i},{i},ea\n" for i in range(12)))
    rows, rejects, warnings = readers.read_bom_csv(spark, path)
    assert rows.count() == 12 and rejects.count() == 0 and warnings.count() == 0
    assert rows.where("label = 'part 3'").first().span == '{"component":"part 3","kind":"component","quantity":3.0,"unit":"ea"}'
    path = write(tmp_path, "material,quantity,unit\ntin,2,g\nunknownite,,\n\"a, b\",x,\n", "m.csv")
    rows, rejects, warnings = readers.read_bom_csv(spark, path)
    assert {(r.label, r.kind, r.quantity, r.unit) for r in rows.collect()} == {("tin", "material", 2.0, "g"), ("unknownite", "material", None, None), ("a, b", "material", None, None)}
    assert {(r.label, r.warning) for r in warnings.collect()} == {("unknownite", "quantity_unknown"), ("a, b", "quantity_invalid")}
    path = write(tmp_path, "part,kind,qty\nx,component,1\ny,,2\nz,component\nw,component,1,9\n,component,1\nn,component,-1\ni,component,inf\n", "r.csv")
    rows, rejects, warnings = readers.read_bom_csv(spark, path)
    assert sorted(r.reason for r in rejects.collect()) == ["kind", "label_empty", "ragged_row", "ragged_row"]
    assert {(r.label, r.quantity) for r in rows.collect()} == {("x", 1.0), ("n", None), ("i", None)}


@pytest.mark.parametrize("header", ["", "a,b", "part,part", "part,,x", ",".join(f"c{i}" for i in range(31))])
def test_bad_csv_headers(spark, tmp_path, header):
    with pytest.raises(ValueError):
        readers.read_bom_csv(spark, write(tmp_path, header + "\n1,2\n"))


def test_estimates(spark, tmp_path):
    def item(i, parent=None, source="s1", url="https://a.org/"):
        return {"id": i, "name": i, "category": "component", "parent_item_id": parent, "sources": [{"type": "web_page", "source_id": source, "url": url}]}

    good = {"id": "e1", "status": "completed", "product": {"name": "W"}, "items": [item("a"), item("b", "a")], "sources": [{"id": "s1", "url": "https://a.org/"}]}
    bad = {
        "id": "e2", "status": "partial", "product": {"name": "W"}, "sources": [{"id": "s1", "url": "https://a.org/"}, {"id": "s1", "url": "https://b.org/"}],
        "items": [item("a", "b"), item("b", "a"), item("c", "zz"), item("d", source="s9"), item("d"), item("f", url="http://localhost/")],
    }
    for n, doc in enumerate((good, bad)):
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=1))
    items, sources = readers.read_estimates(spark, str(tmp_path))
    got = {tuple(r) for r in readers.estimate_violations(items, sources).collect()}
    assert got == {
        ("e2", "a", "parent_cycle"), ("e2", "b", "parent_cycle"), ("e2", "c", "parent_dangling"), ("e2", "d", "item_id_repeated"),
        ("e2", "s1", "source_id_repeated"), ("e2", "d", "source_missing"), ("e2", "f", "source_not_public"),
    }


def test_geojson_and_exports(spark, tmp_path):
    shares = spark.createDataFrame([("CN", f"m{i}", "tin", 0.1, 2024) for i in range(5)] + [("US", "m1", "tin", 0.2, 2024)], "country string, material_node_id string, commodity string, share double, year int")
    lines = [json.loads(r.value) for r in sinks.country_features(shares).collect()]
    assert Counter(p["properties"]["country_iso2"] for p in lines) == {"CN": 5, "US": 1}
    assert all(p["geometry"] is None for p in lines)
    assert {p["properties"]["material_node_id"] for p in lines} == {f"m{i}" for i in range(5)}
    sinks.write_geojson(sinks.country_features(shares), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 6
    for day in (1, 1, 2):  # a retried write does not double its revision
        sinks.save_revision(spark.createDataFrame([("g", day, "n")], "graph_id string, revision int, id string"), str(tmp_path / "rev"))
    assert spark.read.parquet(str(tmp_path / "rev")).count() == 2
    sinks.write_export({"source": spark.createDataFrame([("s", "body")], "id string, _body string")}, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/source")).columns == ["id"]
    events = spark.createDataFrame([(1, "a")], "seq int, type string")
    for _ in range(2):
        sinks.append_events(events, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_ledger_scan(spark):
    ledger = spark.createDataFrame([("w", "run", "p", f"2026-01-0{i}", f"id{i}", '{"status":"completed"}' if i % 2 else '{"status":"failed"}') for i in range(1, 5)] + [("v", "run", "p", "2026-01-09", "x", "{}")], "workspace string, kind string, parent_id string, created_at string, id string, json string")
    ledger = ledger.withColumn("data", F.parse_json("json"))
    assert [r.id for r in readers.ledger_scan(ledger, "w", "run").select("id").collect()] == ["id4", "id3", "id2", "id1"]
    assert [r.id for r in readers.ledger_scan(ledger, "w", "run", "p", "completed").select("id").collect()] == ["id3", "id1"]


def test_extractor_hook(spark):
    def upper(frames):
        for frame in frames:
            yield frame.assign(label=frame["body"].str.upper())[["url", "label"]]

    pages = spark.createDataFrame([("u", "chip")], "url string, body string")
    assert [tuple(r) for r in readers.extract_findings(pages, upper, "url string, label string").collect()] == [("u", "CHIP")]


def test_remaining_helpers(spark, tmp_path):
    from traceloom.functions import sites as st
    from traceloom.functions import text as tx
    from traceloom.operators import gates

    df = spark.createDataFrame([("abcdef", "cd", "ff")], "b string, s string, h string")
    assert df.select(tx.hashed_locator("b", "s", "h")).first()[0] == "chars 2:4;sha256=ff"
    places = spark.createDataFrame(
        [("5509 N.W. Parker Street, Camas, WA 98607", None, "address"), ("12 Elm Road, Oak Street, Camas, WA", "Washington", "address"), ("Kunshan, China", "Jiangsu", "city"), (None, None, "country")],
        "a string, admin1 string, p string",
    ).withColumn("country", F.when(F.col("a").contains("Kunshan"), "China").otherwise("United States"))
    places = places.withColumn("c", st.place_candidates("a", "country"))
    got = [r[0] for r in places.select(st.short_city("c", "admin1", "country", "p")).collect()]
    assert got == ["Camas", "Camas", "Kunshan", "United States"]
    strict = "kind string, label_key string, predicate string, object_kind string, object_key string, scope_type string, scope_key string, quote string, body string"
    rows = [
        (("component", "a", "PART_OF", "product", "w", "product", "w", "q1", "x q1 y"), None),
        (("component", "a", "PART_OF", "product", "w", "product", "w", "q1", "q1 q1"), "span_not_found"),
        (("component", "a", "PART_OF", "product", "w", "product", "v", "q1", "q1"), "scope_mismatch"),
        (("component", "w", "PART_OF", "component", "w", "generic", None, "q1", "q1"), "predicate_invalid"),
        (("organization", "o", "PRODUCES", "component", "a", "company", "o", "q1", "q1"), None),
        (("organization", "o", "PRODUCES", "component", "a", "company", "z", "q1", "q1"), "scope_mismatch"),
        (("organization", "o", "PRODUCES", "component", "a", "generic", "o", "q1", "q1"), "scope_mismatch"),
        (("organization", "o", "PRODUCES", "product", "w", "generic", None, "q1", "q1"), "scope_mismatch"),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], "i int, " + strict)
    roles = {c.split()[0]: c.split()[0] for c in strict.split(", ")}
    reason = gates.strict_rejection({**roles, "root_key": F.lit("w"), "company_key": F.lit(None).cast("string")})
    assert {r.i: r.v for r in df.select("i", reason.alias("v")).collect()} == {i: want for i, (_, want) in enumerate(rows)}
    items = spark.createDataFrame([("e1", "Board  Five"), ("e2", "Other")], "estimate_id string, product string")
    asked = spark.createDataFrame([("e1", "board five"), ("e2", "board five")], "estimate_id string, product string")
    assert [r.estimate_id for r in readers.product_mismatches(items, asked).select("estimate_id").collect()] == ["e2"]
    docs = spark.createDataFrame([("q", "W", "u", "has the chip inside"), ("q", "V", "u", "has the chip inside")], "request_id string, product string, url string, body string")
    parts = spark.createDataFrame([("W", "Chip", "the chip", "r"), ("W", "Lens", "the lens", "r")], "product string, label string, span string, rationale string")
    assert [r.name for r in it.curated_items(docs, parts).collect()] == ["Chip"]
    runs = spark.createDataFrame([("r1", 1)], "run_id string, generated_at int")
    rows = spark.createDataFrame([("r1", "x", "p")], "run_id string, v string, _private string")
    sinks.write_bundle(str(tmp_path / "b"), {"nodes": rows}, rows, rows, rows, runs)
    assert spark.read.json(str(tmp_path / "b/bom")).columns == ["v", "run_id"]


def test_citations_are_looked_up_once_per_list_and_keep_repeats(spark):
    raw = spark.createDataFrame(
        [(1, 1, "Bolt", "component", None, ["E1", "E1", "X"]), (1, 2, "bolt", "component", None, ["E1", "E1", "X"]), (1, 3, "Nut", "component", "Bolt", None),
         (2, 1, "Nut", "component", None, []), (None, 1, "Nut", "component", None, ["E1"])],
        "request_id int, ordinal int, name string, category string, parent_name string, evidence_ids array<string>",
    ).selectExpr("*", *[f"cast(null as string) as {c}" for c in it.FIELDS], "true as general_knowledge", "'high' as confidence")
    registry = spark.createDataFrame([(1, "E1", "web_page", "w1"), (1, "E1", "search_snippet", "s1")], "request_id int, evidence_id string, ref_type string, ref string")
    items, sources, unknown = it.project_items(raw, registry)
    found = {(r.request_id, r.name_key): (r.basis, r.confidence, r.parent_key) for r in items.collect()}
    assert found[1, "bolt"] == ("evidenced", "high", None) and found[1, "nut"] == ("guessed", "medium", "bolt") and found[2, "nut"] == ("guessed", "medium", None)
    assert {(r.request_id, r.name_key, r.ref_type, r.ref, r.ordinal) for r in sources.where("ref_type <> 'model_knowledge'").collect()} == {
        (1, "bolt", "web_page", "w1", 1), (1, "bolt", "search_snippet", "s1", 1)}
    assert sorted(tuple(r) for r in unknown.collect() if r.request_id == 1) == [(1, "X", 1), (1, "X", 2)]
    joins = sources._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in joins  # read from the rows written once, where every table repeated the look-up before
