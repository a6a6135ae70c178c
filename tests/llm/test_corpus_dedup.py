"""Exact, line, substring, n-gram and embedding dedup against brute force on a small corpus."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import embeddings, exact_dedup, line_dedup, linking, ngram_join, substrings

BIG = 1 << 62


def key(doc_id):
    return BIG if doc_id is None else doc_id


def test_exact_groups(spark):
    rows = corpus.documents()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = defaultdict(list)
    for r in rows:
        ids[normal(r[1])].append(r[0])
    got = exact_dedup.exact_groups(corpus.frame(spark), block_bytes=16).collect()
    assert len(got) == len(rows)
    want, kept = Counter(), 0
    for r in rows:
        own = ids[normal(r[1])]
        least = min(own, key=key)
        want[r[0], least, len(own), hashlib.sha256(normal(r[1]).encode()).hexdigest()] += 1
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    kept = Counter(g.text_sha256 for g in got if g.kept)
    assert set(kept.values()) == {1} and len(kept) == len(ids)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


def test_exact_copies_are_dropped_whole(spark):
    docs = corpus.frame(spark)
    stay = exact_dedup.drop_exact_copies(docs, block_bytes=64)
    assert stay.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in stay.collect()]
    assert len(texts) == len(set(texts)) == len(
        {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in corpus.documents()})


def brute_repeats(rows):
    """Per (id, text): removed bytes, spans and digest, by looking every string up."""
    order = sorted({(key(r[0]), r[1] or "") for r in rows})
    seen, out = set(), {}
    for doc, text in order:
        raw = text.encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - 99):
            string = raw[i : i + 100]
            if string in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(string)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        stays = bytes(b for b, c in zip(raw, cover) if not c)
        out[doc, text] = (len(raw), sum(cover), spans, hashlib.sha256(stays).hexdigest())
    return out


def test_substrings(spark, monkeypatch):
    rows = [r for r in corpus.documents()]
    want = brute_repeats(rows)
    got = substrings.remove_repeats(corpus.frame(spark))
    got = Counter((key(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got.collect())
    assert got == Counter((key(r[0]), *want[key(r[0]), r[1] or ""]) for r in rows)
    assert sum(g[2] for g in got) > 0


def test_substrings_across_segments_and_batches(monkeypatch):
    """The index family in small batches and texts in small segments give the same runs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    shared = " ".join(word() for _ in range(300))
    docs = [" ".join(word() for _ in range(150)) + shared[rng.randint(0, 200) :][:400] for _ in range(12)]
    docs += [shared, "a" * 700, docs[3][50:] + docs[5][:300]]
    want = brute_repeats([(i, t) for i, t in enumerate(docs)])
    import pyarrow as pa

    for segment, batch in ((1 << 20, 1 << 16), (64, 16)):
        monkeypatch.setattr(substrings, "SEGMENT", segment)
        monkeypatch.setattr(substrings, "BATCH", batch)
        table = pa.record_batch({"doc": pa.array(range(len(docs)), pa.int64()),
                                 "tie": pa.array([0] * len(docs), pa.int64()), "text": pa.array(docs)})
        dealt = pa.Table.from_batches(substrings._deal(1)([table]))
        found = substrings._scan(dealt).to_pylist()
        asked = defaultdict(list)
        for f in found:
            if not f["repeat"]:
                asked[f["doc"]].append({k: f[k] for k in ("bucket", "first", "last")})
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
        wanted = pa.record_batch({
            "doc": pa.array(list(asked), pa.int64()), "tie": pa.array([0] * len(asked), pa.int64()),
            "text": pa.array([docs[d] for d in asked]), "asked": pa.array(list(asked.values()), kind)})
        edges = substrings._repeated_strings(
            pa.Table.from_batches(substrings._hash_strings([wanted]))).to_pylist() if asked else []
        runs = defaultdict(list)
        for f in [f for f in found if f["repeat"]] + edges:
            runs[f["doc"]].append(f)
        for i, text in enumerate(docs):
            spans, stays = substrings._cut(text.encode(), runs[i])
            assert (len(text) - len(stays), len(spans)) == want[i, text][1:3]


def test_index_family_levels():
    family = substrings.IndexFamily()
    entries = np.zeros(7, substrings.ENTRY)
    entries["gram"], entries["run"], entries["place"] = [1, 2, 1, 1, 3, 1, 2], [1, 1, 2, 1, 1, 2, 1], range(7)
    repeats = [family.add(entries[i : i + 1]) for i in range(7)]
    assert [len(r) for r in repeats] == [0, 0, 0, 1, 0, 1, 1]
    assert [n for n, *_ in family.levels] == [4, 2, 1]
    assert sorted(family.differing()["place"].tolist()) == [0, 2]


def brute_sets(rows):
    sets = {}
    for r in rows:
        w = corpus.words_of(r[1])
        sets.setdefault((key(r[0]), r[1]), {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5
                        else ({tuple(w)} if w else set()))
    return sets


def brute_groups(sets):
    items, links = sorted(sets.items(), key=lambda x: x[0][0]), []
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((a, b))
    names = {k: (k[0], k[1] or "") for k in sets}
    whole = corpus.components(set(names.values()), [(names[a], names[b]) for a, b in links])
    return {k: whole[n][0] for k, n in names.items()}, len(links)


def test_ngram_groups(spark):
    rows = corpus.documents()
    sets = brute_sets(rows)
    groups, links = brute_groups(sets)
    got = ngram_join.ngram_groups(corpus.frame(spark)).collect()
    got = Counter((key(g.doc_id), g.n_shingles, key(g.component_id)) for g in got)
    want = Counter((key(r[0]), len(sets[key(r[0]), r[1]]), groups[key(r[0]), r[1]]) for r in rows)
    assert links > 60 and got == want


def test_one_document_of_each_group_stays(spark):
    rows = corpus.documents()
    groups, _ = brute_groups(brute_sets(rows))
    docs = corpus.frame(spark)
    stay = ngram_join.keep_one_per_group(docs)
    assert stay.columns == docs.columns
    got = Counter(key(r.doc_id) for r in stay.collect())
    want = {k[0] for k, v in groups.items() if v == k[0]}
    assert set(got) == want
    assert all(n == 1 for d, n in got.items() if d != BIG)


@pytest.mark.parametrize("boundary", [0, 4, 12])
def test_boundary_of_small_sets_does_not_change_links(spark, monkeypatch, boundary):
    monkeypatch.setattr(ngram_join, "small_boundary", lambda *a, **k: boundary)
    rng = random.Random(boundary)
    sets = []
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17] * 3:
        base = sorted(rng.sample(range(1, 1000), n))
        sets += [base, sorted({*base[1:], rng.randint(1, 1000)}), sorted({*base, rng.randint(1, 1000)})]
    sets = [list(x) for x in {tuple(s) for s in sets}]
    rows = [(i, len(s), bytearray(np.asarray(s, np.uint64).tobytes())) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "id long, n long, hashes binary")
    got = {r.node: r.root for r in ngram_join.link_sets(frame).collect()}
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len({*sets[i]} & {*sets[j]}) >= 75 * len({*sets[i]} | {*sets[j]})]
    want = corpus.components(range(len(sets)), links)
    assert {i: got.get(i, i) for i in want} == want and links


def test_least_shared_is_a_lower_bound():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(10_000), n))
        b = {*rng.sample(sorted(a), rng.randint(max(1, n * 3 // 4), n)), *rng.sample(range(10_000), rng.randint(0, n // 4))}
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        x, y = sorted(a), sorted(b)
        shared = len({*x[: ngram_join._first_part(len(x))]} & {*y[: ngram_join._first_part(len(y))]})
        assert shared >= max(ngram_join.least_shared(len(x)), ngram_join.least_shared(len(y)))


def test_a_bucket_of_near_items_is_linked_without_all_pairs(spark):
    """Thousands of items in one bucket: pairs tried stay in proportion to members."""
    n, tried = 3000, []
    buckets = spark.range(n).select(F.lit(1).alias("bucket"), "id")

    def verify(pairs):
        tried.append(pairs.count())
        return pairs.where("a % 2 = b % 2")

    roots = {r.node: r.root for r in linking.linked_groups(buckets, verify, rounds=1).collect()}
    assert all(roots.get(i, i) == i % 2 for i in range(n))
    assert tried[0] < n
    buckets = spark.range(n).select(F.explode(F.array(F.lit(1), F.col("id") % 7 + 2)).alias("bucket"), "id")
    del tried[:]
    roots = {r.node: r.root for r in linking.linked_groups(
        buckets, lambda p: (tried.append(p.count()), p.where("abs(a - b) < 2900"))[1]).collect()}
    assert all(roots.get(i, i) == 0 for i in range(n)) and sum(tried) < 12 * n


def test_lines(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(6)]
    docs = [(i, "\n".join([rng.choice(base), "", f"Page {i}!", " ".join(rng.choice(vocabulary) for _ in range(9)),
                           rng.choice(base)[:-1] + rng.choice("abc"), "1234"])) for i in range(25)]
    docs += [(25, None), (26, ""), (27, docs[0][1]), (None, base[0].upper()), (3, docs[3][1])]
    rows = [(d, t, None, None, None, *corpus.EXTRA) for d, t in docs]
    frame = corpus.frame(spark, rows)
    got = line_dedup.judge_lines(frame).collect()
    places = [(key(d), n, line) for d, t in docs if t is not None for n, line in enumerate(t.split("\n"))]
    assert Counter((key(g.doc_id), g.line_no) for g in got) == Counter(p[:2] for p in places)
    letters = lambda x: " ".join("".join(c if c.isalpha() else " " for c in x.lower()).split())
    normal = {p: letters(p[2]) or " ".join(p[2].split()) for p in places}
    forms = sorted({n for n in normal.values() if n})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    links = [(a, b) for i, a in enumerate(forms) for b in forms[:i]
             if edits(a, b) <= math.floor(max(len(a), len(b)) * 0.15 + 1e-9)]
    group = corpus.components(forms, links)
    first, size = {}, Counter()
    for p in places:
        if normal[p]:
            g = group[normal[p]]
            first[g] = min(first.get(g, (BIG + 1,)), p[:2])
            size[g] += 1
    want = Counter((p[0], p[1], size[group[normal[p]]] if normal[p] else 1,
                    not normal[p] or first[group[normal[p]]] == p[:2]) for p in places)
    assert Counter((key(g.doc_id), g.line_no, g.group_size, g.kept) for g in got) == want
    assert links
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame).collect() if r.doc_id in (0, 25, 26)}
    assert kept[25] is None and kept[26] == "" and len(kept[0].split("\n")) >= 4


def test_embeddings(spark):
    rng = np.random.RandomState(1)
    base = rng.randn(40, 16)
    vectors = [(base[i % 40] + rng.randn(16) * s).tolist() for i, s in zip(range(300), [0.02, 0.1, 0.2, 0.3, 0.5] * 60)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(300, vectors[0]), (301, vectors[0]), (5, vectors[5]), (302, [3e-200 * x for x in vectors[1]]),
             (303, [2e200 * x for x in vectors[1]]), (304, None), (305, []), (306, [0.0] * 16),
             (307, [float("nan")] + [1.0] * 15), (308, [float("inf")] + [1.0] * 15), (309, [None] + [1.0] * 15),
             (310, [1.0, 0.0]), (311, [0.97, 0.1]), (None, vectors[2]), (312, (-base[0]).tolist())]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "vec_id long, embedding array<double>, key string, links int").repartition(4)
    unit, sound = [], []
    for _, v in rows:
        ok = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        sound.append(ok)
        x = np.asarray(v, float) / np.abs(v).max() if ok else np.zeros(1)
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sound[i] and sound[j]
             and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95]
    degree = Counter(x for pair in links for x in pair)
    order = sorted(range(len(rows)), key=lambda i: (key(rows[i][0]), i))
    at = {i: n for n, i in enumerate(order)}
    whole = corpus.components(range(len(rows)), [(at[i], at[j]) for i, j in links])
    want = Counter()
    for i, r in enumerate(rows):
        component = rows[order[whole[at[i]]]][0]
        want[r[0], degree[i], component, r[0] == component] += 1
    for tile in (8192, 50):
        got = embeddings.embedding_groups(frame, tile=tile).collect()
        assert Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == want
    assert len(links) > 300


def test_quantisation_bound_is_rigorous():
    rng = np.random.RandomState(2)
    x = rng.randn(400, 64)
    x[:50] = np.eye(64)[rng.randint(0, 64, 50)] + 1e-3 * rng.randn(50, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, error = embeddings._quantised(x)
    back = q * scale[:, None]
    bound = error[:, None] * (1 + error[None]) + error[None]
    assert (np.abs(x @ x.T - back @ back.T) <= bound + 1e-12).all()


def test_empty_tables(spark):
    docs = corpus.frame(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns
    assert substrings.remove_repeats(docs).count() == 0
    assert ngram_join.ngram_groups(docs).count() == 0
    assert line_dedup.judge_lines(docs).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.embedding_groups(empty).count() == 0
