"""Quality, language and url models: held-out accuracy, rules against brute force, edge cases."""

import random
import zlib

import corpus
import numpy as np
import pytest

from traceloom.llm import language, quality, url_filters

SYLLABLES = {"en": "the ing and ion tha ent", "fr": "les ion eau que oux eme", "de": "sch ein und ich ung ber"}


def prose(rng, lang, n, junk=False):
    parts = SYLLABLES[lang].split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w.upper() + "!!" if junk else w for w in words)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        lang, junk = rng.choice(list(SYLLABLES)), rng.random() < 0.3
        docs.append((i, prose(rng, lang, rng.randint(20, 120), junk), lang if i % 7 else None, "s", 1, *corpus.EXTRA))
        labels.append((i, None if i % 50 == 9 else int(not junk), 0))
    rows = corpus.documents()
    docs += [(d[0] + 1000 if d[0] is not None else None, *d[1:]) for d in rows]
    return docs, labels + [(None, 1, 0), (99999, 0, 0), (5, labels[5][1], 0)], {i: y for i, y, _ in labels}


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % mod


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    frame = corpus.frame(spark, docs)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge_quality(frame, labels).collect()
    assert sorted(str(g.doc_id) for g in got) == sorted(str(d[0]) for d in docs)
    for g in got:
        assert g.held_out == (crc(g.doc_id, 4) == 2) and 0 <= g.score <= 1
        assert g.predicted == int(g.score >= 0.7)
    held = [(g.score >= 0.5) == truth[g.doc_id] for g in got if g.held_out and truth.get(g.doc_id) is not None]
    assert len(held) > 60 and np.mean(held) > 0.95
    again = {g.doc_id: g.score for g in quality.judge_quality(frame.repartition(3), labels).collect()}
    assert all(abs(again[g.doc_id] - g.score) < 1e-6 for g in got)
    kept = quality.keep_accepted(frame, labels)
    assert kept.columns == frame.columns
    assert sorted(str(k.doc_id) for k in kept.collect()) == sorted(str(g.doc_id) for g in got if g.predicted)


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(corpus.frame(spark), labels).collect()
    assert {g.score for g in got} == {0.5}
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(corpus.frame(spark, []), one).count() == 0


def test_labels_of_held_out_documents_are_not_learned_from(spark, labelled):
    docs, labels, _ = labelled
    wrong = [(i, 1 - y if y is not None and crc(i, 4) == 2 else y, t) for i, y, t in labels]
    frame = corpus.frame(spark, docs)
    a, b = ({g.doc_id: g.score for g in quality.judge_quality(
        frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, wrong))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_temperature_is_calibrated():
    rng = np.random.RandomState(0)
    x = rng.randn(4000, 5)
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    net = quality.fit_network(x, (rng.rand(4000) < p).astype(float))
    assert abs(quality.network_scores(x, net) - p).mean() < 0.08


def test_language(spark, labelled):
    docs = labelled[0]
    got = language.predict_languages(corpus.frame(spark, docs)).collect()
    assert sorted(str(g.doc_id) for g in got) == sorted(str(d[0]) for d in docs)
    text = {d[0]: d for d in docs}
    right = []
    for g in got:
        assert g.held_out == (crc(g.doc_id, 3) == 1) and 0 <= g.score <= 1
        lettered = any(c.isalpha() for c in (text[g.doc_id][1] or ""))
        assert (g.lang_pred == "und") == (not lettered)
        assert g.lang_pred in ("und", "en", "fr", "de")
        if g.held_out and g.doc_id is not None and g.doc_id < 1000 and text[g.doc_id][2]:
            right.append(g.lang_pred == text[g.doc_id][2])
    assert len(right) > 80 and np.mean(right) > 0.98


def test_language_without_anything_to_learn(spark):
    assert {g.lang_pred for g in language.predict_languages(corpus.frame(spark)).where("doc_id < 20").collect()} <= {"und", "en"}
    none = [(d[0], d[1], None, *d[3:]) for d in corpus.documents()]
    got = language.predict_languages(corpus.frame(spark, none)).collect()
    assert {(g.lang_pred, g.score) for g in got} == {("und", 0.0)}
    assert language.predict_languages(corpus.frame(spark, [])).count() == 0


def test_spans_of_mixed_text(spark, labelled):
    rng = random.Random(8)
    model = language.train_languages(corpus.frame(spark, labelled[0]))
    mixed = prose(rng, "en", 40) + ". " + prose(rng, "de", 50) + " " + prose(rng, "fr", 30)
    docs = spark.createDataFrame([(1, mixed), (2, None), (3, "12 34"), (4, prose(rng, "fr", 10))], "doc_id long, text string")
    spans = sorted(language.language_spans(docs, model).collect(), key=lambda s: (s.doc_id, s.span))
    assert [(s.doc_id, s.lang) for s in spans] == [(1, "en"), (1, "de"), (1, "fr"), (4, "fr")]
    assert [s.words for s in spans if s.doc_id == 1] == pytest.approx([40, 50, 30], abs=2)
    assert sum(s.words for s in spans if s.doc_id == 1) == 120 and spans[1].first_word == spans[0].words


def test_viterbi_against_all_paths():
    rng = np.random.RandomState(3)
    counts = np.array([4, 0, 1, 6, 3])
    scores = rng.randn(counts.sum(), 3) * 5
    path = language._paths(scores, counts)
    from itertools import product

    at = 0
    for n in counts:
        own = scores[at : at + n]
        if n:
            value = lambda p: sum(own[i, s] for i, s in enumerate(p)) - language.SWITCH * sum(
                a != b for a, b in zip(p, p[1:]))
            best = max(product(range(3), repeat=int(n)), key=value)
            assert value(path[at : at + n].tolist()) == pytest.approx(value(best))
        at += n


def test_scripts_narrow_languages(spark):
    rows = [(i, "слово дело народ время", "ru") for i in range(20)] + [(i + 20, "word deal people time", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_languages(docs)
    assert model["langs"] == ["en", "ru"]
    assert model["allowed"][1].tolist() == [True, False] and model["allowed"][3].tolist() == [False, True]
    assert model["allowed"][9].tolist() == [True, True]
    spans = language.language_spans(spark.createDataFrame([(1, "zzz zzz ббб ббб")], "doc_id long, text string"), model)
    assert [s.lang for s in sorted(spans.collect(), key=lambda s: s.span)] == ["en", "ru"]


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for kind, rule in url_filters.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, kind))
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "nothing", "://", "http://", "http://COM", "http://com/", "HTTP://A.Com/x?y=/z", "http://x.com?en/",
        "http://example.com/en/", "http://example.com/en", "http://Example.COM/en/a#b", "http://www.example.com/en/1",
        "http://m.www.example.com/en/1", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://netx/fr/",
        "http://a.net/de/1", "http://a.org/en/?u=http://b.com/", "x://y://z/com/", "http://É.com/\n/en/", "http://a.com:80/en/",
        "http://com./", "ftp://İ.net/es/ü?"]


def test_url_rules(spark):
    rows = [(i, u, None, "c") for i, u in enumerate(URLS)] + [(3, URLS[3], None, None), (None, "http://q.net/fr/", None, None)]
    got = url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    by = {g.page_id: g for g in got}
    for i, u in enumerate(URLS):
        host, path, rule, kind = brute_rule(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule), u
        assert by[i].verdict in ("allow", "block") and (kind is None or by[i].verdict == kind)
    assert by[None].verdict == "block"


def test_url_model_on_held_out_urls(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.4
        host = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
        url = f"http://{host}{'-' + str(rng.randint(100, 9999)) if bad else ''}.org/{'x/' * rng.randint(0, 3)}{'?a=1&b=2' if bad else ''}"
        rows.append((i, url, float(bad)))
    frame = spark.createDataFrame(rows, "page_id long, url string, label double")
    judged = url_filters.judge_urls(frame, labelled=frame.where("page_id % 3 > 0").select("url", "label")).collect()
    right = [(g.verdict == "block") == rows[g.page_id][2] for g in judged if g.page_id % 3 == 0]
    assert np.mean(right) > 0.95


def test_url_tables_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filters.judge_urls(one).first().verdict == "allow"
