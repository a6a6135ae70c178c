"""Importance resampling, chat formatting and vector codes against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from traceloom.llm import chat, resampling, vector_codes


# ---------------------------------------------------------------- resampling
def features(text, grams):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent, grams, buckets):
    slot = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(slot, features(text, grams)[1]))
    for text in target:
        t.update(map(slot, features(text, grams)[1]))
    out = []
    for doc, text in docs:
        words, found = features(text, grams)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
                 for b in map(slot, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(found), weight, score, len(words) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("grams, percent, buckets", [(1, 10, 10_000), (3, 37, 64), (1, 100, 7)])
def test_resample(spark, grams, percent, buckets):
    rng = random.Random(8)
    rows = corpus.documents()
    target = ["two words", None, rows[12][1], "ünique Ünique 日本語-text 42", ""]
    rows += [(2000 + i, " ".join(rng.choice(["Aa", "b9", "é", "x-y", "zz"]) for _ in range(rng.choice([19, 20, 21, 60]))),
              None, None, None, *corpus.EXTRA) for i in range(300)]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(corpus.frame(spark, rows), goal, percent=percent, grams=grams, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resample([r[:2] for r in rows], target, percent, grams, buckets)


def test_resample_of_nothing(spark):
    none = corpus.frame(spark, [])
    goal = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, goal).count() == 0
    got = resampling.resample(corpus.frame(spark), goal).collect()
    assert len(got) == len(corpus.documents())
    few = corpus.frame(spark, [(1, "only a few words", None, None, None, *corpus.EXTRA)])
    assert [r.rank for r in resampling.resample(few, goal).collect()] == [None]


def test_drawn_rows_keep_their_columns(spark):
    rows = [r for r in corpus.documents() if r[0] is not None]
    frame = corpus.frame(spark, list({r[0]: r for r in rows}.values()))
    got = resampling.drawn(frame, frame, percent=50)
    assert got.columns == frame.columns and 10 < got.count() < frame.count()


def test_one_source_of_half_the_rows_is_favoured(spark):
    """Texts like the target are drawn more often than the hot rest."""
    rng = random.Random(1)
    word = lambda s: rng.choice(s) * 3
    rows = [(i, " ".join(word("abc" if i % 10 else "xyz") for _ in range(30)), None, None, None, *corpus.EXTRA) for i in range(1000)]
    goal = spark.createDataFrame([("xxx yyy zzz " * 20,)], "text string")
    got = resampling.resample(corpus.frame(spark, rows), goal).where("rank is not null").collect()
    assert sorted(r.rank for r in got) == list(range(1, 101))
    assert sum(r.doc_id % 10 == 0 for r in got) > 50


# ---------------------------------------------------------------- chat
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|end|>", "<|", "|>", "<|image:0|>", "\\", "<", "[", "]",
            ">", "s>", "INST]", "\n", " ", "a", "é", "日", "/"]
TEXT = st.lists(st.sampled_from(CONTROLS), max_size=12).map("".join)
ROLE = st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool", "", "a|b>:<|role|>", "é \n"]))


@given(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=6))
@settings(max_examples=500, deadline=None)
def test_turns_read_back(turns):
    done = [chat.format_turn(role, text) for role, text in turns]
    whole = "".join(d[0] for d in done)
    assert chat.read_turns(whole) == turns
    at, learned = 0, []
    for formatted, loss, _, _ in done:
        learned += [chat.unescape(whole[at + s["a"] : at + s["b"]]) for s in loss]
        at += len(formatted)
    assert learned == [t for r, t in turns if r == "assistant" and t]


@given(TEXT)
@settings(max_examples=500, deadline=None)
def test_no_control_string_is_left_in_a_text(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|", escaped)


def test_parts(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (
        kind, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "look <"), part("text", "/s>"), part("image", ref="a.png", width=57, height=28),
                            None, part("text", "and"), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=2),
                            part("video", ref="d.mp4"), part("image")], "x"),
            (1, 1, "assistant", [part("text", "one"), part("image", ref="e.png", width=1, height=1), part("text", "two")], "x"),
            (1, 2, "assistant", None, "x"), (1, 3, "assistant", [], "x")]
    frame = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content {chat.PARTS}, formatted string")
    got = {r.turn: r for r in chat.format_conversations(frame, parts="content").collect()}
    first, second = got[0], got[1]
    assert first.formatted == (r"[INST] look <\/s><|image:0|>and<|audio:1|><|document:2|><|file:3|><|image:4|> [/INST]")
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [
        ("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 2048), ("file", "d.mp4", 0), ("image", None, 0)]
    assert all(first.formatted.startswith(f"<|{a.kind}:", a["at"]) for a in first.attachments) and first.tokens == 2089
    assert [second.formatted[s.a : s.b] for s in second.loss] == ["one", "two"]
    assert chat.read_turns(first.formatted) == [("user", "look </s>and")]
    assert got[2].formatted == got[3].formatted == " </s>" and got[2].loss == []


def test_conversations(spark):
    rng = random.Random(4)
    rows = [(None, 0, "user", "no id"), (None, 1, "assistant", None), (1, None, "system", "first"), (1, 0, None, ""),
            (2, 0, "assistant", "</s>" * 3000), (3, 5, "tool", "[INST]"), (3, 5, "tool", "[INST]"), (3, 4, "assistant", "\\<\\|")]
    rows += [(9, i, rng.choice(["user", "assistant"]), "hot " * rng.randint(0, 5) + "日<|") for i in range(2000)]  # a hot conversation
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns string, tokens int")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(frame.repartition(7))).collect()}
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    assert got.keys() == own.keys()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in own.items():
        turns.sort(key=lambda r: -1 if r[1] is None else r[1])
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        size = sum(len(chat.format_turn(r[2], r[3])[0]) for r in turns)
        assert tuple(got[conv])[1:] == (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(learned),
                                        sha(learned), size)
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0


# ---------------------------------------------------------------- vector codes
def brute_codes(rows, parts, entries, rounds, width, limit):
    kept = [(i, v, la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = []
    for i, v, la in kept:
        able = all(abs(x * 4096) < limit - 1 for x in v)
        ints.append([math.floor(x * 4096) for x in v] + [0] * (width - len(v)) if able else None)
    size = width // parts
    order = sorted((k for k in range(len(kept)) if ints[k] is not None),
                   key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))
    books = [[ints[k][p * size : (p + 1) * size] for k in order[:entries]] for p in range(parts)]

    def nearest(p, point):
        found = [sum((a - b) ** 2 for a, b in zip(point, e)) for e in books[p]]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for k in order:
                point = ints[k][p * size : (p + 1) * size]
                own[nearest(p, point)[0]].append(point)
            new.append([[sum(c) // len(own[e]) for c in zip(*own[e])] if own[e] else book for e, book in enumerate(books[p])])
        books = new
    codes, errors, labels = [], [], Counter()
    for k, (i, v, la) in enumerate(kept):
        found = [nearest(p, ints[k][p * size : (p + 1) * size]) for p in range(parts)] if ints[k] is not None else None
        codes.append("".join(f"{e:02x}" for e, _ in found) if found else None)
        errors.append(sum(d for _, d in found) if found else None)
        labels[la] += errors[-1] or 0
    return Counter((kept[k][0], codes[k], errors[k], labels[kept[k][2]]) for k in range(len(kept))), books


def test_vector_codes(spark):
    rng = np.random.RandomState(6)
    rows = [(i, (rng.randn(24) * 0.3).tolist(), int(rng.choice([1, 2, 2, 2]))) for i in range(3, 700)]
    hot = (rng.randn(24) * 0.3).tolist()
    rows += [(1000 + i, hot, None) for i in range(400)]  # one vector has a third of the rows
    rows += [(0, rows[0][1], 5), (0, rows[0][1], 5), (None, rows[1][1], None), (1, None, 1), (2, [float("nan")] * 24, 1),
             (2000, [1.0] * 23 + [None], 1), (2001, [float("-inf")] + [0.0] * 23, 1), (2002, [0.5, -0.5], 2), (2003, [], 2),
             (2004, [1e9] * 24, 2), (2005, [-3.0] * 24, 3), (2006, [1 / 4096, -1 / 4096, 1e-9, -1e-9] * 6, 3)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "vec_id long, embedding array<double>, label int, code string, part int").repartition(5)
    limit = math.isqrt((2**63 - 1) // 24) // 2
    for parts, rounds in ((8, 6), (3, 2)):
        codes, books = vector_codes.vector_codes(frame, parts=parts, rounds=rounds)
        want, brute = brute_codes(rows, parts, 16, rounds, 24, limit)
        assert [b.tolist() for b in books] == brute
        assert Counter(map(tuple, codes.collect())) == want
        flat = ",".join(str(v) for b in brute for e in b for v in e)
        assert vector_codes.books_digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_codes_of_few_vectors_and_of_none(spark):
    schema = "vec_id long, embedding array<float>, label string"
    codes, books = vector_codes.vector_codes(spark.createDataFrame([], schema))
    assert codes.count() == 0 and vector_codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
    codes, _ = vector_codes.vector_codes(spark.createDataFrame([(4, [1.0] * 8, "a"), (5, [1.0] * 8, "a")], schema))
    assert sorted(map(tuple, codes.collect())) == [(4, "00" * 8, 0, 0), (5, "00" * 8, 0, 0)]


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (1, 5)])
def test_hilbert_neighbours_are_adjacent(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = vector_codes.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.RandomState(3)
    entries = rng.randint(-50, 50, (16, 4))
    for _ in range(200):
        points = rng.randint(-50, 50, (1, 4)) + rng.randint(-6, 7, (20, 4))
        able = vector_codes._shortlists(points.min(0)[None], points.max(0)[None], entries)[0]
        nearest = ((points[:, None] - entries) ** 2).sum(2).argmin(1)
        assert able[nearest].all()
        at, error = vector_codes._nearest(points, entries, np.flatnonzero(able))
        assert (at == nearest).all() and (error == ((points - entries[nearest]) ** 2).sum(1)).all()
