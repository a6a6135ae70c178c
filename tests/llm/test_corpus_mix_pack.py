"""Mixing, packing and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from traceloom.llm import mixing, packing


def brute_targets(sizes):
    """Water filling, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        for s in full or list(open_):
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= target[s]
            open_.discard(s)
        if not full:
            break
    return target


def test_targets(spark):
    rng = random.Random(2)
    for case in range(3):
        sizes = {s: rng.choice([0, 1, 10, 1000, 5]) for s in ["a", "b", None, "Z", "é", "zz", "ab"][: 3 + 2 * case]}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s]) for s in want), sizes


def test_mix(spark):
    rng = random.Random(5)
    rows = corpus.documents()
    for i in range(3000):
        rows.append((1000 + i, "w " * rng.choice([1, 3, 10, 40, 200]), None, rng.choice(["s1", "hot", "hot", "hot", None, "S3"]),
                     None, *corpus.EXTRA))
    frame = corpus.frame(spark, rows)
    got = mixing.mix_rows(frame).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    size = {r[0]: len(corpus.words_of(r[1])) for r in rows if r[0] is not None}
    source = {r[0]: r[3] for r in rows}
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += len(corpus.words_of(r[1]))
    target, taken = brute_targets(dict(sums)), defaultdict(int)
    for g in got:
        if g.doc_id is not None:
            assert g.size == size[g.doc_id] and g.source_size == sums[source[g.doc_id]]
            assert g.target == pytest.approx(target[source[g.doc_id]])
        assert 0 <= g.taken <= 2 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[round(g.target, 6)] += g.taken
    for t, n in taken.items():
        assert abs(n - t) <= max(0.02 * t, 12)
    again = mixing.mix_rows(frame.repartition(3)).select(*got[0].__fields__).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[g.doc_id] * g.size == g.taken for g in got
               if g.doc_id not in (None, 14) and g.size)


def test_pareto_sampling_meets_odds(spark):
    """Short documents are drawn more often, as the odds say, and every document can be drawn."""
    rows = [(i, "w " * (2 if i % 2 else 50), "a" if i < 4000 else "b") for i in range(4400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_rows(frame, weights=(1, 1), share=0.5).collect()
    part = {k: np.mean([g.copies > 0 for g in got if g.doc_id < 4000 and g.doc_id % 2 == k]) for k in (0, 1)}
    assert 0.3 < part[0] < part[1] < 1


def test_mix_of_nothing(spark):
    assert mixing.mix_rows(corpus.frame(spark, [])).count() == 0
    blank = [(i, None, None, "s", None, *corpus.EXTRA) for i in range(3)]
    assert {g.taken for g in mixing.mix_rows(corpus.frame(spark, blank)).collect()} == {0}


def check_packing(got, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for doc, text in texts:
        ids = np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = defaultdict(list)
    for g in got:
        places[g.sequence_id].append((g.offset, g.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(k[3] * n for k, n in want.items())


def best_fit(lengths, capacity):
    """Best-fit decreasing, one document at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing(spark):
    rows = corpus.documents()
    for capacity in (2048, 64):
        got = packing.pack_documents(corpus.frame(spark), capacity=capacity).collect()
        used, total = check_packing(got, [r[:2] for r in rows], capacity)
        assert used == best_fit([g.length for g in got], capacity)
        assert used <= total / capacity * 1.2 + 1
    assert packing.pack_documents(corpus.frame(spark, [])).count() == 0


@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
@settings(max_examples=200, deadline=None)
def test_moves_are_best_fit(lengths, capacity):
    moves = packing.best_fit_moves(Counter(lengths), capacity)
    places = defaultdict(list)
    for length, first, last, sequence, fits, place in moves:
        for rank in range(first, last):
            inside = rank - first
            places[sequence + inside // fits].append((place + inside % fits * length, length))
    assert Counter(n for own in places.values() for _, n in own) == Counter(lengths)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(places) == best_fit(lengths, capacity)


@given(st.lists(st.text(alphabet="aAbz'sdİΣς É1½二́\n\t !?.,*&<|>", max_size=24), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_are_encoded_as_in_whole_texts(texts):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tokenizer = packing._tokenizer.setdefault(path, Tokenizer.from_file(path))
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.encode_texts(texts, path) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = corpus.documents()
    good = [" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(40)) for _ in range(60)]
    for i, text in enumerate(good):
        rows.append((500 + i, text, "en", rng.choice(["s1", "hot"]), 1, *corpus.EXTRA))
        rows.append((700 + i, text.upper() + "!!", "en", "s1", 1, *corpus.EXTRA))
    labels = [(500 + i, 1, 0) for i in range(60)] + [(700 + i, 0, 0) for i in range(60)]
    labels += [(i, 1, 0) for i in range(60)]
    corpus.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    accepted, single, apart, mixed = kept
    ids = [Counter(r.doc_id for r in k) for k in kept]
    assert sum(500 <= d < 560 for d in ids[0] if d) >= 50 and not any(700 <= d < 760 for d in ids[0] if d)
    normal = lambda t: "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or ""))
    squeeze = lambda t: " ".join(p for p in normal(t).split(" "))
    import re

    texts = [re.sub(" +", " ", squeeze(r.text)) for r in single]
    assert len(texts) == len(set(texts)) and set(texts) == {re.sub(" +", " ", squeeze(r.text)) for r in accepted}
    from test_corpus_dedup import brute_groups, brute_sets, key

    groups, _ = brute_groups(brute_sets([(r.doc_id, r.text) for r in single]))
    assert {key(d) for d in ids[2]} == {k[0] for k, v in groups.items() if v == k[0]}
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 2
    words = sum(len(corpus.words_of(r.text)) for r in apart)
    assert sum(len(corpus.words_of(r.text)) for r in mixed) == pytest.approx(1.5 * words, rel=0.1)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(got, [(r.doc_id, r.text) for r in mixed], 2048)


def test_pipeline_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    corpus.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
