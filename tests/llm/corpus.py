"""A small corpus with nulls, empty, blank and very long texts, copies, near copies and ties."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # columns of other tables and of the operators' own results
          "key string, size string, score string, kept string, label string, root string, "
          "component_id string, text_sha256 string, doc string, tie string, c0 string, __score string")
EXTRA = ("k", None, "x", "no", "l", "r", "9", "h", "d", "t", "c", "s")


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(words(60))
    out = [None, None, "", " \t\n", "...", "one", "One", "two words", "Straße Übung É́ 日本語 текст"]
    base = words(120)
    for i in range(14):  # a group of near copies
        own = list(base)
        for _ in range(i % 5):
            own[rng.randrange(120)] = rng.choice(vocabulary)
        out.append(" ".join(own))
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16):  # small sets, each with a near partner
        own = words(n + 4)
        out += [" ".join(own), " ".join(own[:-1] + [rng.choice(vocabulary)]), " ".join(own + ["more"])]
    for _ in range(20):  # passages that many documents share
        out.append(" ".join(words(rng.randint(5, 80))) + "\n" + passage + "\n" + " ".join(words(rng.randint(1, 60))))
    out += [" ".join(words(30)).replace(" ", "  "), " ".join(words(9000)), ("ab " * 3000), "x" * 5000, "é" * 300]
    own = " ".join(words(40))
    out += [own, own.replace(" ", "\n"), own.replace(" ", "\t \n"), own.upper(), own + " "]
    return out


def documents(seed=1):
    rng = random.Random(seed)
    rows = []
    for i, text in enumerate(texts(seed)):
        source = None if i % 11 == 3 else rng.choice(["s1", "s2", "S3", "é", "hot", "hot", "hot"])
        rows.append((i, text, None, source, None, *EXTRA))
    rows.append((len(rows), rows[12][1], "en", "s1", 1, *EXTRA))  # an exact copy
    rows.append(rows[14])  # a row that is repeated
    rows.append(rows[14])
    rows.append((None, rows[16][1], None, None, None, *[None] * len(EXTRA)))  # no id
    rows.append((None, "only here and without an id", None, "s2", None, *[None] * len(EXTRA)))
    return rows


def frame(spark, rows=None, parts=5):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def components(nodes, links):
    """Smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
