"""Language of documents and of their spans: scripts, per-word scores and Viterbi."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_groups

GRAMS = 1 << 16  # byte trigrams are hashed to so many counts per language
SWITCH = 6.0  # log-odds a change of language must bring
CLIP = 8.0  # most that one word weighs for a language against another
FOREIGN = 30.0  # taken from languages that the word's script rules out
SCRIPT_SHARE = 0.01  # least share of a language's letters in a script that it uses

# lead bytes of UTF-8 by script: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai and
# other South-East Asian, Georgian and others, kana and CJK, Hangul, beyond the basic plane
SCRIPT_RANGES = ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCD), (0xCE, 0xCF), (0xD0, 0xD4), (0xD5, 0xD6),
                 (0xD7, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE1), (0xE3, 0xE9), (0xEA, 0xED),
                 (0xF0, 0xF4))
SCRIPT_NUMBERS = (1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
SCRIPTS = 12

_SCRIPT = np.zeros(256, np.uint8)
for (_low, _high), _number in zip(SCRIPT_RANGES, SCRIPT_NUMBERS):
    _SCRIPT[_low : _high + 1] = _number
_LETTERS = np.arange(256, dtype=np.uint8)  # ASCII other than letters becomes a space
_LETTERS[[b for b in range(128) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 32
_LETTERS[0x41:0x5B] += 32


def _bytes(texts):
    """All texts as one byte array of lower-case letters and spaces, and each text's end."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return _LETTERS[np.frombuffer(b"".join(raw), np.uint8)], ends


def _grams(data):
    """Bucket of the trigram that begins at each byte."""
    a = data.astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _count(batches):
    """Counts of trigrams and of scripts per language, over the texts of a partition."""
    grams, scripts = {}, {}

    def add(lang, texts):
        data, _ = _bytes(texts)
        if lang not in grams:
            grams[lang], scripts[lang] = np.zeros(GRAMS, np.int64), np.zeros(SCRIPTS, np.int64)
        got = _grams(data)
        inner = (data[:-2] != 32) | (data[1:-1] != 32)  # not those of spaces only
        grams[lang] += np.bincount(got[inner], minlength=GRAMS)
        scripts[lang] += np.bincount(_SCRIPT[data], minlength=SCRIPTS)

    for batch in batches:
        for part in text_groups(batch, 1, 4_000_000):
            by = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                add(lang, texts)
    for lang in grams:
        for kind, counts in ((0, grams[lang]), (1, scripts[lang])):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array([kind] * len(used), pa.int32()),
                 pa.array(used, pa.int32()), pa.array(counts[used])],
                names=["lang", "kind", "slot", "n"])


def held_out(doc_id="doc_id"):
    """True for the third of ids (crc32 mod 3 is 1) that are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train_languages(docs: DataFrame, doc_id="doc_id", text="text", lang="lang"):
    """A model {langs, table, allowed} from all documents with a language outside the held-out third.

    Counts combine in the map tasks; the driver gets at most 65,548 counts per learned language. The
    table has each trigram's log-probability per language, less its mean over languages.
    """
    known = docs.where(~held_out(doc_id) & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = known.mapInArrow(_count, "lang string, kind int, slot int, n long")
    got = counted.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    grams, scripts = np.zeros((GRAMS, len(langs))), np.zeros((SCRIPTS, len(langs)))
    if got.num_rows:
        place = np.searchsorted(np.asarray(langs, object), np.asarray(got["lang"].to_pylist(), object))
        kind, slot, n = (got[c].to_numpy() for c in ("kind", "slot", "n"))
        grams[slot[kind == 0], place[kind == 0]] = n[kind == 0]
        scripts[slot[kind == 1], place[kind == 1]] = n[kind == 1]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * GRAMS))
    if langs:
        logs -= logs.mean(1, keepdims=True)
    letters = scripts[1:].sum(0)
    allowed = scripts / np.maximum(letters, 1) >= SCRIPT_SHARE
    allowed[~allowed.any(1)] = True  # a script that no language uses rules none out
    allowed[0] = True
    return {"langs": langs, "table": logs.astype(np.float32), "allowed": allowed}


def _words(data):
    """First byte and end of every word of the byte array."""
    letter = data != 32
    edge = np.flatnonzero(np.diff(letter.astype(np.int8)))
    return edge[0::2] + 1, edge[1::2] + 1  # the array begins and ends with spaces


def _paths(scores, counts):
    """The best language of every word: Viterbi with a penalty for a change, all texts in step."""
    order = np.argsort(-counts, kind="stable")
    n = counts[order]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    path = np.zeros(len(scores), np.int16)
    if not len(n) or not n[0]:
        return path
    active = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts longer than t are the first ones
    best = scores[first[: active[0]]].astype(np.float64)
    stays = np.ones(scores.shape, bool)  # else the state comes from the best one before
    top = np.zeros(len(scores), np.int16)  # the best state at each word
    rows = first[: active[0]]
    top[rows] = best.argmax(1)
    last = np.zeros(len(n), np.int16)
    for t in range(1, n[0]):
        k = active[t]
        if k < len(best):
            last[k : len(best)] = best[k:].argmax(1)
            best = best[:k]
        rows = first[:k] + t
        change = best.max(1, keepdims=True) - SWITCH
        keep = best >= change
        stays[rows] = keep
        best = np.where(keep, best, change) + scores[rows]
        best -= best.max(1, keepdims=True)
        top[rows] = best.argmax(1)
    last[: len(best)] = best.argmax(1)
    state = last.copy()
    path[first[: active[0]] + n[: active[0]] - 1] = state[: active[0]]
    for t in range(n[0] - 1, 0, -1):
        k = active[t]
        rows = first[:k] + t
        held = state[:k]
        moved = ~stays[rows, held]
        state[:k] = np.where(moved, top[rows - 1], held)
        path[rows - 1] = state[:k]
    return path


def _label(texts, model):
    """Words of the texts with their languages: (text number, letters, language) arrays."""
    data, ends = _bytes(texts)
    starts, stops = _words(data)
    owner = np.searchsorted(ends, starts, "right")
    if not len(starts) or not model["langs"]:
        return owner, stops - starts, np.zeros(len(starts), np.int16)
    table = model["table"]
    values = np.concatenate([table[_grams(data)], np.zeros((2, table.shape[1]), np.float32)])
    # the trigrams that begin from one byte before a word to two before its end
    bounds = np.stack([starts - 1, np.maximum(stops - 1, starts)], 1).ravel()
    scores = np.add.reduceat(values, bounds)[0::2]
    scores = np.clip(scores - scores.max(1, keepdims=True), -CLIP, 0)
    scores -= FOREIGN * ~model["allowed"][_SCRIPT[data[starts]]]
    return owner, stops - starts, _paths(scores, np.bincount(owner, minlength=len(texts)))


def _has_letter(text):
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def language_rows(docs: DataFrame, model, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of most letters of a document, and their share."""

    def label(batches):
        for batch in batches:
            for part in text_groups(batch, 1, 4_000_000):
                texts = [t or "" for t in part.column(1).to_pylist()]
                owner, letters, path = _label(texts, model)
                mass = np.zeros((len(texts), max(1, len(model["langs"]))))
                np.add.at(mass, (owner, path), letters)
                best, total = mass.argmax(1), mass.sum(1)
                known = [bool(model["langs"]) and _has_letter(t) for t in texts]
                names = [model["langs"][b] if k else "und" for b, k in zip(best, known)]
                share = np.where(known, mass[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")


def language_spans(docs: DataFrame, model, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, span, lang, first_word, words, letters): runs of words in one language, in order."""

    def label(batches):
        for batch in batches:
            for part in text_groups(batch, 1, 4_000_000):
                texts = [t or "" for t in part.column(1).to_pylist()]
                owner, letters, path = _label(texts, model)
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])
                at = np.flatnonzero(new) if model["langs"] else np.zeros(0, int)
                size = np.diff(np.append(at, len(owner)))
                begin = np.searchsorted(owner, owner[at], "left")
                number = np.arange(len(at)) - np.searchsorted(owner[at], owner[at], "left")
                sums = np.add.reduceat(letters, at) if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner[at])), pa.array(number, pa.int32()),
                     pa.array([model["langs"][p] for p in path[at]], pa.string()),
                     pa.array(at - begin, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "span", "lang", "first_word", "words", "letters"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        label, f"doc_id {kind}, span int, lang string, first_word long, words long, letters long")


def predict_languages(docs: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Ranges of scripts narrow the languages of each word, trigram scores weigh them, and Viterbi with a
    switching penalty labels the spans of the whole text; the language of most letters is the
    prediction, the first in order if several tie, and its share of letters the score. Null texts and
    texts without a letter are `und` with score 0, and so is everything if nothing can be learned.
    Repeated rows are judged alike, each for itself. An empty table gives no rows. Columns other than
    id, text and lang are not read; lang and id are no inputs of a prediction.
    """
    model = train_languages(docs, doc_id, text, lang)
    return language_rows(docs, model, doc_id, text).withColumn("held_out", held_out()).select(
        "doc_id", "held_out", "lang_pred", "score")
