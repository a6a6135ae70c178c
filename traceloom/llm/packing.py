"""Best-fit packing of documents into sequences of tokens."""

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_totals
from .common import give_back, materialize, text_groups, word_cache

CAPACITY = 2048
END = 0
CACHED_WORDS = 600_000
CACHED_LENGTH = 48
CLOSING = ".,;:!?*#$%&"  # marks that end a word
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_tokenizer = {}


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _load(path):
    if path not in _tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizer[path] = Tokenizer.from_file(path)
    return _tokenizer[path]


def _encode_words(words, path):
    """The ids of each word, as bytes; words are encoded by the hundreds, as one text with blanks."""
    groups = [words[i : i + 500] for i in range(0, len(words), 500)]
    coded = _load(path).encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
    for group, code in zip(groups, coded):
        ids = np.asarray(code.ids, "<u4")
        begins = np.fromiter((a for a, _ in code.offsets), np.int64, len(ids))
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        cuts = np.searchsorted(begins, ends, "left") * 4
        raw, at = ids.tobytes(), 0
        for word, cut in zip(group, cuts.tolist()):
            yield word, raw[at:cut]
            at = cut


def _core(word):
    """What precedes the closing marks of a word, if the vocabulary parts the two there."""
    core = word.rstrip(CLOSING)
    return core if core and core[-1].lower()[-1].isalpha() else word


def encode_texts(texts, path):
    """Token ids of each whole text as little-endian 32-bit numbers, without the end mark.

    The vocabulary ignores case, drops blanks and never joins what they part, so a text's ids are
    those of its words in a row; words seen before are looked up. The cache is emptied when full.
    """
    cache = word_cache(f"ids of {path}")
    split = [text.encode().lower().decode().replace("\n", " ").split(" ") for text in texts]
    new = {w for words in split for w in words if w not in cache}
    if len(cache) + 2 * len(new) > CACHED_WORDS:
        cache.clear()
        new = {w for words in split for w in words}
    cores = {w: _core(w) for w in new}
    needed = {*cores.values(), *(w[len(c):] for w, c in cores.items())}
    cache.update(_encode_words([w for w in needed if w not in cache], path))
    for word, core in cores.items():
        if core is not word:
            cache[word] = cache[core] + cache[word[len(core):]]
    coded = [b"".join(map(cache.__getitem__, words)) for words in split]
    for word in {*new, *needed}:
        if len(word) > CACHED_LENGTH:
            del cache[word]
    return coded


def _pieces(path, capacity):
    end = np.asarray([END], "<u4").tobytes()
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def cut(batches):
        for part in (g for batch in give_back(batches, 400_000) for g in text_groups(batch, 1)):
            out = [[], [], [], [], []]
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc, coded in zip(part.column(0).to_pylist(), encode_texts(texts, path)):
                ids = coded + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, piece, start, len(own) // 4, zlib.crc32(own))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit_moves(counts: dict, capacity=CAPACITY) -> list:
    """Moves (length, first rank, end rank, first sequence, per sequence, offset) for counts by length.

    Bulk-synchronous best-fit decreasing over classes. Documents of one length are interchangeable,
    and so are gaps of one size, so the state is two sorted tables of at most `capacity` counts,
    whatever the corpus. A superstep takes the longest length left, sweeps to its successor, the
    smallest gap that holds it, and hands out that class's gaps by rank of document; documents
    beyond the last rank go on to the next larger gap, and to new sequences when none is left. Then
    gaps are updated. A gap takes as many documents of the length as fit, which is what best fit one
    document at a time does.
    """
    gaps = [[] for _ in range(capacity + 1)]  # ranges (first sequence, number) by size of gap
    opened, moves = 0, []
    for length in sorted(counts, reverse=True):
        rank, left, size = 0, counts[length], length
        while left:
            while size <= capacity and not gaps[size]:
                size += 1
            fresh = size > capacity
            gap = capacity if fresh else size
            fits = gap // length
            if fresh:
                first, number = opened, -(-left // fits)
                opened += number
            else:
                first, number = gaps[size].pop()
            full = min(number, left // fits)
            if full:
                moves.append((length, rank, rank + full * fits, first, fits, capacity - gap))
                if gap - fits * length:
                    gaps[gap - fits * length].append((first, full))
                rank, left = rank + full * fits, left - full * fits
            rest = left if full < number and left < fits else 0
            if rest:
                moves.append((length, rank, rank + rest, first + full, rest, capacity - gap))
                gaps[gap - rest * length].append((first + full, 1))
                rank, left, full = rank + rest, 0, full + 1
            if full < number:
                gaps[gap].append((first + full, number - full))
    return moves


def token_pieces(docs: DataFrame, vocabulary=None, capacity=CAPACITY, doc_id="doc_id", text="text"):
    """(doc_id, piece, start, length, ids_crc32) of every document, tokenised whole."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity), PIECES)


def pack_documents(docs: DataFrame, vocabulary=None, capacity=CAPACITY, doc_id="doc_id", text="text"):
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and an end mark; null or empty text is the mark alone. Only documents
    longer than `capacity` are cut. Rows that repeat an id are packed each for itself. Null ids stay
    null. Other columns are not read. An empty table gives no rows.

    The driver sees one count per length (at most `capacity`), never a document. Ranks within a
    length are counted per slice of hashed ids, so a length that a third of the pieces share is not
    sorted in one task.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity, doc_id, text))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slices = max(64, sum(counts.values()) // 200_000)
    spark = docs.sparkSession
    moves = spark.createDataFrame(
        best_fit_moves(counts, capacity),
        "m_length long, first long, last long, sequence long, fits long, place long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices))
    ranked = running_totals(
        pieces, ["length"], ["doc_id", "piece", "ids_crc32"], bucket, {"rank": F.lit(1)})
    rank = F.col("rank") - 1
    placed = ranked.join(
        moves, (F.col("length") == F.col("m_length")) & (rank >= F.col("first")) & (rank < F.col("last")))
    inside = rank - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(inside / F.col("fits"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(inside, F.col("fits")) * F.col("length")).cast("long").alias("offset"))
