"""Long repeated substrings across documents, found with a logarithmic family of suffix arrays."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import Hashes, mix

LENGTH = 100  # bytes of a string that must have occurred before
GRAM = 36  # bytes by which a string's anchor is chosen
SEGMENT = 1 << 20  # string starts that are hashed at a time
ENTRIES = 1_000_000  # entries of a bucket, on average
COMBINED = 2_000_000  # entries a map task holds before it sends them on
BATCH = 1 << 16  # entries of a batch of the index family
LAST_ID = (1 << 63) - 1  # null ids sort last

def _window_minima(values, width):
    """Minimum of each run of `width` values, from running minima of blocks in both directions."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _segments(texts):
    """(text number, offset, bytes): pieces of texts whose starts cover every string once."""
    held, out = 0, []
    for number, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
            piece = raw[at : at + SEGMENT + LENGTH - 1]
            out.append((number, at, piece))
            held += len(piece)
            if held >= SEGMENT:
                yield out
                held, out = 0, []
    if out:
        yield out


def anchors(pieces):
    """Runs of strings that share an anchor: (piece, gram hash, run hash, place, least, most offset).

    The anchor of a string of `LENGTH` bytes is its gram of `GRAM` bytes with the smallest hash, the
    first of equals. It hangs on the string alone, so equal strings have it at the same offset. Some 3
    of 100 positions are anchors; the suffixes at them are the entries of the index.
    """
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    begins = ends - [len(p[2]) for p in pieces]
    hashes = Hashes(data)
    grams = hashes.all(GRAM)
    low = np.uint64((1 << 22) - 1)
    least = _window_minima((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside))
    at = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
    near, far = at - last, at - first
    run = hashes.of(first, last + LENGTH)
    run = mix(run + (near * 257 + far + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    piece = np.searchsorted(ends, at, "right")
    place = at - begins[piece] + np.asarray([p[1] for p in pieces])[piece]
    return piece, grams[at], run, place, near, far


ENTRY = np.dtype([("gram", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("place", "<u4"),
                  ("near", "u1"), ("far", "u1")])
LOW = np.uint64((1 << 48) - 1)  # gram and run are shipped with 48 bits each


def _ordered(entries):
    """Entries in the order of the corpus: smaller id, then earlier place; each run once.

    Repeated rows bring a run again. An anchor has two runs where a segment ends among its strings.
    """
    entries = entries[np.lexsort([entries[c] for c in ("far", "near", "place", "tie", "doc")])]
    new = np.zeros(len(entries), bool)
    new[:1] = True
    for name in ENTRY.names[2:]:
        new[1:] |= entries[name][1:] != entries[name][:-1]
    return entries[new]


def _suffix_array(entries):
    """Entries sorted by gram, then run; equal ones keep the order of the corpus."""
    return entries[np.lexsort((entries["run"], entries["gram"]))]


def _again(array):
    """True for every entry of a suffix array whose gram and run stand before it."""
    out = np.zeros(len(array), bool)
    out[1:] = (array["gram"][1:] == array["gram"][:-1]) & (array["run"][1:] == array["run"][:-1])
    return out


def _keys(array):
    return mix(array["gram"] * np.uint64(0x9E3779B97F4A7C15) + array["run"])


class IndexFamily:
    """A logarithmic family of suffix arrays over entries that come in the order of the corpus.

    `add` sorts a batch into an array of its own, scans it against itself and against every level,
    and puts what is new in as the lowest level. While the two lowest levels hold the same number of
    batches they merge, so b batches make at most log2(b) + 1 levels. The order within an array is
    that of hashes of the suffix's first bytes, not alphabetical: only equality over whole strings
    matters here, and equal strings stand side by side either way.
    """

    def __init__(self):
        self.levels = []  # (number of batches, array, sorted keys), largest first

    def add(self, entries):
        """The entries all of whose strings came before."""
        array = _suffix_array(entries)
        keys = _keys(array)
        old = _again(array)
        for _, _, known in self.levels:
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            old |= known[at] == keys if len(known) else False
        self.levels.append((1, array[~old], np.sort(keys[~old])))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (_, late, b), (n, early, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, _suffix_array(np.concatenate([early, late])),
                                np.sort(np.concatenate([a, b]), kind="stable")))
        return array[old]

    def differing(self):
        """Entries of every gram of which the family holds several runs."""
        every = _suffix_array(np.concatenate([level for _, level, _ in self.levels]))
        same = every["gram"][1:] == every["gram"][:-1]
        out = np.zeros(len(every), bool)
        out[1:] |= same
        out[:-1] |= same
        return every[out]


def _six(values):
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raws):
    raw = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


PACKED = ("bucket int, fresh boolean, gram binary, run binary, doc binary, tie binary, place binary, "
          "near binary, far binary")


def _pack(entries, buckets):
    """Packed rows per bucket; repeats within what the task holds go along as mere places."""
    array = _suffix_array(_ordered(entries))
    old = _again(array)
    home = (((array["gram"] & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    columns = [[] for _ in range(9)]
    for fresh, own in ((True, np.flatnonzero(~old)), (False, np.flatnonzero(old))):
        own = own[np.lexsort((array["place"][own], array["tie"][own], array["doc"][own], home[own]))]
        cuts = np.flatnonzero(np.diff(home[own], prepend=-1))
        for a, z in zip(cuts, np.append(cuts[1:], len(own))):
            part = array[own[a:z]]
            values = (int(home[own[a]]), fresh, _six(part["gram"]) if fresh else b"",
                      _six(part["run"]) if fresh else b"", *(part[c].tobytes() for c in ENTRY.names[2:]))
            for column, value in zip(columns, values):
                column.append(value)
    types = [pa.int32(), pa.bool_()] + [pa.binary()] * 7
    names = ["bucket", "fresh", *ENTRY.names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _deal(buckets):
    def rows(batches):
        held, n = [], 0
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for pieces in _segments(t.as_py() or "" for t in batch.column(2)):
                piece, gram, run, place, near, far = anchors(pieces)
                owner = np.asarray([p[0] for p in pieces])[piece]
                entries = np.empty(len(piece), ENTRY)
                entries["gram"], entries["run"] = gram & LOW, run & LOW
                entries["doc"], entries["tie"], entries["place"] = ids[owner], ties[owner], place
                entries["near"], entries["far"] = near, far
                held.append(entries)
                n += len(entries)
                if n >= COMBINED:
                    yield _pack(np.concatenate(held), buckets)
                    held, n = [], 0
        if n:
            yield _pack(np.concatenate(held), buckets)

    return rows


FOUND = "doc long, tie long, bucket int, repeat boolean, first long, last long"


def _places(entries, bucket, repeat):
    place = entries["place"].astype(np.int64)
    return pa.table({
        "doc": entries["doc"], "tie": entries["tie"].astype(np.int64),
        "bucket": np.full(len(place), bucket, np.int32), "repeat": np.full(len(place), repeat),
        "first": place - entries["far"], "last": place - entries["near"]})


def _scan(table):
    """Repeats of a bucket, found by its index family, and the runs that differ under one gram."""
    bucket = table["bucket"][0].as_py()

    def unpack(rows, fresh):
        places = np.frombuffer(b"".join(rows["place"].to_pylist()), "<u4")
        out = np.zeros(len(places), ENTRY)
        for name in ("gram", "run") if fresh else ():
            out[name] = _from_six(rows[name].to_pylist())
        for name in ENTRY.names[2:]:
            out[name] = np.frombuffer(b"".join(rows[name].to_pylist()), ENTRY[name])
        return out

    new = _ordered(unpack(table.filter(table["fresh"]), True))
    old = unpack(table.filter(pc.invert(table["fresh"])), False)
    family, repeats = IndexFamily(), [old]
    for at in range(0, len(new), BATCH):
        repeats.append(family.add(new[at : at + BATCH]))
    out = [_places(np.concatenate(repeats), bucket, True)]
    if family.levels:
        out.append(_places(family.differing(), bucket, False))
    return pa.concat_tables(out)


STRINGS = "bucket int, gram binary, hash binary, doc binary, tie binary, first binary, count binary"


def _hash_strings(batches):
    """The gram hash of the runs asked for and the hashes of their strings, all of 64 bits, per bucket."""
    low = np.uint64((1 << 22) - 1)
    for batch in batches:
        rows = {}
        for doc, tie, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = Hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
            for run in asked:
                at = np.arange(run["first"], run["last"] + 1)
                grams = np.arange(run["first"], run["first"] + LENGTH - GRAM + 1)
                grams = hashes.of(grams, grams + GRAM)
                rows.setdefault(run["bucket"], []).append((
                    grams[np.argmin(grams & ~low)], hashes.of(at, at + LENGTH).tobytes(),
                    doc, tie, run["first"], len(at)))
        if rows:
            columns = [[], [], [], [], [], [], []]
            for bucket, runs in rows.items():
                parts = list(zip(*runs))
                values = (bucket, np.asarray(parts[0], "<u8").tobytes(), b"".join(parts[1]),
                          np.asarray(parts[2], "<i8").tobytes(), np.asarray(parts[3], "<u4").tobytes(),
                          np.asarray(parts[4], "<u4").tobytes(), np.asarray(parts[5], "u1").tobytes())
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                names=["bucket", "gram", "hash", "doc", "tie", "first", "count"])


def _repeated_strings(table):
    """Runs of strings that another one, earlier in the corpus, equals: one of the same gram and hash."""
    get = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    count = get("count", "u1").astype(np.int64)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, tie = np.repeat(get("doc", "<i8"), count), np.repeat(get("tie", "<u4"), count)
    place = np.repeat(get("first", "<u4"), count).astype(np.int64) + step
    grams, hashes = np.repeat(get("gram", "<u8"), count), get("hash", "<u8")
    order = np.lexsort((place, tie, doc, hashes, grams))
    later = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    one = (doc[a] == doc[b]) & (tie[a] == tie[b]) & (place[a] == place[b])  # of rows that are repeated
    later[1:] = (hashes[a] == hashes[b]) & (grams[a] == grams[b]) & ~one
    own = order[later]
    own = own[np.lexsort((place[own], tie[own], doc[own]))]
    doc, tie, place = doc[own], tie[own], place[own]
    new = np.ones(len(own), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own))[: len(first)] - 1
    return pa.table({"doc": doc[first], "tie": tie[first].astype(np.int64),
                     "first": place[first], "last": place[last]})


def _cut(raw, runs):
    """(removed spans, bytes that stay) for runs of repeated strings of one text."""
    spans = []
    for first, last in sorted((r["first"], r["last"]) for r in runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + LENGTH)
        else:
            spans.append([first, last + LENGTH])
    stays, at = [], 0
    for a, z in spans:
        stays.append(raw[at:a])
        at = z
    return spans, b"".join(stays) + raw[at:]


def _digests(batches):
    for batch in batches:
        out = [[], [], [], [], []]
        for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            spans, stays = _cut(raw, runs.as_py() or [])
            values = (doc, len(raw), len(raw) - len(stays), len(spans), hashlib.sha256(stays).hexdigest())
            for column, value in zip(out, values):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs, doc_id, text):
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tie"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))


def repeated_runs(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc, tie, first, last): runs of starts of `LENGTH`-byte strings that also start earlier.

    Every string has an anchor; strings with the same anchor are a run. Entries, one per run, go to a
    bucket by the gram at their anchor, and each bucket feeds its own index family, batch by batch in
    the order of the corpus. A run that stands in the index is repeated as a whole. Only runs that
    differ from another one under the same gram, at the edges of long matches, are looked at string
    by string. Repeats within a map task are found there, so a passage of very many documents reaches
    its bucket once per task.
    """
    keyed = _keyed(docs, doc_id, text)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(size * 2 / (LENGTH - GRAM + 2) / ENTRIES) + 1)
    dealt = keyed.select("doc", "tie", "text").mapInArrow(_deal(buckets), PACKED)
    found = materialize(dealt.groupBy("bucket").applyInArrow(_scan, FOUND))
    asked = found.where("not repeat").groupBy("doc", "tie").agg(
        F.collect_list(F.struct("bucket", "first", "last")).alias("asked"))
    strings = keyed.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(
        _hash_strings, STRINGS)
    edges = strings.groupBy("bucket").applyInArrow(
        _repeated_strings, "doc long, tie long, first long, last long")
    return found.where("repeat").select("doc", "tie", "first", "last").unionByName(edges)


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte of a `LENGTH`-byte string that also starts earlier (smaller doc_id, or same document,
    earlier start) is removed; strings are those of the input, whole texts as UTF-8, and never cross
    documents. Null text is empty. Null ids sort last. Documents that share an id but not a text are
    ordered by a hash of the text; rows that repeat an id and a text are one document and get the same
    row each. An empty table gives no rows. Other columns are not read. Bytes are not
    compared: a run is taken for repeated if its gram's and its own hash, 48 bits each, agree, and a
    string at the edge of a match if its gram's and its own hash, 64 bits each, do.
    """
    runs = materialize(repeated_runs(docs, doc_id, text))
    per = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return _keyed(docs, doc_id, text).join(per, ["doc", "tie"], "left").select(
        "doc_id", "text", "runs").mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
