"""A quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, numbered, text_groups, word_cache

BUCKETS = 1 << 14  # words are hashed to so many vectors: 16,384 x 48, whatever the corpus
DIMS = 48
NONZERO = 4  # non-zero entries, +1 or -1, of a word's index vector
WINDOW = 2
LABELLED_ROWS = 20_000  # most labelled rows the network is fitted on, chosen by hash of the id
HIDDEN = 32
EPOCHS = 40
STEPS = 2_000  # least steps of the fit, so that few labels are gone through more often
ACCEPT = 0.7
RARE = 1e-3  # weight of a word of frequency p is RARE / (RARE + p)
CACHED_WORDS = 400_000
REPEAT = 0  # stands for a word that is the word before it once more
GAP = BUCKETS  # between documents: the window does not reach over it


def _bucket(unit):
    return zlib.crc32(unit.encode("utf-8", "surrogatepass")) % BUCKETS


def _units(word):
    """Buckets of a word: its lower-case core, then its closing marks, capitals and digits if any."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = word[len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):]
    out = []
    if core:
        if any(map(str.isdigit, core)):
            out.append(_bucket("\x03"))
            core = "".join("0" if c.isdigit() else c for c in core)
        if len(core) > 1 and core.isupper():
            out.append(_bucket("\x02"))
        out.append(_bucket(core.lower()))
    if tail:
        out.append(_bucket("\x01" + tail))
    return np.asarray(out, "<u2").tobytes()


def word_units(texts):
    """The unit buckets of each whole text; words seen before are looked up in a bounded cache."""
    cache = word_cache("units")
    split = [text.split() for text in texts]
    new = {w for words in split for w in words if w not in cache}
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = {w for words in split for w in words}
    cache.update((w, _units(w)) for w in new)
    out = [np.frombuffer(bytearray().join(map(cache.__getitem__, words)), "<u2") for words in split]
    for units in out:
        units[1:][units[1:] == units[:-1]] = REPEAT
    for word in new:
        if len(word) > 64:
            del cache[word]
    return out


def tokenised(docs: DataFrame, text="text", keep=True):
    """`docs` under the names c0, c1, ..., with the unit buckets of every whole text, written once.

    Units are 16-bit numbers in a binary column `units`: all later passes read them in place of the
    text. Without `keep` the text itself is left out.
    """
    plain, names = numbered(docs)
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep or i != at]
    schema = ", ".join(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in kept) + ", units binary"

    def units(batches):
        for batch in give_back(batches):
            for part in text_groups(batch, at):
                found = word_units([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in kept], pa.array([u.tobytes() for u in found], pa.binary())],
                    names=[*[f"c{i}" for i in kept], "units"])

    return materialize(plain.mapInArrow(units, schema)), names


def _streams(column):
    return [np.frombuffer(u, "<u2") for u in column.to_pylist()]


def _index_vectors():
    """Places and signs of the non-zero entries of every word's sparse ternary index vector."""
    random = np.random.RandomState(17)
    places = random.rand(BUCKETS, DIMS).argpartition(NONZERO, axis=1)[:, :NONZERO]
    return places, random.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _context_sums(batches):
    """Each word's sum of the index vectors of its neighbours, over the texts of a partition."""
    places, signs = _index_vectors()
    sums, seen, held, n = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64), [], 0

    def add():
        stream = np.concatenate(held).astype(np.int64)
        seen[:] += np.bincount(stream[stream != GAP], minlength=BUCKETS)
        for step in range(1, WINDOW + 1):
            left, right = stream[:-step], stream[step:]
            ok = (left != GAP) & (right != GAP)
            left, right = left[ok], right[ok]
            for word, near in ((left, right), (right, left)):
                for j in range(NONZERO):
                    sums[:] += np.bincount(word * DIMS + places[near, j], signs[near, j], BUCKETS * DIMS)

    for batch in give_back(batches):
        for units in _streams(batch.column(0)):
            held += [units, np.full(WINDOW, GAP, "<u2")]
            n += len(units)
            if n > 400_000:
                add()
                held, n = [], 0
    if held:
        add()
    used = np.flatnonzero(seen)
    table = sums.reshape(BUCKETS, DIMS)[used]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(seen[used])] + [pa.array(table[:, d]) for d in range(DIMS)],
        names=["bucket", "n"] + [f"d{d}" for d in range(DIMS)])


def word_vectors(tokens: DataFrame):
    """(vectors, weights) of every bucket, gathered from the units of all documents.

    Sums combine in the map tasks; the driver gets at most `BUCKETS` rows whatever the corpus.
    """
    dims = [f"d{d}" for d in range(DIMS)]
    schema = "bucket int, n long, " + ", ".join(f"{d} double" for d in dims)
    sums = tokens.select("units").mapInArrow(_context_sums, schema).groupBy("bucket").agg(
        F.sum("n").alias("n"), *[F.sum(d).alias(d) for d in dims]).toArrow()
    vectors, counts = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    if sums.num_rows:
        at = sums["bucket"].to_numpy()
        counts[at] = sums["n"].to_numpy()
        vectors[at] = np.stack([sums[d].to_numpy() for d in dims], 1)
    total = max(counts.sum(), 1.0)
    vectors -= np.outer(counts, vectors.sum(0) / total)  # less what every word sees
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32), (RARE / (RARE + counts / total)).astype(np.float32)


def _pooled(units, vectors, weights):
    """Per document: weighted and plain mean of its word vectors, and log of its length."""
    sizes = np.asarray([len(u) for u in units], np.int64)
    out = np.zeros((len(units), 2 * DIMS + 1), np.float32)
    out[:, -1] = np.log1p(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        stream = np.concatenate([units[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        plain, w = vectors[stream], weights[stream]
        out[full, :DIMS] = np.add.reduceat(plain * w[:, None], starts) / np.maximum(
            np.add.reduceat(w, starts), 1e-6)[:, None]
        out[full, DIMS:-1] = np.add.reduceat(plain, starts) / sizes[full, None]
    return out


def fit_network(x, y, hidden=HIDDEN, epochs=EPOCHS, seed=3):
    """Weights of a two-layer network and the temperature that calibrates it on a held-back tenth."""
    random = np.random.RandomState(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-4
    x = (x - mean) / scale
    own = np.arange(len(x)) % 10 != 0 if len(x) >= 20 else np.ones(len(x), bool)
    a, b = random.randn(x.shape[1], hidden) / np.sqrt(x.shape[1]), np.zeros(hidden)
    c, d = random.randn(hidden) / np.sqrt(hidden), np.zeros(1)
    params = [a, b, c, d]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rows, step = np.flatnonzero(own), 0
    for _ in range(max(epochs, STEPS // -(-len(rows) // 256))):
        random.shuffle(rows)
        for i in range(0, len(rows), 256):
            xs, ys = x[rows[i : i + 256]], y[rows[i : i + 256]]
            hid = np.tanh(xs @ a + b)
            err = (1 / (1 + np.exp(-np.clip(hid @ c + d, -30, 30))) - ys) / len(xs)
            back = np.outer(err, c) * (1 - hid**2)
            grads = [xs.T @ back + 1e-4 * a, back.sum(0), hid.T @ err + 1e-4 * c, err.sum(keepdims=True)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    held = ~own if (~own).any() else own
    logits, truth = np.tanh(x[held] @ a + b) @ c + d, y[held]
    loss = lambda t: np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t).mean()
    temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return {"mean": mean, "scale": scale, "a": a, "b": b, "c": c, "d": d, "t": float(temperature)}


def network_scores(x, net):
    logits = np.tanh(((x - net["mean"]) / net["scale"]) @ net["a"] + net["b"]) @ net["c"] + net["d"]
    return 1 / (1 + np.exp(-np.clip(logits / net["t"], -30, 30)))


def held_out(doc_id="doc_id"):
    """True for the quarter of ids (crc32 mod 4 is 2) whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _parts(units, size=60_000):
    """Slices of a list of streams that hold about so many units, a longer stream by itself."""
    at, held = 0, 0
    for i, own in enumerate(units):
        if held and held + len(own) > size:
            yield slice(at, i)
            at, held = i, 0
        held += len(own)
    yield slice(at, len(units))


def train_quality(tokens: DataFrame, labels: DataFrame, doc_id, rows=LABELLED_ROWS):
    """A model {vectors, weights, net or rate} from `tokenised` documents, whose id is column `doc_id`.

    Word vectors come from all documents. The network is fitted on at most `rows` labelled documents
    outside the held-out quarter, the smallest by hash of the id. Labels that are null, or of
    documents that are not there, are not used. With one label or none every score is the share of
    label 1 (0.5 without labels).
    """
    vectors, weights = word_vectors(tokens)
    own = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    sample = own.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("l_id"), "l_id", "label").limit(rows)
    # at most `rows` ids and labels: small enough to broadcast at any size of the corpus
    picked = tokens.select(F.col(doc_id).alias("l_id"), "units").join(F.broadcast(sample), "l_id")

    def pool(batches):
        for batch in batches:
            units = _streams(batch.column(2))
            for part in _parts(units):
                x = _pooled(units[part], vectors, weights)
                ids, known = (batch.column(i)[part.start : part.stop] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, known, pa.array([r.tobytes() for r in x], pa.binary())], names=["l_id", "label", "x"])

    got = picked.select("l_id", "label", "units").mapInArrow(pool, "l_id long, label double, x binary").toArrow()
    got = got.sort_by([("l_id", "ascending"), ("label", "ascending"), ("x", "ascending")])
    y = got["label"].to_numpy() if got.num_rows else np.zeros(0)
    model = {"vectors": vectors, "weights": weights, "net": None, "rate": float(y.mean()) if len(y) else 0.5}
    if len(np.unique(y)) > 1:
        x = np.stack([np.frombuffer(b, np.float32) for b in got["x"].to_pylist()]).astype(np.float64)
        mix = np.random.RandomState(5).permutation(len(y))
        model["net"] = fit_network(x[mix], y[mix])
    return model


def _scored(tokens, model):
    """The columns of `tokens`, with `score` in place of the units."""
    at = tokens.columns.index("units")
    kept = [i for i in range(len(tokens.columns)) if i != at]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "units")

    def score(batches):
        for batch in give_back(batches):
            units = _streams(batch.column(at))
            scores = np.full(len(units), model["rate"])
            if model["net"] is not None:
                for part in _parts(units):
                    scores[part] = network_scores(_pooled(units[part], model["vectors"], model["weights"]), model["net"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(scores, pa.float64())],
                names=[*[batch.schema.names[i] for i in kept], "score"])

    return tokens.mapInArrow(score, f"{schema}, score double")


def judge_quality(docs: DataFrame, labels: DataFrame, accept=ACCEPT, doc_id="doc_id", text="text"):
    """One row per document: doc_id, held_out, score, predicted (1 from `accept`).

    Whole texts are scored; null and empty ones have the score of a text without words. Repeated rows
    are scored alike, each for itself; a null id counts as not held out. An empty table gives no rows.
    Columns other than id and text are not read, and the id is no input of the score. Texts are read
    and split once; training and scoring read the units that this leaves.
    """
    tokens, names = tokenised(docs.select(doc_id, text), text, keep=False)
    scored = _scored(tokens, train_quality(tokens, labels, names[doc_id]))
    return scored.select(F.col("c0").alias("doc_id"), held_out("c0").alias("held_out"), "score",
                         (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, accept=ACCEPT, doc_id="doc_id", text="text"):
    """The rows of `docs`, all columns, that the classifier does not reject."""
    tokens, names = tokenised(docs, text)
    scored = _scored(tokens, train_quality(tokens, labels, names[doc_id]))
    return scored.where(F.col("score") >= accept).select(*names.values()).toDF(*docs.columns)
