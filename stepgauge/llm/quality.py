"""Quality classifier: random-indexing word vectors and a small network.

A text's tokens are runs of word characters and runs of other visible
characters.  A token is four terms: its folded spelling, its form (lower case,
title, upper case, digits or marks), its form behind that of the token before,
and its form with whether it repeats that token.  Random indexing: each term has
a sparse ternary index vector made from its hash; a spelling's vector is its own
index vector plus those of the spellings next to it in the training texts and of
its forms, scaled by how often they meet.  A document is the mean vector of its
terms, and that alone is what a two-layer numpy network makes a logit of; a
temperature fitted on labelled rows kept apart turns it into a probability.

The fit reads at most ``MAX_ROWS`` labelled rows (those with the smallest seeded
hash) of at most ``MAX_BYTES`` of text together; a text of over a twentieth of
that is not learned from.  Every row is scored, whole.  Only rows with
crc32(doc_id) mod 5 other than 0 are learned from.  Labels, lang, source and
doc_id are no inputs.

Cases: null and empty texts are scored by the zero vector; repeated rows
score alike; repeated labels of an id each count; without labelled rows, or with
one class, the score is the (smoothed) share of label 1, 0.5 if none.  Other
columns pass through ``remove_rejected`` untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.llm.store import Scratch, Sent
from stepgauge.llm.wordscan import IS_WORD, LOWER, chunks, mix, runs, span_hashes, utf8

MAX_ROWS, MAX_BYTES, ACCEPT, SEED = 3000, 24_000_000, 0.3, 31
DIM, HIDDEN, TERMS, MIN_COUNT, NONZERO = 128, 24, 20_000, 5, 6
#: Forms of a token; terms made of forms alone: a form, two forms, a form and a repeat.
FORMS = 5
FORM_TERMS = FORMS + FORMS * (FORMS + 1) + 2 * FORMS

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens:
    """hash (folded spelling), shape (its form, 0-4), doc, and the number of tokens of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        word = IS_WORD[low]
        a, b, d = runs(word, offsets)
        s, e, t = runs(~(word | SPACE[low]), offsets)
        upper = low != data
        count = np.concatenate([[0], np.cumsum(upper)])
        ups = count[b] - count[a]
        digits = np.concatenate([[0], np.cumsum((low >= 48) & (low < 58))])
        shape = np.where(ups == 0, 0, np.where((ups > 1), 2, 1))
        shape = np.where(digits[b] - digits[a] == b - a, 3, shape)
        start, end = np.concatenate([a, s]), np.concatenate([b, e])
        shape = np.concatenate([shape, np.full(s.size, 4)])
        order = np.argsort(start, kind="stable")
        self.start, self.shape = start[order], shape[order]
        self.hash = span_hashes(low, start, end)[order]
        self.doc = np.concatenate([d, t])[order]
        self.n = np.bincount(self.doc, minlength=len(offsets) - 1)


def index_vectors(terms: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors, NONZERO entries each, from the terms' hashes."""
    out = np.zeros((terms.size, DIM), np.float32)
    rows = np.arange(terms.size)
    for k in range(NONZERO):
        h = mix(terms + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    return out


def form_terms(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each token's three terms that are made of forms."""
    form = t.shape.astype(np.int64)
    behind = np.full(form.size, FORMS)
    again = np.zeros(form.size, np.int64)
    same = t.doc[1:] == t.doc[:-1]
    behind[1:] = np.where(same, form[:-1], FORMS)
    again[1:] = same & (t.hash[1:] == t.hash[:-1])
    return form, FORMS + form * (FORMS + 1) + behind, FORMS + FORMS * (FORMS + 1) + 2 * form + again


def form_vectors() -> np.ndarray:
    return index_vectors(mix(np.arange(1, FORM_TERMS + 1).astype(np.uint64)))


@dataclass
class Model:
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        t, n = Tokens(data, offsets), len(offsets) - 1
        slot = np.minimum(np.searchsorted(self.terms, t.hash), max(self.terms.size - 1, 0))
        known = self.terms[slot] == t.hash if self.terms.size else np.zeros(t.hash.size, bool)
        row = np.where(known, slot, self.terms.size)
        size = np.maximum(t.n, 1).astype(np.float32)
        out = np.zeros((n, DIM), np.float32)
        for lo in range(0, row.size, 1 << 16):  # bounds the gathered vectors
            part, of = row[lo : lo + (1 << 16)], t.doc[lo : lo + (1 << 16)]
            at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[at]] += np.add.reduceat(self.vectors[part], at, axis=0)
        counts = sum(np.bincount(t.doc * FORM_TERMS + k, minlength=n * FORM_TERMS) for k in form_terms(t))
        out += counts.reshape(n, FORM_TERMS).astype(np.float32) @ form_vectors()
        return out / size[:, None]

    def logit(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        h = np.tanh(((x - self.mean) / self.scale) @ w1 + b1)
        return (h @ w2 + b2)[:, 0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(offsets) - 1, self.prior)
        z = self.logit(self.features(data, offsets)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class AllTokens:
    """The tokens of many chunks, without the arrays over bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        hashes, shapes, docs = [], [], []
        for a, b in chunks(offsets, 1_000_000):
            t = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hashes.append(t.hash)
            shapes.append(t.shape.astype(np.int8))
            docs.append((t.doc + a).astype(np.int32))
        self.hash, self.shape, self.doc = np.concatenate(hashes), np.concatenate(shapes), np.concatenate(docs)


def random_indexing(t: AllTokens) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the training texts, sorted, and their vectors; the last row is for all other terms."""
    terms, of, count = np.unique(t.hash, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count >= MIN_COUNT)
    often = np.sort(often[np.argsort(-count[often], kind="stable")[:TERMS]])
    row = np.full(terms.size, often.size, np.int32)
    row[often] = np.arange(often.size)
    row = row[of]
    own = np.concatenate([index_vectors(terms[often]), np.zeros((1, DIM), np.float32)])
    # the context of a spelling: the spellings beside it, and its own forms
    shapes = form_vectors()[:FORMS]
    sums, n = np.zeros_like(own), np.zeros(own.shape[0], np.float32)
    next_to = t.doc[1:] == t.doc[:-1]
    left, right = row[:-1][next_to], row[1:][next_to]
    for a, b in ((left, right), (right, left)):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for lo in range(0, a.size, 1 << 16):
            part = a[lo : lo + (1 << 16)]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums[part[at]] += np.add.reduceat(own[b[lo : lo + (1 << 16)]], at, axis=0)
        n += np.bincount(a, minlength=n.size)
    for shape in range(FORMS):
        met = np.bincount(row[t.shape == shape], minlength=n.size).astype(np.float32)
        sums += met[:, None] * shapes[shape]
        n += met
    return terms[often], own + sums / np.maximum(n, 1)[:, None]


def fit(texts: list[str | None], labels: np.ndarray, apart: np.ndarray, seed: int = SEED) -> Model:
    """apart: the labelled rows on which only the temperature is fitted."""
    labels = np.asarray(labels, np.float64)
    model = Model(prior=float((labels.sum() + 1) / (labels.size + 2)))
    train = ~apart if (~apart).any() and 0 < labels[~apart].sum() < (~apart).sum() else np.ones(labels.size, bool)
    if not 0 < labels[train].sum() < train.sum():
        return model
    data, offsets = utf8(pa.array(texts, pa.string()))
    model.terms, model.vectors = random_indexing(AllTokens(data, offsets))
    x = np.concatenate([model.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, 1_000_000)])
    model.mean, model.scale = x[train].mean(0), x[train].std(0) + 1e-3
    z, y = ((x - model.mean) / model.scale)[train].astype(np.float64), labels[train]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step, batch = 0, 128
    for _ in range(max(8, min(60, 60_000 // max(1, z.shape[0] // 4)))):
        for at in np.array_split(rng.permutation(z.shape[0]), max(1, z.shape[0] // batch)):
            step += 1
            h = np.tanh(z[at] @ p[0] + p[1])
            out = (h @ p[2] + p[3])[:, 0]
            g = (weight[at] * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[at]) / at.size)[:, None]
            dh = (g @ p[2].T) * (1 - h * h)
            grads = [z[at].T @ dh + 3e-4 * p[0], dh.sum(0), h.T @ g + 3e-4 * p[2], g.sum(0)]
            for k, d in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    # classes were weighted alike: the prior's log odds come back before calibration
    odds = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    model.layers = [(p[0].astype(np.float32), p[1].astype(np.float32)), (p[2].astype(np.float32), (p[3] + odds).astype(np.float32))]
    held = apart if apart.any() else train
    logits, y = model.logit(x[held]).astype(np.float64), labels[held]
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").where(fold() != 0)
    known = known.select(F.col("doc_id").alias("__id"), "quality", fold().alias("__fold"), F.xxhash64(F.lit(SEED), "doc_id", "quality").alias("__h")).orderBy("__h").limit(max_rows)
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__size")).where(F.col("__size") <= max_bytes // 20)
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("__h", F.xxhash64("text").alias("__v"), "__size", "text", "quality", "__fold").orderBy("__h", "__v").limit(max_rows)
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(rows)
    # a window over max_rows rows at most
    so_far = F.sum("__size").over(Window.orderBy("__h", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = rows.withColumn("__so_far", so_far).where(F.col("__so_far") <= max_bytes).select("text", "quality", "__fold").toArrow()
    scratch.drop()
    return fit(got.column(0).to_pylist(), np.array(got.column(1).to_pylist(), np.float64), np.array(got.column(2).to_pylist(), np.int64) == 1)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    data, offsets = utf8(column)
    parts = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = Sent(docs.sparkSession, learn(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), known))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def remove_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    model = Sent(docs.sparkSession, learn(docs, labels))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            whole = batch.column("__row")
            ok = pa.array(scores(whole.field("text"), known) >= ACCEPT)
            yield pa.RecordBatch.from_arrays([whole.filter(ok)], ["__row"])

    return row.mapInArrow(run, row.schema).select("__row.*")
