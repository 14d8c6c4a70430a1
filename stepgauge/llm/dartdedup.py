"""MinHash near-duplicates with DartMinHash signatures.

Every text is a weighted set: its 5-word shingles (the whole text where it has
fewer words), weighted by how often they occur.  Darts are a Poisson process
over (element, weight, rank): each unit region of an element's weight receives
darts at exponential gaps, hashed from the element, so equal regions of two
texts receive equal darts.  A dart carries a coordinate; per coordinate the
earliest dart is kept, which makes two coordinates agree with the probability
of the weighted Jaccard similarity.  Only darts below a rank of about
``k (ln k + 2) / weight`` are thrown; a text whose coordinates are not all
filled throws on with twice that.

Near is what the larger of weighted and plain Jaccard similarity says, so texts
that repeat a shingle have a second signature with all weights 1; that of a text
without repeats serves as both.  Signatures are cut into bands.  Of each band's
bucket the most central text and a seeded other one are its pivots, with which
all others are compared first.  Signatures decide only what they can't well get
wrong (``SURE``, ``HOPELESS``: at 0.8 one pair in a million); the rest that would
still join two components is compared exactly on both texts.

Where the other texts of a bucket are then still of several components, the
links that pivots miss are found exactly, whatever the bucket's size: near texts
have one of their rarest shingles in common (of n, one of the first
n - 0.8 n + 1 in order of frequency), at places and with lengths that leave room
for the overlap.  Shingles of one component alone come first in the order and
make no pairs, so a passage that many texts share makes none by itself, unless
texts consist of it for four fifths and are still not near.  Components of all
links are the classes.

Cases: null, empty and wordless texts are near only to texts that are equal to
them; repeated rows share a class; equal word sequences always do; a class is
named by its smallest id, null being the smallest.  Extra columns are not
looked at and stay where rows are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.llm.store import Scratch
from stepgauge.llm.wordscan import Words, mix, scanned, utf8

SHINGLE, THRESHOLD, BANDS, ROWS, SEED = 5, 0.8, 25, 5, 17
#: Signature agreement (of BANDS * ROWS coordinates) from which a pair is linked, or below which it is dropped, unseen.
SURE, HOPELESS = 0.96, 0.62
#: Texts that throw their darts at once: each throws about ``k (ln k + 2)`` however short it is.
TEXTS_AT_ONCE = 1000
#: Links in a file, about, while components are looked for.
LINKS_AT_ONCE = 200_000

_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, count) of each distinct shingle, sorted by row."""
    n = w.hash.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = w.begin[w.doc + 1] - np.arange(n)
    lengths = np.minimum(w.n, size)
    head = np.flatnonzero(left >= lengths[w.doc])
    acc = np.full(head.size, size, np.uint64)
    for k in range(size):
        inside = left[head] > k
        at = np.minimum(head + k, n - 1)
        acc = np.where(inside, mix(acc * np.uint64(31) + w.hash[at]), acc)
    doc = w.doc[head]
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    first = np.empty(doc.size, bool)
    first[0] = True
    first[1:] = (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])
    at = np.flatnonzero(first)
    return doc[at], acc[at], np.diff(np.append(at, doc.size))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = SEED) -> np.ndarray:
    """uint32[n_docs, k]; rows without weight stay 0.  Weights may be any positive numbers."""
    whole = np.ceil(weight).astype(np.int64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    region = np.repeat(np.arange(doc.size), whole)
    layer = np.arange(region.size) - np.repeat(np.cumsum(whole) - whole, whole)
    owner = doc[region]
    share = np.minimum(weight[region] - layer, 1.0)
    key = mix(element[region] + mix(layer.astype(np.uint64) * _G + np.uint64(seed)))
    best = np.full(n_docs * k, np.inf)
    out = np.zeros(n_docs * k, np.uint32)
    reach = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n_docs), where=total > 0)
    todo = total > 0
    while todo.any():
        alive = todo[owner]
        now_key, now_owner, now_share, rank = key[alive], owner[alive], share[alive], np.zeros(int(alive.sum()))
        step = 0
        slots, ranks, names = [], [], []
        while now_key.size:
            step += 1
            drawn = mix(now_key + np.uint64(step * int(_G) % 2**64))
            rank = rank - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank <= reach[now_owner]
            now_key, now_owner, now_share, rank, drawn = now_key[near], now_owner[near], now_share[near], rank[near], drawn[near]
            name = mix(drawn ^ _G)
            high = (name >> np.uint64(40)).astype(np.float64) * 2.0**-24
            hit = high < now_share if (now_share < 1).any() else slice(None)
            slots.append((now_owner * k + (mix(name) % np.uint64(k)).astype(np.int64))[hit])
            ranks.append(rank[hit])
            names.append(name[hit].astype(np.uint32))
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        out[slot[won]] = name[won]
        todo = todo & np.isinf(best.reshape(n_docs, k)).any(axis=1)
        reach = reach * 2
    return out.reshape(n_docs, k)


def described(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, version, content, sig, plain: the worker's side of ``describe``."""
    for batch in batches:
        texts = batch.column("text")
        for lo, hi, w in scanned(texts, rows=TEXTS_AT_ONCE):
            doc, element, count = shingles(w)
            sig = signatures(doc, element, count.astype(np.float64), hi - lo, k)
            # only texts that repeat a shingle have a plain signature of their own
            repeats = np.zeros(hi - lo, bool)
            repeats[doc[count > 1]] = True
            chosen = np.flatnonzero(repeats)
            mine = repeats[doc]
            flat = signatures(np.searchsorted(chosen, doc[mine]), element[mine], np.ones(int(mine.sum())), chosen.size, k)
            plain = [None] * (hi - lo)
            for at, i in enumerate(chosen):
                plain[i] = flat[at].tobytes()
            content, raw = [], None
            for i in range(hi - lo):
                if w.n[i]:
                    content.append(hashlib.blake2b(w.hash[w.begin[i] : w.begin[i + 1]].tobytes(), digest_size=16).digest())
                else:
                    raw = raw or texts.slice(lo, hi - lo).to_pylist()
                    content.append(hashlib.blake2b((raw[i] or "").encode(), digest_size=16, person=b"wordless").digest())
            rows = [sig[i].tobytes() if w.n[i] else None for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("version").slice(lo, hi - lo), pa.array(content, pa.binary()), pa.array(rows, pa.binary()), pa.array(plain, pa.binary())],
                ["doc_id", "version", "content", "sig", "plain"],
            )


def describe(docs: DataFrame, k: int = BANDS * ROWS) -> DataFrame:
    """doc_id, version (of the text), content (16 bytes, of the words), sig (4 k bytes, null without words), plain (of weights 1, null if it is sig)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(lambda it: described(it, k), f"doc_id {kind}, version long, content binary, sig binary, plain binary")


def agreement(a, b, k: int):
    """The share of coordinates in which two signatures agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: a.substr(i * 4 + 1, F.lit(4)) == b.substr(i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(k))


def similarity(a: str | None, b: str | None, size: int = SHINGLE) -> float:
    """The larger of weighted and plain Jaccard similarity of two texts' shingles."""
    data, offsets = utf8(pa.array([a, b], pa.string()))
    doc, element, count = shingles(Words(data, offsets), size)
    x, y = doc == 0, doc == 1
    if not x.any() or not y.any():
        return float((a or "") == (b or ""))
    both, i, j = np.intersect1d(element[x], element[y], assume_unique=True, return_indices=True)
    p, q = count[x], count[y]
    low = int(np.minimum(p[i], q[j]).sum())
    return max(low / (int(p.sum() + q.sum()) - low), both.size / (int(x.sum() + y.sum()) - both.size))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("text_a"), batch.column("text_b"), strict=True)
        keep = pa.array([similarity(a.as_py(), b.as_py()) >= THRESHOLD for a, b in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, for links (a, b).

    Each round hangs every node on its least neighbour, follows that to the
    root, and goes on with the links between roots alone, so a link within a tree
    is walked once.  A root that nothing hangs on has a smaller neighbour in the
    next round: two rounds at least halve the nodes.  Joins read written tables, so
    hot nodes can be split.
    """
    between = lambda rows, a, b: rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
    edges = scratch.keep(between(links, "a", "b"))
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    first = count = edges.count()
    # tables of links are small beside the documents: as many files as their rows ask for
    keep = lambda rows: scratch.keep(rows.coalesce(max(1, -(-2 * first // LINKS_AT_ONCE))))
    old = None
    while count:
        ends = edges.union(edges.select("b", "a"))
        roots = keep(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
        moved = True
        while moved:
            far = roots.select(F.col("node").alias("at"), F.col("label").alias("further"))
            jumped = keep(roots.join(far, roots.label == far["at"]).select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")))
            scratch.discard(roots)
            roots, moved = jumped.select("node", "label"), jumped.where("moved").limit(1).count()
        of = lambda c: roots.select(F.col("node").alias(c), F.col("label").alias(f"root_{c}"))
        rest = keep(between(edges.join(of("a"), "a").join(of("b"), "b"), "root_a", "root_b"))
        scratch.discard(edges)
        edges, count = rest, rest.count()
        if old is None:
            labels = roots
        else:
            labels = keep(old.join(of("label"), "label", "left").select("node", F.coalesce("root_label", "label").alias("label")))
            scratch.discard(old, roots)
        old = labels
    if old is not None:
        scratch.discard(edges)
    return labels


def stars(labels: DataFrame) -> DataFrame:
    """a, b: a link from each node to its label, which join what the links did that the labels (node, label) come from."""
    return labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def candidates(scratch: Scratch, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: each text of a bucket with the bucket's two pivots; bucket, content: the texts that are no pivots; known: content, sig, plain."""
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col(c).substr(i * 4 * ROWS + 1, F.lit(4 * ROWS))))
    both = F.when(F.col("plain").isNull(), cut("sig")).otherwise(F.array_distinct(F.concat(cut("sig"), cut("plain"))))
    bands = known.where("sig is not null").select("content", F.explode(both).alias("bucket"))
    full = scratch.keep(bands.groupBy("bucket").count().where("count > 1"))
    shared = scratch.keep(bands.join(full, "bucket"))
    degree = scratch.keep(shared.groupBy("content").agg(F.sum("count").alias("degree")))
    centre = F.max(F.struct("degree", "content")).getField("content")
    other = F.min(F.struct(F.xxhash64("bucket", "content").alias("h"), F.col("content"))).getField("content")
    pivots = scratch.keep(shared.join(degree, "content").groupBy("bucket").agg(F.array_distinct(F.array(centre, other)).alias("pivots")))
    pairs = shared.join(pivots, "bucket").select("content", F.explode("pivots").alias("pivot")).where("content != pivot")
    rest = shared.where("count > 2").join(pivots, "bucket").where("not array_contains(pivots, content)").select("bucket", "content")
    return pairs.select(F.least("content", "pivot").alias("a"), F.greatest("content", "pivot").alias("b")).distinct(), rest


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content, label, text -> content, label, view, size, token: each text's shingles; a text that repeats some has a second view in which repeats are tokens of their own."""
    for batch in batches:
        for lo, hi, w in scanned(batch.column("text"), 1_000_000):
            doc, element, count = shingles(w)
            n = np.bincount(doc, minlength=hi - lo)
            total = np.bincount(doc, weights=count, minlength=hi - lo).astype(np.int64)
            mine = total[doc] > n[doc]
            again, size = np.repeat(np.flatnonzero(mine), count[mine]), count[mine]
            layer = np.arange(again.size) - np.repeat(np.cumsum(size) - size, size)
            layered = np.where(layer == 0, element[again], mix(element[again] + layer.astype(np.uint64) * _G))
            row, token = np.concatenate([doc, doc[again]]), np.concatenate([element, layered])
            view, sizes = np.repeat([0, 1], [doc.size, again.size]), np.concatenate([n[doc], total[doc[again]]])
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content").take(at), batch.column("label").take(at), pa.array(view, pa.int32()), pa.array(sizes, pa.int64()), pa.array(token.view(np.int64))],
                ["content", "label", "view", "size", "token"],
            )


def fetched(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (content, ..) with a text of each content.

    By shuffle at every size: what is wanted grows with the input, so a plan that
    sends it to all executors would not last.
    """
    ends = wanted.join(known.select("content", F.col("first.doc_id").alias("__id"), F.col("first.version").alias("__version")), "content")
    full = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("v"), "text").hint("merge")
    found = full.join(ends, F.col("d").eqNullSafe(F.col("__id")) & (F.col("v") == F.col("__version")))
    return found.select(*wanted.columns, "text").dropDuplicates(["content"])


def further(scratch: Scratch, docs: DataFrame, known: DataFrame, rest: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(a, b: all pairs that can be near of the texts of a bucket that neither pivots nor links, whose components labels has, have settled; content, text of those); None if there are no such texts."""
    own = scratch.keep(rest.join(labels, F.col("content") == F.col("node"), "left").select("bucket", "content", F.coalesce("label", "content").alias("label")))
    split = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    left = scratch.keep(own.join(split, "bucket").select("content", "label").distinct())
    if not left.limit(1).count():
        return None
    texts = scratch.keep(fetched(docs, known, left))
    tokens = scratch.keep(texts.mapInArrow(elements, "content binary, label binary, view int, size long, token long"))
    scratch.discard(own)
    # a shingle of one component makes no pairs; those shingles come first in the order, then the rarer of the others
    common = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("token", "n")
    view = Window.partitionBy("content", "view")
    held = tokens.join(common, "token").withColumns({"rank": F.row_number().over(view.orderBy("n", "token")), "held": F.count("*").over(view)})
    place = F.col("size") - F.col("held") + F.col("rank") - 1
    prefix = scratch.keep(held.select("content", "label", "size", "token", place.alias("place")).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * THRESHOLD - 1e-9)))
    scratch.discard(tokens)
    x, y = (prefix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("content", "label", "size", "place")]) for side in "xy")
    room = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) * (1 + THRESHOLD) >= (F.col("size_x") + F.col("size_y")) * THRESHOLD - 1e-6
    alike = F.least("size_x", "size_y") >= F.greatest("size_x", "size_y") * THRESHOLD - 1e-6
    met = x.join(y, (x.token == y.token) & (F.col("content_x") < F.col("content_y")) & (F.col("label_x") != F.col("label_y")) & alike & room)
    return scratch.keep(met.select(F.col("content_x").alias("a"), F.col("content_y").alias("b")).distinct()), texts.select("content", "text")


def linked(scratch: Scratch, docs: DataFrame, known: DataFrame, pairs: DataFrame, labels: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """a, b: links that join the components of labels and of the pairs that are near; pairs within a component are not compared exactly.

    labels: node, label of the components so far, if there are some.
    texts: content, text of the pairs' texts, if they are at hand.
    """
    k = BANDS * ROWS
    left, right = (known.select(F.col("content").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("plain").alias(f"plain_{c}")) for c in "ab")
    agree = agreement(F.col("sig_a"), F.col("sig_b"), k)
    plain = agreement(F.coalesce("plain_a", "sig_a"), F.coalesce("plain_b", "sig_b"), k)
    agree = F.when(F.col("plain_a").isNull() & F.col("plain_b").isNull(), agree).otherwise(F.greatest(agree, plain))
    judged = scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", agree.alias("agree")).where(F.col("agree") >= HOPELESS))
    sure = judged.where(F.col("agree") >= SURE).select("a", "b")
    sure = sure if labels is None else stars(labels).union(sure)
    labels = components(scratch, sure)
    open_pairs = judged.where(F.col("agree") < SURE)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    open_pairs = open_pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({f"label_{c}": F.coalesce(f"label_{c}", c) for c in "ab"}).where("label_a != label_b")
    open_pairs = scratch.keep(open_pairs.select("a", "b"))
    if texts is None:
        texts = scratch.keep(fetched(docs, known, open_pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()))
    both = open_pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
    found = scratch.keep(both.mapInArrow(compared, "a binary, b binary").union(stars(labels)))
    scratch.discard(judged, open_pairs, texts)
    return found


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, version, label, class_id, class_rows for every row; classes join near texts (similarity of 0.8 or more)."""
    scratch = Scratch(docs.sparkSession, "dartdedup")
    rows = scratch.keep(describe(docs))
    known = scratch.keep(rows.groupBy("content").agg(F.first("sig").alias("sig"), F.first("plain").alias("plain"), F.min(F.struct("doc_id", "version")).alias("first")))
    pairs, rest = (scratch.keep(x) for x in candidates(scratch, known))
    labels = components(scratch, linked(scratch, docs, known, pairs))
    scratch.drop(rows, known, rest, labels)
    more = further(scratch, docs, known, rest, labels)
    if more is not None:
        labels = components(scratch, linked(scratch, docs, known, more[0], labels, more[1]))
    scratch.drop(rows, known, labels)
    named = scratch.keep(known.select("content", "first").join(labels, F.col("content") == F.col("node"), "left").select("content", F.coalesce("label", "content").alias("label"), "first"))
    sizes = rows.groupBy("content").count()
    whole = scratch.keep(named.join(sizes, "content").groupBy("label").agg(F.min("first").getField("doc_id").alias("class_id"), F.sum("count").alias("class_rows")))
    at = scratch.keep(named.join(whole, "label").select("content", "label", "class_id", "class_rows"))
    out = scratch.keep(rows.select("doc_id", "version", "content").join(at, "content").select("doc_id", "version", "label", "class_id", "class_rows"))
    scratch.drop(out)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the row whose id names the class (of repeated ids, the smallest version hash)."""
    scratch = Scratch(docs.sparkSession, "dartkeep")
    found = classes(docs)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id", "version").count()
    chosen = own.groupBy("label").agg(F.min(F.struct("doc_id", "version", "count")).alias("at"))
    chosen = scratch.keep(chosen.select(F.col("at.doc_id").alias("__id"), F.col("at.version").alias("__version"), F.col("at.count").alias("__rows")))
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    same = F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("__row.text") == F.col("__version"))
    out = row.join(chosen.where("__rows = 1"), same, "left_semi")
    if chosen.where("__rows > 1").limit(1).count():  # rows that are repeated as a whole
        again = row.join(chosen.where("__rows > 1"), same).dropDuplicates(["__id", "__version"]).select("__row")
        out = out.union(again)
    return out.select("__row.*")
