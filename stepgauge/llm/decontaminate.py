"""Benchmark decontamination with training suffix arrays.

The documents are cut into training shards of whole texts of about
``wordscan.CHUNK_BYTES``.  Per shard a suffix array over words is built, as deep
as the window (8 words); suffixes that begin with a word run no test suffix can
begin with are left out.  Every test suffix is then binary-searched in every
shard.  Runs of neighbouring matches on one diagonal are the longest verbatim
matches with their places; documents with matches of ``min_items`` items are
affected and can be removed.  Documents are never shuffled.

An item of fewer words than the window, but not none, is one window of its own.
The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES``, one
after the other; each block takes a pass over the documents, whose findings are
written and merged per text.

Cases: null, empty and wordless texts have no words and match nothing; an item
without words matches nothing; repeated item ids are one item, a null id is the
item ''; repeated documents each get the same answer; an empty benchmark leaves
all documents; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.llm.store import Scratch, Sent
from stepgauge.llm.wordscan import Words, scanned, utf8

WINDOW, MIN_ITEMS = 8, 2
#: Bytes of benchmark text that are collected and sent to the executors at once.
BLOCK_BYTES = 16_000_000


class TestSuffixes:
    """The distinct windows at the heads of the test suffixes of some items."""

    __test__ = False

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        data, offsets = utf8(pa.array(texts, pa.string()))
        w = Words(data, offsets)
        self.names = sorted({"" if i is None else str(i) for i in ids})
        at = {name: k for k, name in enumerate(self.names)}
        self.window = window
        self.vocabulary = np.unique(w.hash)
        word = np.searchsorted(self.vocabulary, w.hash) + 1
        rows, owner, place, length = [], [], [], []
        for k, name in enumerate(ids):
            lo, n = int(w.begin[k]), int(w.n[k])
            for p in range(max(n - window + 1, min(n, 1))):
                head = word[lo + p : lo + min(n, p + window)]
                rows.append(np.pad(head, (0, window - head.size)))
                owner.append(at["" if name is None else str(name)])
                place.append(p)
                length.append(head.size)
        rows = np.array(rows, dtype=np.int64).reshape(-1, window)
        self.rows, of = np.unique(rows, axis=0, return_inverse=True)
        of = of.reshape(-1)
        self.length = np.zeros(len(self.rows), np.int64)
        self.length[of] = length
        # of each distinct window: its items and places, as ranges of two arrays
        order = np.argsort(of, kind="stable")
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.begin = np.searchsorted(of[order], np.arange(len(self.rows) + 1))
        self.shortest = int(self.length.min()) if len(self.rows) else window


def packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Word numbers as few sort keys, in lexicographic order."""
    per, out = max(1, 62 // bits), []
    for k in range(0, len(columns), per):
        key = np.zeros_like(columns[0])
        for column in columns[k : k + per]:
            key = (key << bits) | column
        out.append(key)
    return out


def lower_bound(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Binary search: how many suffixes stand before each wanted one."""
    lo, hi = np.zeros(wanted[0].size, np.int64), np.full(wanted[0].size, keys[0].size, np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, keys[0].size - 1)
        less, equal = np.zeros(mid.size, bool), np.ones(mid.size, bool)
        for key, want in zip(keys, wanted, strict=True):
            less |= equal & (key[at] < want)
            equal &= key[at] == want
        go = lo < hi
        lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
    return lo


class Shard:
    """A training shard: the suffix array of some documents' words, and the matches in it."""

    def __init__(self, w: Words, tests: TestSuffixes):
        self.w, n = w, w.hash.size
        self.spans: dict[int, list[tuple[int, int]]] = {}
        self.items: dict[int, list[str]] = {}
        self.matches: dict[int, list[tuple[str, int, int, int]]] = {}
        if not n or not len(tests.rows):
            return
        slot = np.minimum(np.searchsorted(tests.vocabulary, w.hash), tests.vocabulary.size - 1)
        word = np.where(tests.vocabulary[slot] == w.hash, slot + 1, 0)
        # to the right of each word: words of its document, or known ones, whichever ends first
        stop = np.where(word == 0, np.arange(n), n)
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], w.begin[w.doc + 1])
        head = np.flatnonzero(stop - np.arange(n) >= tests.shortest)
        if not head.size:
            return
        bits = int(tests.vocabulary.size + 1).bit_length()
        inside = w.begin[w.doc[head] + 1]
        columns = [np.where(head + k < inside, word[np.minimum(head + k, n - 1)], 0) for k in range(tests.window)]
        keys = packed(columns, bits)
        suffixes = np.lexsort(keys[::-1])
        keys = [key[suffixes] for key in keys]
        low = packed([tests.rows[:, k] for k in range(tests.window)], bits)
        beyond = np.arange(tests.window)[None, :] >= tests.length[:, None]
        high = packed(list(np.where(beyond, (1 << bits) - 1, tests.rows).T), bits)
        high[-1] = high[-1] + 1  # the first suffix after those with this head
        first, last = lower_bound(keys, low), lower_bound(keys, high)
        found = np.flatnonzero(last > first)
        if not found.size:
            return
        count = (last - first)[found]
        window = np.repeat(found, count)
        inner = np.arange(window.size) - np.repeat(np.cumsum(count) - count, count)
        self.gather(head[suffixes[first[window] + inner]], window, tests)

    def gather(self, at: np.ndarray, window: np.ndarray, tests: TestSuffixes) -> None:
        """Hit spans, items and longest matches of each document; at: word, window: its number."""
        w, n = self.w, self.w.hash.size
        turn = np.zeros(n + 1, np.int64)
        np.add.at(turn, at, 1)
        np.add.at(turn, at + tests.length[window], -1)
        hit = np.concatenate([np.cumsum(turn)[:n] > 0, [False]])
        new = np.zeros(n + 1, bool)
        new[w.begin] = True
        edge = hit & (~np.concatenate([[False], hit[:-1]]) | new)
        start = np.flatnonzero(edge)
        ends = np.flatnonzero((hit[:-1] & (~hit[1:] | new[1:]))) + 1
        for s, e in zip(start, ends, strict=True):
            d = int(w.doc[s])
            self.spans.setdefault(d, []).append((int(s - w.begin[d]), int(e - w.begin[d])))
        many = tests.begin[window + 1] - tests.begin[window]
        at, window = np.repeat(at, many), np.repeat(window, many)
        entry = tests.begin[window] + np.arange(at.size) - np.repeat(np.cumsum(many) - many, many)
        doc, item, place = w.doc[at], tests.owner[entry], tests.place[entry]
        order = np.lexsort((at, at - place, item, doc))
        doc, item, place, at, size = doc[order], item[order], place[order], at[order], tests.length[window][order]
        fresh = np.ones(at.size, bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
        begins = np.flatnonzero(fresh)
        for b, e in zip(begins, np.append(begins[1:], at.size), strict=True):
            d, name = int(doc[b]), tests.names[item[b]]
            self.matches.setdefault(d, []).append((name, int(place[b]), int(at[b] - w.begin[d]), int(at[e - 1] + size[e - 1] - at[b])))
        for d, found in self.matches.items():
            self.items[d] = sorted({m[0] for m in found})


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
SCHEMA = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, matches array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>"


def searched(batches: Iterator[pa.RecordBatch], tests: TestSuffixes, pass_on: list[str], keep: int | None = None) -> Iterator[pa.RecordBatch]:
    """The worker's side: the findings of each text, or only the rows with fewer than ``keep`` items."""
    for batch in batches:
        for lo, hi, w in scanned(batch.column("text")):
            shard = Shard(w, tests)
            part = [batch.column(c).slice(lo, hi - lo) for c in pass_on]
            if keep is not None:
                ok = pa.array([len(shard.items.get(i, ())) < keep for i in range(hi - lo)], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in part], pass_on)
                continue
            rows = range(hi - lo)
            spans = pa.array([[{"start": s, "end": e} for s, e in shard.spans.get(i, ())] for i in rows], pa.list_(_FOUND))
            items = pa.array([shard.items.get(i, []) for i in rows], pa.list_(pa.string()))
            matches = pa.array([[dict(zip(("item_id", "item_start", "doc_start", "n_words"), m, strict=True)) for m in shard.matches.get(i, ())] for i in rows], pa.list_(_MATCH))
            yield pa.RecordBatch.from_arrays([*part, pa.array(w.n), spans, items, matches], [*pass_on, "n_words", "spans", "items", "matches"])


def blocks(benchmark: DataFrame) -> Iterator[tuple[int, Sent]]:
    """How many blocks there are, and the benchmark in blocks whose texts have at most about BLOCK_BYTES."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 2 * total // BLOCK_BYTES + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = part.collect()
        yield n, Sent(spark, TestSuffixes([r[0] for r in got], [r[1] for r in got]))


def suffix_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (hit words, merged), items (sorted as strings), matches (longest, with places)."""
    return versions_matched(docs, benchmark).drop("version")


def versions_matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``suffix_matches`` with version, the hash of the text, which tells rows of one id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    scratch, parts = Scratch(docs.sparkSession, "suffixes"), []
    found_in = lambda block: rows.mapInArrow(lambda it: searched(it, block.value, ["doc_id", "version"]), f"doc_id {kind}, version long, {SCHEMA}")
    for n, block in blocks(benchmark):
        if n == 1:
            return found_in(block)
        part = found_in(block)
        parts.append(scratch.keep(part.where("size(items) > 0") if parts else part))
        block.close()
    found = parts[0].where("size(items) > 0")
    for part in parts[1:]:
        found = found.union(part)
    join = lambda c: F.flatten(F.collect_list(c))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(join("spans").alias("s"), join("items").alias("i"), join("matches").alias("m"))
    merged = F.aggregate(
        F.array_sort("s"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.select("d", "v", merged.alias("s"), F.array_sort(F.array_distinct("i")).alias("i"), F.array_sort(F.array_distinct("m")).alias("m"))
    own = parts[0].select("doc_id", "version", "n_words", "spans", "items", "matches")
    out = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return out.select("doc_id", "version", "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"), F.coalesce("m", "matches").alias("matches"))


def remove_affected(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """docs without those in which windows of ``min_items`` items or more occur."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    n, block = next(blocks(benchmark))
    if n == 1:
        def kept(batches):
            known = block.value
            for batch in batches:
                whole = batch.column("__row")
                both = pa.RecordBatch.from_arrays([whole, whole.field("text")], ["__row", "text"])
                yield from searched([both], known, ["__row"], min_items)

        return row.mapInArrow(kept, row.schema).select("__row.*")
    block.close()
    found = versions_matched(docs, benchmark).where(F.size("items") >= min_items).select(F.col("doc_id").alias("__bad"), F.col("version").alias("__version")).distinct()
    same = F.col("__row.doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64("__row.text") == F.col("__version"))
    return row.join(found, same, "left_anti").select("__row.*")
