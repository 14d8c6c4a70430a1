"""Operators 1, 2, 6, 8 and 10 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stepgauge.llm import dartdedup, decontaminate, mixing, quality, queries, shards
from stepgauge.llm.wordscan import Words, utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, shard string, row string, label string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[i], t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x", "y", "z", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "  \n", "a", "İK ß \x00 b", "one two three four five six seven eight nine", "x" * 70_000 + " y" * 3000, "x" * 70_000 + " y" * 3000, "--- !!"]


def brute_decontaminate(docs, items, window=8):
    heads = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, min(1, len(w)))):
            heads[tuple(w[i : i + window])].add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(h) for h in heads}:
            for i in range(len(w) - size + 1):
                if here := heads.get(tuple(w[i : i + size])):
                    found |= here
                    hit |= set(range(i, i + size))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def test_words_are_those_of_the_regex():
    texts = [*ODD, "Ünïcode Wörds—dash 9a_b", "tail"]
    w = Words(*utf8(pa.array(texts)))
    assert list(w.n) == [len(words(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for word, h in zip(words(t), w.hash[w.begin[i] : w.begin[i + 1]], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_decontaminate_is_brute_force(spark, sf_dir):
    got = {r[0]: tuple(r[1:]) for r in queries.op1_decontaminate(spark, sf_dir).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {k: v[:-1] for k, v in got.items()} == brute_decontaminate(docs, items)
    assert all((v[-1] > 0) == (v[2] > 0) and v[-1] <= v[1] for v in got.values())
    assert any(v[2] for v in got.values())


@pytest.mark.parametrize("block", [10**7, 60])
def test_decontaminate_odd_cases_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    vocabulary = ["the", "a", "Ü", "42", "zz"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, some(12)), (2, some(9)), (2, some(9)), (3, "a zz"), (4, None), (5, "..."), (None, "the Ü a"), (7, "a " * 30), (10, some(8))]
    texts = [*ODD, *(some(200) for _ in range(20)), items[0][1], items[0][1] + " , " + items[1][1].upper(), "a " * 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    found = decontaminate.suffix_matches(docs, bench).collect()
    want = brute_decontaminate(list(enumerate(texts)), [("" if i is None else i, t) for i, t in items])
    for r in found:
        hits = sum(s.end - s.start for s in r.spans)
        assert (r.n_words, hits, len(r["items"])) == want[r.doc_id][:3]
        w = words(texts[r.doc_id])
        for m in r.matches:  # the places hold the same words
            item = [words(t) for i, t in items if str(i) == m.item_id or (i is None and m.item_id == "")]
            assert any(x[m.item_start : m.item_start + m.n_words] == w[m.doc_start : m.doc_start + m.n_words] for x in item)
    kept = decontaminate.remove_affected(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if not v[4])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_affected(docs, none).count() == len(texts)
    assert decontaminate.suffix_matches(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [10**7, 60])
def test_decontaminate_judges_rows_of_one_id_by_their_texts(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [" ".join(f"{c}{i}" for i in range(12)) for c in "pqr"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bad = " and ".join(items)
    texts, ids = [bad, "clean one", "clean two", bad, "clean three", None, bad, bad, "clean four"], [1, 1, 2, None, None, None, 3, 3, 3]
    kept = decontaminate.remove_affected(frame(spark, texts, ids), bench).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t in zip(ids, texts, strict=True) if t != bad)


def test_shards_are_exact(spark, sf_dir):
    rows = queries.op2_shards(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = queries.op2_shards(spark, sf_dir).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_odd_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_ROWS", 1)
    docs = frame(spark, [*ODD, None, "a", "a"], [None, 1, 1, 1, 4, 5, 6, 6, 6, None, 7, 7])
    for sent in (10, 0):
        monkeypatch.setattr(shards, "PARTITIONS_SENT", sent)
        out = shards.dealt(docs, shards=5)
        assert out.select("row.*").schema == docs.schema
        rows = out.collect()
        assert Counter(str(r.row) for r in rows) == Counter(str(r) for r in docs.collect())
        assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(5) for i in range(3 - (s >= 2))]
    assert shards.dealt(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_shards(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and {(r["size"], r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}


def test_shards_of_equal_rows_are_uniform(spark):
    """A third of the rows are one row; every partition sends each shard about its share, in a new order."""
    docs = spark.range(24_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text")).repartition(6)
    rows = shards.dealt(docs).collect()
    same = Counter(r.shard for r in rows if r.row.doc_id == 0)
    assert all(abs(same[j] - 1000) < 150 for j in range(8))
    first = [r.slot for r in rows if r.row.doc_id == 0]
    assert abs(np.mean(first) - 1500) < 60


def test_hypergeometric_law():
    rng, n = random.Random(1), 20_000
    got = Counter(shards.hypergeometric(rng, 7, 9, 6) for _ in range(n))
    for k in range(7):
        p = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(got[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    for sizes in ([5, 0, 1000, 3], [10**9] * 20):
        matrix = shards.communication_matrix(sizes, 8)
        assert [sum(r) for r in matrix] == sizes
        columns = [sum(c) for c in zip(*matrix, strict=True)]
        assert max(columns) - min(columns) <= 1


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op6_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out for d in held) and sum(r.held_out for r in rows.values()) == sum(zlib.crc32(str(d).encode()) % 5 == 0 for d in rows)
    right = [rows[d].predicted == labels[d] for d in held]
    assert np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_quality_ranks_and_is_calibrated():
    """The pooled vectors alone, fitted as in production, on the held-out fold of the largest table."""
    read = lambda name, columns: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet", columns=columns).to_pydict()
    docs, known = read("documents", ["doc_id", "text"]), read("labels", ["doc_id", "quality"])
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(text[d], q, zlib.crc32(str(d).encode()) % 5) for d, q in zip(known["doc_id"], known["quality"], strict=True) if d in text]
    learned = [r for r in rows if r[2]][: quality.MAX_ROWS]
    model = quality.fit([r[0] for r in learned], np.array([r[1] for r in learned], float), np.array([r[2] == 1 for r in learned]))
    assert model.layers[0][0].shape == (quality.DIM, quality.HIDDEN)
    held = [r for r in rows if not r[2]]
    score, y = quality.scores(pa.array([r[0] for r in held]), model), np.array([r[1] for r in held])
    rank = np.argsort(np.argsort(score)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc >= 0.98 and np.mean((score >= quality.ACCEPT) == y) >= 0.97
    bins = np.minimum((score * 10).astype(int), 9)
    assert sum(abs(score[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in set(bins)) < 0.03


def test_quality_odd_cases(spark):
    docs = frame(spark, ODD)
    for labels in ([], [(1, 1)], [(3, 0), (3, 0), (5, 1), (None, 1), (8, None)]):
        known = spark.createDataFrame([(a, b, 0) for a, b in labels], "doc_id long, quality int, toxic int")
        got = quality.scored(docs, known).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert quality.remove_rejected(docs, known).schema == docs.schema
    assert quality.scored(docs.limit(0), known).count() == 0


def filled(capacity, weight, given):
    """Water-filling by bisection."""
    given = min(given, sum(capacity))
    lo, hi = 0.0, (max(c / w for c, w in zip(capacity, weight, strict=True)) if capacity else 0) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for c, w in zip(capacity, weight, strict=True)) < given else (lo, mid)
    return [min(c, hi * w) for c, w in zip(capacity, weight, strict=True)]


def test_mixture_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op8_mixture(spark, sf_dir).collect()
    domain = {r[0]: r[1] for r in docs.select("source", mixing.default_domain()).distinct().collect()}
    leaves, tokens = defaultdict(dict), {}
    for r in docs.collect():
        tokens[r.doc_id] = len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text))
        leaves[domain[r.source], r.lang, r.source][r.doc_id] = tokens[r.doc_id]
    size = {k: sum(v.values()) for k, v in leaves.items()}
    want = {(): float(math.floor(sum(size.values()) * 0.6))}
    for level in range(3):
        nodes = sorted({k[: level + 1] for k in size})
        for parent in {n[:-1] for n in nodes}:
            own = [n for n in nodes if n[:-1] == parent]
            weight = [2.0 if n[-1] in ("domain0", "en") and level < 2 else 1.0 for n in own]
            cap = [2 * sum(v for k, v in size.items() if k[: level + 1] == n) for n in own]
            want |= dict(zip(own, filled(cap, weight, want[parent]), strict=True))
    taken = defaultdict(Counter)
    for r in got:
        key = (r.domain, r.lang, r.source)
        assert abs(r.budget - want[key]) <= 1 and r.n_tokens == tokens[r.doc_id]
        taken[key][r.epoch, r.doc_id] += 1
    for key, docs_of in leaves.items():
        budget = round(want[key])
        used = sum(tokens[d] * n for (_, d), n in taken[key].items())
        assert budget - 1 <= used < budget + max(docs_of.values()) + 1, key  # the last document may begin within the budget
        whole = budget // size[key]
        for e in range(whole):
            assert {d for (x, d) in taken[key] if x == e} == set(docs_of)
        assert all(n == 1 for n in taken[key].values())


def test_mixture_ranges_and_odd_cases(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    texts = [*ODD, *("w " * (i % 7) for i in range(200))]
    docs = frame(spark, texts)
    whole = mixing.mixed(docs, 1.0)
    assert whole.select("row.*").schema == docs.schema
    assert sum(r.tokens for r in whole.collect()) == sum(len((t or "").split()) for t in texts)
    half = mixing.mixed(docs, 0.3, max_epochs=3).collect()
    monkeypatch.setattr(mixing, "LEAVES_SENT", -1)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4096)
    other = mixing.mixed(docs, 0.3, max_epochs=3).collect()
    assert Counter((r.row.doc_id, r.epoch) for r in half) == Counter((r.row.doc_id, r.epoch) for r in other)
    assert mixing.mixed(docs.limit(0), 0.5).count() == 0
    assert not [r for r in mixing.mixed(docs, 0.0).collect() if r.tokens]


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words(t)
        n = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else None)
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def near(i, j):
        a, b = sets[i], sets[j]
        if not a or not b:
            return not a and not b and (texts[i] or "") == (texts[j] or "")
        low = sum((a & b).values())
        return max(low / (sum(a.values()) + sum(b.values()) - low), len(a.keys() & b.keys()) / len(a.keys() | b.keys())) >= 0.8

    for i in range(len(texts)):
        for j in range(i):
            if near(i, j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_near_dedup_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in queries.op10_near_dedup(spark, sf_dir).collect()}
    want = brute_classes([r.text for r in rows])
    assert [got[r.doc_id] for r in rows] == [rows[k].doc_id for k in want]


def test_near_dedup_odd_cases(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(300), 5):
            copy[at] = "changed"
        near.append(" ".join(copy))
    texts = [*ODD, None, "", *near, " ".join(base), near[0].upper(), "p q r", "p  q, R", "p q s"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in dartdedup.classes(docs).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].class_rows == want.count(want[i]) for i in got)
    twice = docs.union(docs)
    kept = dartdedup.keep_one(twice)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert dartdedup.classes(docs.limit(0)).count() == 0
    nulls = frame(spark, ["a b", "a b", "c"], [None, 3, None])
    assert sorted(str(r.text) for r in dartdedup.keep_one(nulls).collect()) == ["a b", "c"]


def test_near_dedup_of_texts_with_a_shared_passage(spark):
    """Pairs that are near (0.8 to 0.85), all around one passage that makes most of their buckets large."""
    rng, texts = random.Random(3), []
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(300)
    for _ in range(200):
        own = new(70)
        copy = list(own)
        for at in rng.sample(range(70), 7):
            copy[at] = new(1)[0]
        texts += [" ".join(passage + own), " ".join(passage + copy)]
    got = {r.doc_id: r for r in dartdedup.classes(frame(spark, texts)).collect()}
    near = [dartdedup.similarity(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 400, 2)]
    assert sum(near) > 150
    assert [got[i].class_id == got[i + 1].class_id for i in range(0, 400, 2)] == near
    assert all(r.class_rows <= 2 for r in got.values())


def test_near_dedup_of_copies_that_repeat_a_passage(spark):
    base = [f"w{i}" for i in range(300)]
    again = base + base[:60] * 4
    texts = [" ".join(base), " ".join(again), " ".join([*again[:200], "changed", *again[201:]]), " ".join(f"v{i % 50}" for i in range(300))]
    got = {r.doc_id: r.class_id for r in dartdedup.classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts) == [0, 0, 0, 3]


def test_components_are_union_find(spark):
    """Paths in three orders, a clique, stars with a small and a large centre, random links."""
    rng, links = random.Random(2), [(2000, 2000)]
    for k, order in enumerate([range(60), reversed(range(60)), rng.sample(range(60), 60)]):
        path = [100 * k + i for i in order]
        links += list(zip(path, path[1:], strict=False))
    links += [(300 + i, 300 + j) for i in range(30) for j in range(i)] + [(400, 401 + i) for i in range(30)] + [(599, 500 + i) for i in range(30)]
    links += [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)]
    root = list(range(1000))
    for a, b in (x for x in links * 60 if x[0] < 1000):
        root[a] = root[b] = min(root[a], root[b])
    scratch = dartdedup.Scratch(spark, "components")
    got = dartdedup.components(scratch, spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {x: root[x] for a, b in links if a != b for x in (a, b)}
    assert got.count() == got.select("node").distinct().count()
    scratch.drop(got)
    assert dartdedup.components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_walks_links_of_a_group_once(spark, monkeypatch):
    """One group of near copies: when its links are known, one for each text is carried on, not all of them."""
    rng = random.Random(8)
    base, texts, sizes = [f"w{i}" for i in range(300)], [], []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(300), 2):
            copy[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    texts += [f"y{i} z{i}" for i in range(3)]
    real = dartdedup.components
    monkeypatch.setattr(dartdedup, "components", lambda scratch, links: (sizes.append(links.count()), real(scratch, links))[1])
    usual = dartdedup.candidates

    def all_left(scratch, found):  # the exact stage has texts of two components to look at
        pairs, _ = usual(scratch, found)
        return pairs, found.where("sig is not null").select(dartdedup.F.lit(1).cast("long").alias("bucket"), "content")

    monkeypatch.setattr(dartdedup, "candidates", all_left)
    got = {r.doc_id: r.class_id for r in dartdedup.classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts) == [0] * 150 + [150, 151, 152]
    assert len(sizes) == 4 and max(sizes[2:]) <= len(texts)


def test_near_dedup_finds_what_pivots_leave(spark, monkeypatch):
    """All texts in one bucket whose pivots are like none: the exact stage alone has to find the links."""
    rng, texts = random.Random(11), []
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(40)
    for i in range(40):
        base = new(rng.randint(20, 90)) + passage * rng.choice((0, 1, 1, 3))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randint(1, 4)):
                copy[at] = new(1)[0]
            texts.append(" ".join(copy + (passage[:10] * 4 if i % 7 == 0 else [])))
    texts += ["a b c", "a b c d", "a, b. C", " ".join(passage), " ".join(passage * 2)]

    def one_bucket(scratch, known):
        rest = known.where("sig is not null").select(F.lit(1).cast("long").alias("bucket"), "content")
        return rest.select(F.col("content").alias("a"), F.col("content").alias("b")).limit(0), rest

    monkeypatch.setattr(dartdedup, "candidates", one_bucket)
    got = {r.doc_id: r.class_id for r in dartdedup.classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_darts_of_many_short_texts_are_thrown_in_parts(monkeypatch):
    texts = pa.array([f"a{i} b c d e f" for i in range(5000)])
    sizes = []
    real = dartdedup.signatures
    monkeypatch.setattr(dartdedup, "signatures", lambda doc, element, weight, n, k: (sizes.append(n), real(doc, element, weight, n, k))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(range(5000)), texts], ["doc_id", "version", "text"])
    assert sum(b.num_rows for b in dartdedup.described(iter([batch]), 25)) == 5000
    assert max(sizes) <= dartdedup.TEXTS_AT_ONCE


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    element = np.arange(400, dtype=np.uint64)
    x, y = rng.random(400) * 3, rng.random(400) * 3
    doc = np.repeat([0, 1], 400)
    sig = dartdedup.signatures(doc, np.concatenate([element, element]), np.concatenate([x, y]), 2, 4096)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES][0] == "quality classifier" and len(p.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema
    out = p.run(spark, sf_dir)
    assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
    assert out.where(F.col("text").isNull()).count() == 0
