"""Operators 3, 4, 5, 7 and 9 against brute force and round trips."""

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from stepgauge.llm import licenses, piececount, queries, quotelinks, sketch, zipwarc
from stepgauge.llm.store import Scratch
from tests.llm.test_text_ops import ODD, frame, words

PAGES = "page_id long, url string, html string, payload string"


def test_archives_round_trip(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op3_zip_warc(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        raw = pages[r.page_id].encode()
        same = [p for p, h in pages.items() if h == pages[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == min(same) else ("revisit", min(same)))


def test_archives_odd_cases(spark, monkeypatch):
    monkeypatch.setattr(zipwarc, "ARCHIVE_BYTES", 900)
    monkeypatch.setattr(zipwarc, "READ_BYTES", 300)
    texts = ["", None, "é\r\n\r\nWARC/1.1", "x" * 5000, "x" * 5000, "a", "a", "a", "b", "b"]
    ids = [5, 3, 4, 9, 8, 7, 7, 2, None, None]
    pages = spark.createDataFrame([(i, None if i == 4 else "http://e/\r\nX: y é", t, "z") for i, t in zip(ids, texts, strict=True)], PAGES)
    got = zipwarc.round_trip(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(map(str, ids))
    by = lambda i: sorted((r.record_type, str(r.refers_to)) for r in got if r.page_id == i)
    assert by(3) == [("response", "None")] and by(5) == [("revisit", "3")]
    assert by(8) == [("response", "None")] and by(9) == [("revisit", "8")]
    assert by(2) == [("response", "None")] and by(7) == [("revisit", "2")] * 2
    assert by(None) == [("response", "None")] * 2
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(t or "").encode() for t in texts}
    small = zipwarc.read(zipwarc.write(pages, Scratch(spark, "t"), least_bytes=2)).collect()
    assert {r.page_id for r in small if r.record_type == "revisit"} == {9}
    assert zipwarc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("force64", [False, True])
def test_zip_is_what_zipfile_reads(force64):
    out = io.BytesIO()
    writer = zipwarc.ZipWriter(out, force64)
    parts = {"a/b.txt": [b"one", b"two"], "é": [], "big": [bytes(range(256)) * 40]}
    for name, data in parts.items():
        writer.member(name, data)
    writer.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: z.read(n) for n in z.namelist()} == {n: b"".join(d) for n, d in parts.items()}
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        for name, data in parts.items():
            with z.open(name, "w", force_zip64=force64) as f:
                f.write(b"".join(data))
        z.comment = b"PK\5\6 is no end of directory"
    for data in (raw, other.getvalue()):
        reader = zipwarc.ZipReader(lambda o, n, data=data: data[o : o + n], len(data))
        assert {n: reader.part(n, 0, m.size) for n, m in reader.members.items()} == {n: b"".join(d) for n, d in parts.items()}
        assert reader.part("big", 5, 3) == b"\5\6\7"
        with pytest.raises(ValueError, match="no such range"):
            reader.part("big", 10_239, 2)
    with pytest.raises(ValueError, match="not a ZIP"):
        zipwarc.ZipReader(lambda o, n: b"nothing"[o : o + n], 7)


def greedy(word, begins, goes_on):
    n, at = 0, 0
    while at < len(word):
        pool = goes_on if at else begins
        size = next((k for k in range(min(len(word) - at, 200), 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def test_piece_counts_are_greedy_longest_match(spark, sf_dir):
    pieces = set(piececount.load_vocabulary(queries.VOCABULARY)[0])
    want, known = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, parts = 0, re.findall(rb"([ \t\n\x0b\f\r]*)([^\x00-\x20!-/:-@\[-`{-\x7f]+|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f])", r.text.encode())
        for k, (gap, word) in enumerate(parts):
            word = b" " + word if gap or not k else word
            if word not in known:
                known[word] = greedy(word, pieces, pieces)
            n += known[word]
        want[r.doc_id] = (len(parts), n)
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op4_piece_count(spark, sf_dir).collect()} == want


def test_piece_counts_of_random_vocabularies(tmp_path):
    rng = random.Random(4)
    for _ in range(60):
        some = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}
        begins, goes_on = some(9), some(9)
        if rng.random() < 0.5:
            goes_on |= {b"a", b"b", b"c"}
        machine = piececount.Automaton(sorted(begins), sorted(goes_on), b"")
        same = sorted(begins | {b"a", b"b", b"c"})
        one = piececount.Automaton(same, same, b"")
        for _ in range(200):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 12)))
            assert machine.count(word) == greedy(word, begins, goes_on), (word, begins, goes_on)
            assert one.count(word) == greedy(word, set(same), set(same))
    file = tmp_path / "vocab.txt"
    file.write_bytes(b"un\n##aff\n##able\n[UNK]\n")
    machine = piececount.Automaton(*piececount.load_vocabulary(str(file)))
    assert machine.text(b"unaffable un, xun", {}) == (4, 3 + 1 + 1 + 1)


def test_piece_counts_odd_cases(spark):
    got = {r.doc_id: r for r in piececount.counted(frame(spark, ODD), queries.VOCABULARY).collect()}
    assert [got[i].n_words for i in range(3)] == [0, 0, 0] and got[3].n_tokens == 1
    assert got[6].n_words == 3001 and got[6].n_tokens == got[7].n_tokens
    json_file = piececount.load_vocabulary("/opt/tokenizers/byte_bpe_50k.json")[0]
    assert set(json_file) >= set(piececount.load_vocabulary(queries.VOCABULARY)[0])
    assert piececount.counted(frame(spark, ODD).limit(0), queries.VOCABULARY).count() == 0


def test_piece_counts_do_not_depend_on_the_rows_before():
    machine = piececount.Automaton(*piececount.load_vocabulary(queries.VOCABULARY))
    texts = [b"sorting", b"(sorting", b" sorting", b"Madrid", b"(Madrid", b"quelque", b"(quelque", b"a sorting (sorting"]
    alone = [machine.text(t, {}) for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        known = {}
        assert all(machine.text(texts[i], known) == alone[i] for i in [*order] * 2)


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int, salt string") if rows and len(rows[0]) == 6 else spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level int, salt string")


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "How do I  sort?\nThanks"),
        (1, 1, "assistant", "Use the\nSORT command."),
        (1, 2, "user", "> use the\n>> How do I sort?\nBut how?"),
        (1, 3, "user", "On Monday you wrote:\n>how do i sort?\nAlso sideways?"),
        (1, 4, "assistant", ">>> Use the\n> nobody said this\nok"),
        (1, 5, "user", "> Thanks\n> SORT command.\nwhich"),
        (2, 0, "user", "How do I sort?"),
        (2, 1, "user", "> later\nfirst"),
        (2, 2, "user", "later"),
        (3, 0, None, None),
        (None, 1, "user", "> x"),
        (3, None, "user", "> x"),
        (2, 3, "user", "> later\nsame"),
        (2, 3, "user", "> later\nsame"),
    ]
    got = quotelinks.conversations(talk(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {(r.conv_id, r.turn): r for r in got}
    assert of[1, 2].parent_turn == 1 and of[1, 2].quoted_level == 1 and of[1, 2].text == "But how?"
    assert of[1, 3].parent_turn == 0 and of[1, 3].text == "Also sideways?"
    assert of[1, 4].parent_turn == 1 and of[1, 4].quoted_level == 3 and of[1, 4].text == "ok"
    assert of[1, 5].parent_turn == 1 and of[1, 5].quoted_passages == 1
    assert of[2, 1].parent_turn is None and of[2, 3].parent_turn == 2 and of[1, 0].text == rows[0][3]
    assert of[3, 0].text is None
    got.sort(key=lambda r: (r.conv_id is None, r.conv_id, str(r.reply_key)))
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 3, 2, 4, 5]
    for c in (1, 2):  # replies stand behind what they answer
        order = [r.turn for r in got if r.conv_id == c]
        assert all(r.parent_turn is None or order.index(r.parent_turn) < order.index(r.turn) for r in got if r.conv_id == c)


def test_quotes_over_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = queries.op5_quote_links(spark, sf_dir).collect()
    want = sorted(tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect())
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == want  # these hold no quotes
    assert [(r.conv_id, r.turn) for r in sorted(got, key=lambda r: (r.conv_id, r.reply_key))] == [x[:2] for x in want]
    assert quotelinks.conversations(rows.limit(0)).count() == 0


def brute_links(rows):
    """(conv, turn, text) to (parent, level, passages), by the rules of the docstring."""
    def passages(text):
        for line in (text or "").split("\n"):
            mark = re.match(r"[> \t]*", line)[0]
            level = mark.count(">")
            body = re.sub(r"\s+", " ", line[len(mark) :] if level else line).strip(" ").lower()
            if body:
                yield level, body

    first = {}
    for conv, turn, text in rows:
        for level, body in passages(text):
            if not level:
                first[conv, body] = min(turn, first.get((conv, body), turn))
    out = {}
    for conv, turn, text in rows:
        votes = {}
        for level, body in set(passages(text)):
            origin = first.get((conv, body), turn)
            if level and origin < turn:
                size, n = votes.get((level, origin), (0, 0))
                votes[level, origin] = (size + len(body), n + 1)
        best = max(((-level, size, origin, n) for (level, origin), (size, n) in votes.items()), default=None)
        own = [line for line in (text or "").split("\n") if ">" not in re.match(r"[> \t]*", line)[0]]
        out[conv, turn] = (best and best[2], best and -best[0], best[3] if best else 0, [x for x in own if not x.lower().rstrip(" ").endswith("wrote:")])
    return out


def test_quotes_are_brute_force(spark):
    """Generated threads: nested quotes in other spelling, passages that many messages share, quotes of nobody."""
    rng, rows = random.Random(12), []
    common = ["Thanks a lot", "best  regards"]
    for conv in range(30):
        said = []
        for turn in range(rng.randint(2, 25)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.9:
                    level, body = rng.choice(rng.choice(said))
                    body = re.sub(" ", lambda _: " " * rng.randint(1, 2), body.upper() if rng.random() < 0.3 else body)
                    lines.append((level + 1, body))
                else:
                    lines.append((rng.randint(1, 3), f"nobody {rng.random()}"))
            lead = ["On Monday you wrote:"] if lines and rng.random() < 0.4 else []
            own = [(0, rng.choice(common) if rng.random() < 0.3 else f"line {rng.randrange(40)} of {conv} {'word ' * rng.randrange(4)}end") for _ in range(rng.randint(1, 4))]
            said.append(lines + own)
            marks = lambda n: rng.choice((">" * n, "> " * n)) if n else ""
            rows.append((conv, turn, "\n".join([*lead, *(marks(n) + x for n, x in lines), *(x for _, x in own)])))
    got = {(r.conv_id, r.turn): r for r in quotelinks.conversations(talk(spark, [(c, t, "user", x) for c, t, x in rows])).collect()}
    want = brute_links(rows)
    assert sum(w[0] is not None for w in want.values()) > 150 and {w[1] for w in want.values()} >= {None, 1, 2, 3}
    for key, (parent, level, n, own) in want.items():
        r = got[key]
        assert (r.parent_turn, r.quoted_level, r.quoted_passages) == (parent, level, n), key
        assert r.text == "\n".join(own).strip(" "), key


def paragraphs(text):
    return {x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")}


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def check_sketches(rows, got):
    """rows: (id, text) in order."""
    for k, (doc, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest(), doc
        assert r.near_edited == pytest.approx(near(text, edit)) and r.near_next == pytest.approx(near(text, other)), doc
        assert (r.fingerprint == r.edited_fingerprint) == (paragraphs(text) == paragraphs(edit))


def test_sketches_are_brute_force(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check_sketches(rows, {r.doc_id: r for r in queries.op7_bloom_sketch(spark, sf_dir).collect()})


def test_sketches_odd_cases(spark):
    rng = random.Random(9)
    many = "\n".join(str(rng.random()) for _ in range(700))
    texts = [*ODD, "", None, many, many + "\nmore", "é\n\n\nü\n é ", "é\nü", "one"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    check_sketches(list(enumerate(texts)), got)
    assert got[6].fingerprint == got[7].fingerprint
    twice = sketch.fingerprints(frame(spark, ["a", "b", "a", None], [None, 1, 1, 1])).collect()
    assert len(twice) == 4
    assert sketch.fingerprints(docs.limit(0)).count() == 0
    alone = sketch.fingerprints(frame(spark, ["a\nb"], [7])).first()
    assert alone.near_next == 1.0


def test_peeling_recovers_the_digests(spark):
    rng = random.Random(3)
    rows = []
    for n in (0, 1, 2, 5, 9, 40, 300, 1500):
        shared = [rng.getrandbits(63) for _ in range(rng.choice((0, 20, 400)))]
        a, b = [rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(n // 2)]
        rows.append((sorted(shared + a), sorted(b + shared), sorted(a + b)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want array<long>")
    df = df.withColumns({"s": sketch.sketch(F.col("a")), "t": sketch.sketch(F.col("b"))})
    one = sketch.peeled(sketch.subtracted(sketch.block_cells(F.col("a"), F.lit(2)), sketch.block_cells(F.col("b"), F.lit(2))), F.lit(2))
    every = sketch.differing(F.col("s"), F.col("t"), F.col("a"), F.col("b"))
    for r in df.select("want", "s", F.array_sort(one).alias("one"), F.array_sort(every).alias("all"), sketch.digest_count(F.col("s")).alias("n"), "a").collect():
        assert r.all == r.want and r.n == len(r.a)
        assert r.one in (r.want, None) and (len(r.want) <= sketch.BLOCK or r.one is None)
        assert len(r.s.cells) == sketch.BLOCK << r.s.bits and sketch.LOAD << r.s.bits >= len(r.a)


def test_sketches_fold_to_those_of_a_smaller_size(spark):
    rng = random.Random(8)
    keys = sorted(rng.getrandbits(63) for _ in range(700))
    df = spark.createDataFrame([(keys,)], "a array<long>").withColumn("s", sketch.sketch(F.col("a")))
    r = df.select("s", sketch.folded(F.col("s"), F.lit(0)).alias("one"), sketch.block_cells(F.col("a"), F.lit(0)).alias("want"), sketch.before(F.col("a"), F.lit(keys[333])).alias("at")).first()
    assert r.s.bits == 4 and r.one == r.want and r.at == 333


def brute_base(text):
    w, found = words(text), []
    for phrase, label in licenses.BASE:
        found += [(i, label) for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
    return len(w), sorted(found)


def brute_rules(text):
    low = (text or "").lower()
    found = []
    for k, (p, label, _, rule) in enumerate(licenses.rules()):
        if any(w in re.sub(r"[\s-]+", " ", low) for w in licenses.keywords(licenses.rules()[k])):
            found += [(m.start(), m.end(), p, k, label) for m in re.finditer(rule, low, re.ASCII)]
    kept = set()
    for a, b, p, k, label in found:
        if not any((x <= a and b <= y and q >= p and ((x, y) != (a, b) or (q, -j) > (p, -k))) for x, y, q, j, _ in found if j != k or (x, y) != (a, b)):
            kept.add(label)
    return kept


def example(rng, parsed):
    """A text that a parsed expression matches but for what stands around it."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            chosen, value = rng.choice(arg)
            out += chr(value) if str(chosen) == "LITERAL" else chr(rng.randint(*value)) if str(chosen) == "RANGE" else rng.choice(" \n\t")
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            out += "".join(example(rng, inner) for _ in range(rng.randint(least, min(int(most), least + 1))))
        elif op == "SUBPATTERN":
            out += example(rng, arg[-1])
        elif op == "BRANCH":
            out += example(rng, rng.choice(arg[1]))
    return out


def test_license_gate_passes_examples_of_every_rule():
    rng = random.Random(4)
    for whole in licenses.rules():
        _, label, _, rule = whole
        hits = 0
        for _ in range(60):
            text = rng.choice(["", "x", "_", "7", "by "]) + example(rng, re._parser.parse(rule))
            if re.search(rule, text, re.ASCII):
                hits += 1
                assert re.search(licenses.GATE, text, re.ASCII), (label, text)
                assert any(w in re.sub(r"[\s-]+", " ", text) for w in licenses.keywords(whole)), (label, text)
        assert hits, (label, rule)


def test_license_gate_in_the_query(spark):
    texts = ["under MIT 0", "MIT\nNo\tAttribution", "see MIT  No Attribution", "the freebsd 2 clause", "under x_gplv2 only", "mitten 0"]
    got = {r.doc_id: r for r in licenses.scanned(frame(spark, texts)).collect()}
    check_licenses(texts, got)
    assert [got[i].labels for i in range(3)] == ["mit-0"] * 3 and got[5].labels == ""


def check_licenses(texts, got):
    for i, text in enumerate(texts):
        n, base = brute_base(text)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(base)), i
        starts = [s for s, _ in base]
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if base else (None, None))
        own = {x for _, x in base}
        assert r.base_labels == ",".join(sorted(own))
        assert r.labels == ",".join(sorted(own | brute_rules(text))), (i, text[:300])
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_license_scan_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, sf_dir).collect()}
    check_licenses([r.text for r in rows], got)
    assert len(licenses.rules()) >= 200


def test_license_scan_odd_cases(spark):
    texts = [
        *ODD,
        "SPDX-License-Identifier: GPL-2.0+ and GNU General Public License, version 2 or later",
        "GNU Lesser General Public License v2.1. GNU GENERAL PUBLIC LICENSE. (gnu)general--public  license",
        "cc\n\n,,,,,,,,,,,,,,by mit license mit license apache.license; the mitlicense",
        "Licensed under CC BY-NC 4.0, see creativecommons.org/licenses/by-nc/4.0 and CC-BY-SA",
        "Apache License, Version 2.0; apache license 2.0, Redistribution and use in source and binary forms",
        "public domain. All rights reserved. WTFPL " * 50,
        "mit der mit licenseİ mit lİcense MIT LICENSE",
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: (Apache-2.0)",
    ]
    got = {r.doc_id: r for r in licenses.scanned(frame(spark, texts)).collect()}
    check_licenses(texts, got)
    n = len(ODD)
    assert "gpl-2.0-or-later" in got[n].labels and got[n].score == 1.0
    assert got[n + 2].n_base == 4 and "cc-by-nc" in got[n + 3].labels
    assert licenses.scanned(frame(spark, texts).limit(0)).count() == 0
    assert zlib.crc32(b"") == 0
