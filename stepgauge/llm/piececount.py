"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Every node has a failure link, to where
matching goes on once the longest piece on its path has been taken off, and the
number of pieces popped on that way, worked out beforehand.  A word's greedy
longest-match length is the sum of the pops on one pass over its bytes; no
piece is built.

Words are runs of bytes that are neither ASCII white space nor ASCII
punctuation; each punctuation mark is a word.  A word after white space, or at
the start of a text, begins with the vocabulary's mark for that (byte-level
vocabularies), or every word begins at the root and goes on among the ``##``
pieces (word-piece vocabularies, where a word that can't be matched is one
unknown token).

Cases: null and empty texts have no words and no tokens; a word of any length is
matched in time linear in it; repeated rows count alike; the vocabulary file is
read once by the driver and may have at most ``VOCABULARY_BYTES``.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stepgauge.llm.store import Sent

#: The automaton is sent to all executors, so the file it is made from is bounded.
VOCABULARY_BYTES = 64_000_000
#: Words whose counts a worker remembers.
REMEMBERED = 200_000

_WORDS = re.compile(rb"[ \t\n\x0b\f\r]*(?:[^\x00-\x20!-/:-@\[-`{-\x7f]+|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f])")
_SPACE = b" \t\n\x0b\f\r"


def load_vocabulary(path: str) -> tuple[list[bytes], list[bytes], bytes]:
    """(pieces that begin words, pieces that go on, mark before a word) of a tiktoken file, a byte-level JSON or a vocab.txt."""
    with open(path, "rb") as file:
        raw = file.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    if path.endswith(".tiktoken"):
        pieces = [base64.b64decode(line.split()[0]) for line in raw.splitlines() if line.strip()]
        return pieces, pieces, b" "
    if path.endswith(".json"):
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in signs} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in signs)}
        pieces = [bytes(of[c] for c in piece) for piece in json.loads(raw)["model"]["vocab"] if all(c in of for c in piece)]
        return pieces, pieces, b" "
    lines = [x for x in raw.split(b"\n") if x]
    return [x for x in lines if not x.startswith(b"##")], [x[2:] for x in lines if x.startswith(b"##")], b""


class Automaton:
    """goto: (node << 8 | byte) -> node; fail and pops by node; -1 fails for good (an unknown word)."""

    def __init__(self, begins: list[bytes], goes_on: list[bytes], mark: bytes):
        self.mark, self.goto = mark, {}
        one = begins is goes_on
        piece, order, parent, letter = [False], [0], [0], [0]
        if not one:  # a root of its own for the pieces that go on
            piece.append(False)
            order.append(1)
            parent.append(1)
            letter.append(0)
        self.rest = 0 if one else 1
        for root, words in ((0, begins), (self.rest, goes_on)):
            for word in words if root or not self.goto else ():
                node = root
                for b in word:
                    key = node << 8 | b
                    if key not in self.goto:
                        self.goto[key] = len(piece)
                        piece.append(False)
                        parent.append(node)
                        letter.append(b)
                    node = self.goto[key]
                piece[node] = True
        n = len(piece)
        depth = [0] * n
        for v in range(len(order), n):  # parents are numbered before their children
            depth[v] = depth[parent[v]] + 1
        self.fail, self.pops = [-1] * n, [0] * n
        for v in sorted(range(len(order), n), key=depth.__getitem__):
            if piece[v]:
                self.fail[v], self.pops[v] = self.rest, 1
                continue
            at, popped = self.fail[parent[v]], self.pops[parent[v]]
            while at >= 0 and (at << 8 | letter[v]) not in self.goto:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[v], self.pops[v] = self.goto[at << 8 | letter[v]], popped

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of a word (its mark included)."""
        goto, fail, pops, node, n = self.goto, self.fail, self.pops, 0, 0
        for b in word:
            to = goto.get(node << 8 | b)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = goto.get(node << 8 | b)
            node = to
        while node != self.rest:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n

    def text(self, text: bytes, known: dict[bytes, int]) -> tuple[int, int]:
        """(words, tokens) of a text; known: counts that are remembered."""
        words = tokens = 0
        for run in _WORDS.findall(text):
            n = known.get(run) if words else None  # a text's first word may have the mark without white space
            if n is None:
                word = run.lstrip(_SPACE)
                n = self.count(self.mark + word if self.mark and (len(word) < len(run) or not words) else word)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(run) < 64 and words:
                    known[run] = n
            words += 1
            tokens += n
        return words, tokens


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    automaton = Sent(docs.sparkSession, Automaton(*load_vocabulary(vocabulary)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton.value, {}
        for batch in batches:
            counts = [machine.text(t.as_buffer().to_pybytes() if t.is_valid else b"", known) for t in batch.column("text").cast(pa.large_binary())]
            words, tokens = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
