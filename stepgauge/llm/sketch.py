"""Invertible Bloom lookup sketches of paragraphs (DataFrame operations only).

A text is the set of its paragraphs' 63-bit digests (lines that aren't blank).
Its sketch has blocks, each for a range of digests, as many (a power of two) as
give a block ``LOAD`` digests at most on average; a block has cells in three rows.
A digest goes to one cell of each row of its block; a cell holds the count, the
exclusive-or of digests and that of their check hashes.  The fingerprint is the
sketch, cell by cell, as hexadecimal digits.

Two versions are compared by their sketches: the one with more blocks is folded
to the other's size (neighbouring blocks add up), the cells subtract, and cells
with one digest left are peeled until a block is empty, which yields the digests
that differ.  A block in which peeling gets stuck is sketched again, larger: its
range is cut in four, each with as many cells and with fresh hashes, and those of
the four that get stuck are cut again, up to ``RETRIES`` times.  Likeness is
shared / all digests of both versions, from the counts and the peeled digests.
Work is linear in the paragraphs but for the binary search of the ranges.

Cases: null is the empty text; texts without paragraphs are alike (1) and unlike
all others (0); equal texts have equal fingerprints; a paragraph counts once
however often it is repeated; digests that no retry tells apart (two that agree
in over 40 bits) count as different.  doc_id must be a number, as documents are
put in order by ranges of it; repeated ids are in the order of their texts'
hashes, null ids come first; rows of one id lie in one range.  Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells in each of a block's three rows, digests of a block on average at most, and how often a range is cut in four.
CELLS, LOAD, RETRIES = 8, 64, 20
BLOCK = 3 * CELLS
BITS = 63


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, in order."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.shiftrightunsigned(F.xxhash64(F.trim(x)), 64 - BITS))))


def places(key: Column, turn: Column) -> Column:
    """The three cells of a digest in its block."""
    h = F.xxhash64(turn.cast("int"), key)
    low = lambda shift: F.shiftright(h, shift).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    return F.array(low(0), low(16) + CELLS, low(32) + 2 * CELLS)


def check(key: Column) -> Column:
    return F.xxhash64(F.lit(77), key)


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The sum of two cells, or their difference."""
    return F.struct((a["n"] + sign * b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def empty_cell() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))


def block_cells(keys: Column, turn: Column) -> Column:
    """The cells of one block's digests."""
    spots = F.transform(keys, lambda k: F.struct(F.lit(1).alias("n"), k.alias("k"), check(k).alias("c"), places(k, turn).alias("p")))
    cell = lambda spot, i: F.aggregate(F.filter(spot, lambda s: F.get(s["p"], F.floor(i / CELLS).cast("int")) == i), empty_cell(), lambda s, x: added(s, x))
    return let(spots, lambda spot: F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: cell(spot, i)))


def before(keys: Column, bound: Column) -> Column:
    """How many of the ordered digests are smaller than a bound, by binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(keys) + 1)).cast("int"))
    halved = lambda s, _: let(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), lambda m: F.when(s["lo"] >= s["hi"], s).when(F.get(keys, m) < bound, F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi")), halved, lambda s: s["lo"])


def block_keys(keys: Column, block: Column, bits: Column) -> Column:
    """The digests of one of 2^bits ranges."""
    def cut(lo: Column) -> Column:
        hi = F.when(block + 1 == F.call_function("shiftleft", F.lit(1).cast("long"), bits), F.size(keys)).otherwise(before(keys, F.call_function("shiftleft", block + 1, BITS - bits)))
        return F.slice(keys, lo + 1, hi - lo)

    return F.when(bits == 0, keys).otherwise(let(before(keys, F.call_function("shiftleft", block, BITS - bits)), cut))


def sketch(keys: Column) -> Column:
    """bits (of the number of blocks) and all blocks' cells, one after the other."""
    def of(bits: Column) -> Column:
        blocks = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
        return F.struct(bits.alias("bits"), F.flatten(F.transform(blocks, lambda g: block_cells(block_keys(keys, g, bits), F.lit(0)))).alias("cells"))

    return let(F.greatest(F.ceil(F.log2(F.size(keys) / F.lit(float(LOAD)))), F.lit(0)).cast("int"), of)


def folded(a: Column, bits: Column) -> Column:
    """A sketch's cells, with neighbouring blocks added up until 2^bits are left."""
    def of(per: Column) -> Column:
        def cell(i: Column) -> Column:
            first = F.floor(i / BLOCK) * per * BLOCK + i % BLOCK
            return F.aggregate(F.sequence(F.lit(0), per - 1), empty_cell(), lambda s, j: added(s, F.get(a["cells"], (first + j * BLOCK).cast("int"))))

        n = F.size(a["cells"]) / per
        return F.when(per == 1, a["cells"]).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), cell))

    return let(F.call_function("shiftleft", F.lit(1), a["bits"] - bits), of)


def peeled(cells: Column, turn: Column) -> Column:
    """The digests in which a block's two versions differ, from the difference of their cells; null if peeling gets stuck."""
    def pure(state: Column) -> Column:
        return F.get(F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == check(x["k"]))), 0)

    def take(state: Column, x: Column) -> Column:
        def of(p: Column) -> Column:
            rest = F.transform(state["cells"], lambda y, i: F.when(F.get(p, F.floor(i / CELLS).cast("int")) == i, added(y, x, -1)).otherwise(y))
            return F.struct(rest.alias("cells"), F.concat(state["found"], F.array(x["k"])).alias("found"), F.lit(False).alias("over"))

        return let(places(x["k"], turn), of)

    def step(state: Column, _: Column) -> Column:
        ended = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over"))
        return F.when(state["over"], state).otherwise(let(pure(state), lambda x: F.when(x.isNull(), ended).otherwise(take(state, x))))

    start = F.struct(cells.alias("cells"), F.expr("cast(array() as array<bigint>)").alias("found"), F.lit(False).alias("over"))
    # each step peels one digest; a block's cells yield no more than there are
    end = F.aggregate(F.sequence(F.lit(0), F.lit(BLOCK)), start, step)
    return let(end, lambda e: F.when(F.forall(e["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), e["found"]))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: added(x, y, -1))


def differing(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The digests in which two texts differ: a, b their sketches; x, y what is sketched again where peeling gets stuck."""
    def first(bits: Column) -> Column:
        cells = subtracted(folded(a, bits), folded(b, bits))
        blocks = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
        peel = lambda all_: F.transform(blocks, lambda g: F.struct(g.alias("g"), peeled(F.slice(all_, (g * BLOCK + 1).cast("int"), F.lit(BLOCK)), F.lit(0)).alias("found")))
        return let(let(cells, peel), lambda got: gathered(got, F.expr("cast(array() as array<bigint>)"), bits))

    def gathered(got: Column, found: Column, bits: Column) -> Column:
        """State after a turn: what was found so far, and the blocks that are stuck."""
        more = F.flatten(F.transform(F.filter(got, lambda r: r["found"].isNotNull()), lambda r: r["found"]))
        stuck = F.transform(F.filter(got, lambda r: r["found"].isNull()), lambda r: r["g"])
        return F.struct(F.concat(found, more).alias("found"), stuck.alias("stuck"), bits.alias("bits"))

    def larger(state: Column, turn: Column) -> Column:
        def part(g: Column, bits: Column) -> Column:
            cells = subtracted(block_cells(block_keys(x, g, bits), turn), block_cells(block_keys(y, g, bits), turn))
            return F.struct(g.alias("g"), peeled(cells, turn).alias("found"))

        quarters = F.flatten(F.transform(state["stuck"], lambda g: F.sequence(g * 4, g * 4 + 3)))
        again = lambda bits: let(F.transform(quarters, lambda g: part(g, bits)), lambda got: gathered(got, state["found"], bits))
        return F.when((F.size(state["stuck"]) == 0) | (state["bits"] + 2 > BITS - 1), state).otherwise(let(state["bits"] + 2, again))

    def left(state: Column) -> Column:
        rest = F.transform(state["stuck"], lambda g: F.concat(block_keys(x, g, state["bits"]), block_keys(y, g, state["bits"])))
        return F.concat(state["found"], F.flatten(rest))

    return let(F.least(a["bits"], b["bits"]), lambda bits: F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), first(bits), larger, left))


def digest_count(a: Column) -> Column:
    """How many digests a sketch holds: each is counted in three cells."""
    return F.aggregate(a["cells"], F.lit(0).cast("long"), lambda s, x: s + x["n"]) / 3


def likeness(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Shared / all digests of two sketches a, b (of x, y), from the counts and the peeled difference."""
    of = lambda n, d: F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d))
    return let(digest_count(a) + digest_count(b), lambda n: let(F.size(differing(a, b, x, y)), lambda d: of(n, d)))


def fingerprint(a: Column) -> Column:
    """A sketch's cells as hexadecimal digits: 8 for the count, 16 each for keys and check."""
    digit = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.array_join(F.transform(a["cells"], lambda x: F.concat(digit(x["n"], 8), digit(x["k"], 16), digit(x["c"], 16))), "")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: of the document with the next id (after the last: the first).

    Ids are cut into ranges at quantiles; the first document of a range is also
    put at the end of the range before, so each range is ordered by itself and
    no task holds more than a range.  Null ids come first; of repeated ids the
    texts' hashes give the order.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 << max(2, min(parts, 1 << 13).bit_length())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = sorted({q for q in found.q or [] if q > found.least})
    bounds = F.array(*[F.lit(q).cast("long") for q in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    reached = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at)
    # binary search: how many bounds an id has reached
    span = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), reached) if steps else F.lit(0)
    first = F.col("doc_id").isNull() if found.nulls else F.col("doc_id") == F.lit(found.least)
    last = len(cuts)
    rows = rows.withColumn("span", F.coalesce(span, F.lit(0)))
    border = F.when((F.col("span") > 0) & (F.get(bounds, F.col("span") - 1) == F.col("doc_id")), F.col("span") - 1)
    at = F.array(F.struct(F.col("span").alias("span"), F.lit(0).alias("copy")))
    at = F.when(border.isNotNull(), F.concat(at, F.array(F.struct(border.alias("span"), F.lit(1).alias("copy"))))).otherwise(at)
    at = F.when(first, F.concat(at, F.array(F.struct(F.lit(last).alias("span"), F.lit(2).alias("copy"))))).otherwise(at)
    rows = rows.select("doc_id", "text", F.explode(at).alias("at")).select("doc_id", "text", "at.span", "at.copy")
    w = Window.partitionBy("span").orderBy("copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(w)).where("copy = 0").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    rows = with_next(docs)
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    # one projection after the other: the analyser goes through nested lambdas level by level, up to a limit
    keys = rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), *[digests(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    made = keys.withColumns({f"{c}_sketch": sketch(F.col(c)) for c in ("text", "edited", "next_text")})
    near = lambda c: likeness(F.col("text_sketch"), F.col(f"{c}_sketch"), F.col("text"), F.col(c))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("text_sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next_text").alias("near_next"),
    )
