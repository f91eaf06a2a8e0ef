"""Document fingerprints: invertible Bloom lookup sketches of paragraphs (native: DataFrame functions only).

A document's paragraphs are its non-empty lines; their distinct 64-bit digests are its set. The
sketch has ``TABLES`` tables of ``CELLS`` cells; each digest is added to one cell per table (by hash),
and a cell holds how many digests it got, their xor, and the xor of their checksums. The fingerprint is
the sketch, written as text.

Two versions are compared by subtracting their sketches cell by cell (common digests cancel) and
peeling: a cell with one digest left (count 1 or -1, checksum fitting) gives that digest away, it is taken
out of its other cells, and so on, for up to ``ROUNDS`` rounds. If cells remain that cannot be peeled, the comparison is tried again
with a larger sketch: ``GROWTH`` times as many sub-sketches, digests dealt to them by hash, up to
``LEVELS`` times; what even the last cannot peel is compared by the digest sets themselves. Likeness is
the number of common digests over that of all.

Building and peeling are expressions inside a row (a pair of documents, or one of its sub-sketches); only
the pairs that failed go to the next level, with their digests, and nothing is shuffled for it.

Defined results: null text counts as empty (an empty sketch; two empty ones are alike, 1.0); repeated
paragraphs count once; rows sharing a doc_id are one document in the order of documents, represented
by its text of smallest hash; a null doc_id stands first; a single document is its own next one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.quality_rules import let
from logloom.llm.shared import next_and_previous, stored

TABLES, CELLS = 3, 8
LEVELS, GROWTH = 5, 4
ROUNDS = 12
NULL_KEY = -(2**63)


def digests(text: Column) -> Column:
    """The sorted distinct digests of a text's non-empty lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.length(p) > 0)
    return F.sort_array(F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p))))


def _checksum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _places(digest: Column) -> Column:
    """The digest's cell in each table, as one number: 4 bits per table."""
    return F.xxhash64(digest, F.lit(2))


def _in_cell(places: Column, i: Column) -> Column:
    """Whether a digest with these places belongs to cell i (of all tables)."""
    return F.call_function("shiftright", places, (F.lit(CELLS.bit_length() - 1) * F.floor(i / CELLS)).cast("int")).bitwiseAND(CELLS - 1) == F.pmod(i, F.lit(CELLS))


def _add(cell: Column, digest: Column, checksum: Column, sign: Column) -> Column:
    return F.struct((cell["c"] + sign).alias("c"), cell["k"].bitwiseXOR(digest).alias("k"), cell["h"].bitwiseXOR(checksum).alias("h"))


def sketch(found: Column) -> Column:
    """The cells of a digest array."""
    entries = F.transform(found, lambda d: F.struct(d.alias("k"), _checksum(d).alias("h"), _places(d).alias("p")))
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    return let(
        entries,
        lambda all_entries: F.transform(
            F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)),
            lambda i: F.aggregate(all_entries, zero, lambda cell, x: F.when(_in_cell(x["p"], i), _add(cell, x["k"], x["h"], F.lit(1))).otherwise(cell)),
        ),
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    )


def peel(cells: Column) -> Column:
    """(ok, only_a, only_b): the digests on one side only; ok if all cells came out empty."""

    def single(cell: Column) -> Column:
        return (F.abs(cell["c"]) == 1) & (_checksum(cell["k"]) == cell["h"])

    def go(state: Column) -> Column:
        found = F.array_distinct(
            F.transform(F.filter(state["cells"], single), lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"), x["h"].alias("h"), _places(x["k"]).alias("p")))
        )
        return let(
            found,
            lambda out: F.struct(
                F.when(F.size(out) == 0, state["cells"])
                .otherwise(
                    F.transform(
                        state["cells"],
                        lambda cell, i: F.aggregate(out, cell, lambda acc, x: F.when(_in_cell(x["p"], i), _add(acc, x["k"], x["h"], -x["c"])).otherwise(acc)),
                    )
                )
                .alias("cells"),
                F.concat(state["only_a"], F.transform(F.filter(out, lambda x: x["c"] == 1), lambda x: x["k"])).alias("only_a"),
                F.concat(state["only_b"], F.transform(F.filter(out, lambda x: x["c"] == -1), lambda x: x["k"])).alias("only_b"),
                (F.size(out) > 0).alias("more"),
            ),
        )

    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("only_a"), none.alias("only_b"), F.lit(True).alias("more"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda state, _: F.when(state["more"], go(state)).otherwise(state),
        lambda state: F.struct(
            F.forall(state["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)).alias("ok"),
            state["only_a"].alias("only_a"),
            state["only_b"].alias("only_b"),
        ),
    )


def peeled(pairs: DataFrame, level: int) -> DataFrame:
    """(id, kind, ok, only_a, only_b, a, b) of pairs (id, kind, a, b) with GROWTH**level sub-sketches:
    the numbers of recovered digests, and the arrays themselves only of pairs that failed."""
    blocks = GROWTH**level

    def dealt(found: str, block: Column) -> Column:
        return F.filter(found, lambda d: F.pmod(F.xxhash64(d, F.lit(10 + level)), F.lit(blocks)) == block)

    if level:
        parts = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: peel(subtract(sketch(dealt("a", i)), sketch(dealt("b", i)))))
    else:
        parts = F.array(peel(subtract(sketch(F.col("a")), sketch(F.col("b")))))

    def total(side: str) -> Column:
        return F.aggregate("parts", F.lit(0), lambda acc, x: acc + F.size(x[side]))

    ok = F.forall("parts", lambda x: x["ok"])
    found = pairs.select("id", "kind", "a", "b", parts.alias("parts"))
    found = found.select("id", "kind", "a", "b", ok.alias("ok"), total("only_a").alias("only_a"), total("only_b").alias("only_b"))
    return found.withColumns({c: F.when(~F.col("ok"), F.col(c)) for c in ("a", "b")})


def differences(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(id, kind, only_a, only_b) of all pairs: each level tries what the one before could not peel;
    what is left after the last is compared by the digest arrays. No level shuffles anything."""
    names, done = ["id", "kind", "only_a", "only_b"], None
    left = pairs
    for level in range(LEVELS + 1):
        tried = stored(spark, peeled(left, level), "peeled")
        good = tried.where("ok").select(*names)
        done = good if done is None else done.union(good)
        left = tried.where("not ok").select("id", "kind", "a", "b")
        if left.isEmpty():
            return done
    rest = left.select("id", "kind", F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))
    return done.union(rest)


def likeness(n_a: Column, n_b: Column, apart: Column) -> Column:
    """Common digests over all digests, from the set sizes and the number of recovered differences."""
    common = (n_a + n_b - apart) / 2
    return F.when(common + apart == 0, F.lit(1.0)).otherwise(common / (common + apart))


def written(cells: Column) -> Column:
    """A sketch as text: its non-empty cells as place:count:digests:checksums, in hexadecimal."""
    parts = F.transform(
        cells, lambda x, i: F.when(x["c"] != 0, F.concat_ws(":", F.hex(i), F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"])))
    )
    return F.concat_ws("|", F.concat(F.lit("iblt"), F.lit(TABLES), F.lit("x"), F.lit(CELLS)), F.array_join(parts, "|"))


def edited_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): key, doc_id, text, edited (its last half replaced by the
    start of the next document's text) and next_digests, the next document's paragraphs."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.groupBy(F.col("key").alias("doc_id")).agg(F.struct(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("rep")).alias("own"))
    order = next_and_previous(spark, ids, "own").select(
        F.col("doc_id").alias("key"), F.col("own.rep").alias("rep"), F.col("previous_id").alias("previous"), F.col("previous_value.n").alias("previous_n")
    )
    # The texts are shuffled once, by key: both joins of docs read that exchange. (The hashes are
    # compared by xor, since an equality of columns would become a second key of the shuffle.)
    placed = docs.join(order, "key").where(F.xxhash64("text").bitwiseXOR(F.col("rep")) == 0)
    starts = placed.select(
        F.col("previous").alias("key"), F.expr("left(text, cast(previous_n div 2 as int))").alias("start"), digests(F.col("text")).alias("next_digests")
    )
    starts = starts.groupBy("key").agg(F.first("start").alias("start"), F.first("next_digests").alias("next_digests"))
    half = "cast(length(text) div 2 as int)"
    edited = F.expr(f"concat(left(text, length(text) - {half}), left(start, {half}))")
    return docs.join(starts, "key").select(
        "key", F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "text", edited.alias("edited"), "next_digests"
    )


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and the numbers of paragraphs and of recovered differing paragraphs."""
    rows = edited_texts(spark, docs).select(
        F.monotonically_increasing_id().alias("id"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), F.col("next_digests").alias("following"),
    )
    rows = stored(spark, rows, "paragraph_digests")  # no texts; the row numbers are fixed by the writing
    both = F.array(
        F.struct(F.lit("edited").alias("kind"), F.col("own").alias("a"), F.col("changed").alias("b")),
        F.struct(F.lit("next").alias("kind"), F.col("own").alias("a"), F.col("following").alias("b")),
    )
    found = differences(spark, rows.select("id", F.explode(both).alias("pair")).select("id", "pair.*"))
    apart = found.groupBy("id").agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("only_a") + F.col("only_b"))).alias(f"n_differing_{kind}") for kind in ("edited", "next")]
    )
    n = {c: F.size(c).cast("long") for c in ("own", "changed", "following")}
    return rows.join(apart, "id").select(
        "doc_id", "n_chars", "edited_sha256", written(sketch(F.col("own"))).alias("fingerprint"), written(sketch(F.col("changed"))).alias("edited_fingerprint"),
        likeness(n["own"], n["changed"], F.col("n_differing_edited")).alias("near_edited"), likeness(n["own"], n["following"], F.col("n_differing_next")).alias("near_next"),
        n["own"].alias("n_paragraphs"), "n_differing_edited", "n_differing_next",
    )
