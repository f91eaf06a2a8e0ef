"""How the wording of each source differs from its language: exact divergences and their top terms.

Terms are the maximal runs of ASCII letters and non-ASCII characters, with A-Z lower-cased. Each
language keeps the terms found in at least ``least_docs`` of its documents. Every (lang, source) group
and every language gives each kept term the scaled share

    p = 1 + floor(SCALE * (count + 1) / (N + V))

(N: its occurrences of kept terms, V: kept terms of the language), and two shares p (the group's) and q
differ by ``floor((p - q) ** 2 / q)``. ``source_pairs`` sums that over all kept terms for every two
sources of a language; ``top_terms`` ranks the terms that a group uses more than its language.

Plan. One pass over the texts counts terms per task (a bounded dictionary, emitted as partial sums), and
one shuffle by (lang, term) adds them up to a row per kept term with its counts by source; a language's N and
V, and the groups' N, are sums of those rows.

* Ranking, by a dominance skyband: a term can only be among a group's first k if fewer than k other terms
  have a group count at least as high, a language count at most as high and an earlier place in UTF-8
  order (each of these is then ranked before it, as the value rises with the first and falls with the
  second). Each partition keeps the skyband of its terms of each group, the skybands meet in partitions
  by (group, slot), where the skyband of their union is taken again, and what is left is ranked exactly.
* Pairs: a term's counts in all sources of its language are one array; a task adds the differences of all
  its terms to one sources x sources matrix per language with numpy, and Spark adds the matrices. Terms
  that a source lacks have the share of count 0, so they need no row.

All arithmetic is exact (shares of counts too large for 64 bits in decimals; a share is at most SCALE + 1).

Defined results: null text, lang and source count as empty; every row is a document, repeated doc_ids
included; a group without kept terms has N = 0; a language without kept terms has pairs of value 0 and no
terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import stored
from logloom.llm.textops import string_buffers, word_spans

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
#: Partial sums that a task holds before it emits them.
HELD_TERMS = 1 << 19
#: Points of a group collected before their skyband is taken, points compared at once, slots of the merge.
HELD_POINTS = 1 << 15
COMPARED = 256
SLOTS = 8
#: Counts whose product with SCALE fits 64 bits.
SMALL = 9_000_000_000

# Letters stay (A-Z as a-z), bytes of non-ASCII characters stay, everything else separates.
_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_SEPARATES = _TABLE == 32


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms (UTF-8) of a text column in order, and the bounds of each text's terms among them."""
    data, offsets = string_buffers(column)
    starts, ends, bounds = word_spans(data, offsets, _SEPARATES)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    body = _TABLE[data[~_SEPARATES[data]]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)]), bounds


_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def count_terms(docs: DataFrame) -> DataFrame:
    """Partial sums per (lang, source, term): occurrences ``n`` and documents ``n_docs``; the term ''
    stands for the group itself and counts its documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            if len(held) == 1:
                return held[0]
            sums = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("n_docs", "sum")])
            return sums.select(["group", "term", "n_sum", "n_docs_sum"]).rename_columns(["group", "term", "n", "n_docs"])

        def emit(sums: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            group = sums["group"].combine_chunks()
            terms = sums["term"].cast(pa.large_string()).cast(pa.string())
            yield from pa.Table.from_arrays([lang.take(group), source.take(group), terms, sums["n"], sums["n_docs"]], schema=_PART).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            if not len(batch):
                continue
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.array([groups.setdefault(k, len(groups)) for k in keys], np.int64)
            terms, bounds = terms_of(batch.column("text"))
            coded = terms.dictionary_encode()
            words, width = coded.dictionary, len(coded.dictionary)
            # Occurrences by document and term, then both sums by group and term; code ``width`` is the term ''.
            doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
            key, times = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True) if width else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            doc, code = np.divmod(key, max(width, 1))
            key = np.concatenate([group[doc] * (width + 1) + code, group * (width + 1) + width])
            times = np.concatenate([times, np.zeros(len(group), np.int64)])
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            of, code = np.divmod(key[order][first], width + 1)
            words = pa.concat_arrays([words, pa.array([b""], pa.large_binary())])
            columns = [pa.array(of), words.take(pa.array(code)), pa.array(np.add.reduceat(times[order], first)), pa.array(np.diff(first, append=len(key)))]
            held.append(pa.Table.from_arrays(columns, ["group", "term", "n", "n_docs"]))
            size += len(first)
            if size > 2 * HELD_TERMS:
                held = [merged()]
                size = len(held[0])
                if size > HELD_TERMS:
                    yield from emit(held[0])
                    held, size = [], 0
        if held:
            yield from emit(merged())

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return texts.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def share(n: Column, total: Column, size: Column) -> Column:
    """The scaled share of count ``n`` among ``total`` occurrences of ``size`` kept terms."""
    small = F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total + size)
    large = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + size).cast("decimal(38,0)"))
    return F.lit(1) + F.when(n < SMALL, small).otherwise(large)


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` of numpy columns (``whole``: total + size)."""
    if (n < SMALL).all():
        return 1 + SCALE * (n + 1) // whole
    return (1 + SCALE * (n.astype(object) + 1) // whole.astype(object)).astype(np.int64)


class Counts:
    """Stored counts of the kept terms: ``rows`` (lang, term, lang_n, cells: the sources that use it, with
    n), and ``groups`` (lang, source, place among the language's sources, total, lang_total, size)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, *, least_docs: int = LEAST_DOCS):
        # One shuffle by (lang, term) serves both sums.
        sums = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term")
        sums = sums.agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")).groupBy("lang", "term")
        rows = sums.agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
        rows = rows.where((F.col("n_docs") >= least_docs) | (F.col("term") == "")).drop("n_docs")
        rows = stored(spark, rows, "divergence_counts")
        self.rows = rows.where(F.col("term") != "")
        totals = self.rows.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = self.rows.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("term").alias("size"))
        groups = rows.where(F.col("term") == "").select("lang", F.explode("cells.source").alias("source"))
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "lang_total", "size")}
        order = Window.partitionBy("lang").orderBy("source")
        self.groups = stored(spark, groups.withColumns(zero).withColumn("place", F.row_number().over(order) - 1), "divergence_groups")

    def terms(self) -> DataFrame:
        """(lang, source, term, n, lang_n, p, q) with n > 0."""
        terms = self.rows.select("lang", "term", "lang_n", F.inline("cells")).join(self.groups, ["lang", "source"])
        p = share(F.col("n"), F.col("total"), F.col("size"))
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
        return terms.select("lang", "source", "term", "n", "lang_n", p.alias("p"), q.alias("q"))


def skyband(count: np.ndarray, lang_count: np.ndarray, term: list[bytes], k: int) -> np.ndarray:
    """Places of the points that fewer than ``k`` others dominate (count at least as high, lang_count at
    most as high, term earlier; equal points all dominate the later ones of them).

    Points are taken in an order in which every dominator comes first; a point with k dominators has
    k of them in the skyband, so comparing with the kept ones and those of its own block is enough.
    """
    in_order = sorted(range(len(term)), key=term.__getitem__)
    rank = np.empty(len(term), np.int64)
    rank[in_order] = np.arange(len(term))
    order = np.lexsort((rank, lang_count, -count))
    low, place = lang_count[order], rank[order]
    kept = np.zeros(0, np.int64)
    for i in range(0, len(order), COMPARED):
        block = np.arange(i, min(i + COMPARED, len(order)))
        over = ((low[kept] <= low[block, None]) & (place[kept] < place[block, None])).sum(1)
        mates = (low[block] <= low[block, None]) & (place[block] < place[block, None])
        over += np.tril(mates, -1).sum(1)
        kept = np.concatenate([kept, block[over < k]])
    return order[kept]


POINT = "lang string, source string, term string, n long, lang_n long, value long"


def skybands(points: DataFrame, k: int) -> DataFrame:
    """The skyband of each group's points inside each partition. Partitions are sorted by group, so one
    group's skyband and ``HELD_POINTS`` further points are in memory."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[str, str] | None = None
        held: list[pa.RecordBatch] = []

        def band() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            best = skyband(t.column("n").to_numpy(), t.column("lang_n").to_numpy(), t.column("term").cast(pa.binary()).to_pylist(), k)
            return t.take(pa.array(best))

        for batch in batches:
            if not len(batch):
                continue
            codes = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
            keys = np.stack([c.indices.to_numpy() for c in codes])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c.dictionary[c.indices[a].as_py()].as_py() for c in codes)
                if key != group and held:
                    yield band()
                    held = []
                group = key
                held.append(batch.slice(a, b - a))
                if sum(map(len, held[1:])) >= HELD_POINTS:
                    held = [band()]
        if held:
            yield band()

    return points.sortWithinPartitions("lang", "source").mapInArrow(reduce, POINT)


def top_terms(counts: Counts, *, k: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): each group's ``k`` terms of highest difference from the
    language, among those it uses more; equal values in UTF-8 order."""
    over = counts.terms().where(F.col("p") > F.col("q"))
    points = over.select("lang", "source", "term", "n", "lang_n", difference(F.col("p"), F.col("q")).alias("value"))
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS))
    merged = skybands(skybands(points, k).repartition("lang", "source", slot), k)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(counts: Counts) -> DataFrame:
    """(lang, a, b, value): differences of the sources at places a and b, summed over all kept terms."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            cuts = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)] if langs else [0]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(first, last - first)
                sources, totals = (part.column(c)[0].as_py() for c in ("sources", "totals"))
                place_of = dict(zip(sources, range(len(sources)), strict=True))
                whole = np.array(totals, np.int64) + part.column("size")[0].as_py()
                absent = shares(np.zeros(len(whole), np.int64), whole)
                total = sums.setdefault(langs[first], np.zeros((len(whole), len(whole)), np.int64))
                cells = part.column("cells")
                flat = cells.flatten()
                row = np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy())
                names = flat.field("source").dictionary_encode()
                places = np.array([place_of[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                p_found = shares(flat.field("n").to_numpy(), whole[places])
                # Shares of at most 2**22 (term, source) cells at once.
                step = max(1, (1 << 22) // len(whole))
                for i in range(0, len(part), step):
                    inside = slice(*np.searchsorted(row, [i, i + step]))
                    p = np.tile(absent, (min(step, len(part) - i), 1))
                    p[row[inside] - i, places[inside]] = p_found[inside]
                    for b in range(len(whole)):
                        q = p[:, b : b + 1]
                        total[:, b] += ((p - q) ** 2 // q).sum(0)
        for lang, total in sums.items():
            a, b = np.divmod(np.arange(total.size), len(total))
            columns = [pa.array([lang] * total.size, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

    # One row per language: joined to its terms' rows, broadcast only where Spark finds it small.
    every = counts.groups.groupBy("lang", "size").agg(F.array_sort(F.collect_list(F.struct("place", "source", "total"))).alias("g"))
    every = every.select("lang", "size", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"))
    rows = counts.rows.join(every, "lang").select("lang", "size", "sources", "totals", "cells").sortWithinPartitions("lang")
    return rows.mapInArrow(add, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_pairs(counts: Counts) -> DataFrame:
    """(lang, source, item, value, rank): each group against every other source of its language."""
    group = counts.groups.select("lang", "source", F.col("place").alias("a"))
    other = counts.groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = group.join(other, "lang").where(F.col("a") != F.col("b"))  # the result itself: one row per pair of sources
    pairs = pairs.join(pair_sums(counts), ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def audit(spark: SparkSession, docs: DataFrame, *, least_docs: int = LEAST_DOCS, k: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: both reports of all groups."""
    counts = Counts(spark, docs, least_docs=least_docs)
    parts = [("pair", source_pairs(counts)), ("term", top_terms(counts, k=k))]
    first, second = (p.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, p in parts)
    return first.unionByName(second)
