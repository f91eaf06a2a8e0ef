"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Each document gets integer statistics. A fixed base rule drops texts of few words or mostly
repeated ones. Beyond it, limits are not fixed numbers: per language and source, and per
statistic, a mergeable quantile sketch of the base-passing documents gives the 10th, 50th and 90th percentile,
and a document more than ``fence`` times their distance from the median beyond the outer ones is rejected (rates of
repeats have long tails: clean texts reach twenty times the 90th percentile). Where nine of ten documents have the
same value there is no distance to measure; a least tolerance then takes its place.

The sketch is a log-linear histogram of integers: a value keeps its top ``SKETCH_BITS`` bits, so a
quantile is right to one part in 2**(SKETCH_BITS - 1), counts of equal buckets add up (merge in any
order), and every run gives the same result. Its size per group is bounded by the buckets of the
value range (under 700), not by the rows: a hot group collapses to its buckets before the shuffle.

Groups under ``min_rows`` use the merged sketch of their language, and a language under
``min_rows`` the merged sketch of all. Null language or source is a group of its own.

Defined results: a null or empty text has zero words, fails the base rule and is not kept; repeated
rows are judged alike; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]+"
WORD_BYTE = r"[^\x20\x09-\x0D]"

SKETCH_BITS = 6
#: Statistics judged, with the least tolerance (same units) beyond the outer percentiles, for groups without any
#: spread. All are per 10,000.
JUDGED = {"symbol_rate": 100, "repeat_rate": 500, "dup_line_rate": 3500, "upper_rate": 200, "word_rate": 3000}
FENCE = 20.0
MIN_ROWS = 1000
BROADCAST_GROUPS = 10_000


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once (a lambda variable, not an inlined expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR_CLASS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more (first occurrence included).

    Window hashes (64 bits, of the three words) are sorted with their positions; neighbours of equal
    hash are repeats; the union of their 3-word spans is measured in one pass over the positions.
    """

    def spans(pairs: Column) -> Column:
        n = F.size(pairs)
        repeats = F.filter(
            pairs,
            lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == x["h"])),
        )
        places = F.sort_array(F.transform(repeats, lambda x: x["p"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.when(
            n > 3,
            let(
                F.sort_array(
                    F.transform(
                        F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0))),
                        lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("p")),
                    )
                ),
                spans,
            ),
        ).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Per row: ``row`` (all columns of ``docs`` as one struct, so that no name can clash), ``lang``,
    ``source`` (null where the table lacks them) and ``base``, the integer statistics."""
    given = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(given, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_BYTE))

    def count_of(symbols: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{symbols}]+", "")).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(found: Column) -> Column:
        n = F.size(found).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(found))).alias("n_dup_lines"))

    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *[(F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")],
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        count_of(SYMBOLS).alias("n_symbols"),
        count_of("A-Z").alias("n_upper"),
    ).select("row", "lang", "source", F.struct("w.*", "l.*", "n_symbols", "n_upper").alias("base"))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def rates(stats: Column) -> dict[str, Column]:
    """The judged statistics, as whole numbers per 10,000."""

    def rate(part: str, whole: str) -> Column:
        return F.floor(10000 * stats[part] / F.greatest(stats[whole], F.lit(1))).cast("long")

    return {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "upper_rate": rate("n_upper", "word_chars"),
        "word_rate": rate("word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number >= 0: its bit length and its top ``SKETCH_BITS`` bits, as
    the least number with the same ones. Monotone, so buckets sort as values."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop.cast("int")), drop.cast("int"))


def sketches(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per group, statistic and bucket: the sketch as rows."""
    pairs = F.array(*[F.struct(F.lit(name).alias("stat"), bucket(F.col(f"rates.{name}")).alias("bucket")) for name in JUDGED])
    return judged.select(*keys, F.explode(pairs).alias("pair")).groupBy(*keys, "pair.stat", "pair.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and statistic: rows, and the 10th, 50th and 90th percentile (the bucket that holds the rank
    ceil(rows * q / 100)). A group's buckets are few, whatever its rows."""
    entries = sketch.groupBy(*keys, "stat").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("rows"))

    def at(q: int) -> Column:
        rank = F.ceil(F.col("rows") * q / 100)
        return F.aggregate(
            "b",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value")),
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.coalesce(acc["value"], F.when(acc["seen"] + x["n"] >= rank, x["bucket"])).alias("value"),
            ),
            lambda acc: acc["value"],
        )

    return entries.select(*keys, "stat", "rows", *[at(q).alias(f"p{q}") for q in (10, 50, 90)])


def thresholds(judged: DataFrame, *, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): ``limits``, a map of statistic to its (low, high) fences, and ``decided``,
    the statistics whose upper fence comes from the measured distance rather than the least tolerance."""
    names = ["p10", "p50", "p90"]
    by_group = sketches(judged, ["lang", "source"])
    by_lang = merged(by_group, ["lang"])
    of_all = merged(by_lang, [])
    least = F.element_at(F.create_map(*[F.lit(x) for pair in JUDGED.items() for x in pair]), F.col("stat")).cast("double")
    group = percentiles(by_group, ["lang", "source"])
    lang = percentiles(by_lang, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("stat").alias("l_stat"), *[F.col(c).alias(f"l_{c}") for c in ("rows", *names)])
    everything = percentiles(of_all, []).select(F.col("stat").alias("a_stat"), *[F.col(c).alias(f"a_{c}") for c in names])
    # All three sides hold at most (groups x statistics) rows; the joins are on equal keys.
    rows = group.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("stat") == F.col("l_stat"))).join(everything, F.col("stat") == F.col("a_stat"))

    def pick(name: str) -> Column:
        return F.when(F.col("rows") >= min_rows, F.col(name)).when(F.col("l_rows") >= min_rows, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}"))

    rows = rows.select("lang", "source", "stat", *[pick(c).alias(c) for c in names], least.alias("least"))
    above, below = F.lit(fence) * (F.col("p90") - F.col("p50")), F.lit(fence) * (F.col("p50") - F.col("p10"))
    limits = F.struct((F.col("p10") - F.greatest(below, "least")).alias("low"), (F.col("p90") + F.greatest(above, "least")).alias("high"))
    return rows.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("stat", limits))).alias("limits"),
        F.sort_array(F.collect_list(F.when(above > F.col("least"), F.col("stat")))).alias("decided"),
    )


def measure(docs: DataFrame) -> DataFrame:
    """``statistics`` with ``base_failed`` and the judged ``rates``."""
    found = statistics(docs)
    return found.withColumns(
        {"base_failed": base_failed(F.col("base")), "rates": F.struct(*[c.alias(k) for k, c in rates(F.col("base")).items()])}
    )


def limits_of(spark: SparkSession, measured: DataFrame, *, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """``thresholds`` of the rows that pass the base rule, stored (one row per group)."""
    passing = measured.where(~F.col("base_failed")).select("lang", "source", "rates")
    return stored(spark, thresholds(passing, fence=fence, min_rows=min_rows), "quality_limits")


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``failed_rule`` (the first broken rule, or null) and ``kept``.

    The limits are broadcast when they are at most ``BROADCAST_GROUPS`` rows of under 1 KB (counted
    here); beyond that they are joined by (lang, source), where AQE splits hot groups.
    """
    side = limits.select(F.col("lang").alias("l_lang"), F.col("source").alias("l_source"), "limits")
    if limits.count() <= BROADCAST_GROUPS:
        side = F.broadcast(side)
    same = F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source"))
    broken = F.array(
        *[F.when(~F.col(f"rates.{s}").between(F.col("limits")[s]["low"], F.col("limits")[s]["high"]), F.lit(s)) for s in JUDGED]
    )
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.get(F.array_compact(broken), F.lit(0)))
    return (
        measured.join(side, same, "left")
        .select("row", "lang", "source", "base", "base_failed", "rates", failed.alias("failed_rule"))
        .withColumn("kept", F.col("failed_rule").isNull())
    )


def filter_documents(spark: SparkSession, docs: DataFrame, *, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that pass, with their own columns. The statistics are computed twice, for the
    sketches and for the verdicts: that costs a second read of the texts but no shuffle of them."""
    needed = [c for c in ("lang", "source", "text") if c in docs.columns]
    limits = limits_of(spark, measure(docs.select(*needed)).drop("row"), fence=fence, min_rows=min_rows)
    return verdicts(measure(docs), limits).where("kept").select("row.*")
