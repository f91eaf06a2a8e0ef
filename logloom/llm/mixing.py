"""Mixing sources to target weights: raking by iterative proportional fitting, then sampling.

Documents fall into cells (source, language, topic). Cell token sums are raked until their source,
language and topic marginals equal the targets; a document of a cell is then kept with the probability
that makes the expected tokens of the sample follow the raked weights at the wanted size.

A target is either an exponent (share ** exponent of the tokens, so values under 1 flatten a hot
category) or explicit shares (unnamed categories split what is left by their tokens). Targets of
categories without tokens are dropped and the others rescaled.

A probability cannot exceed 1, so at a large sample size the raked weights of lifted cells cannot be reached. The
weights are therefore raked again with the bound tokens / sample tokens on every cell (what a bounded cell
cannot take, the others of its categories take), at the largest size, up to ``budget_share``, at which all
marginals still come out: the sample then meets its targets in expectation, whatever the budget.

Cells and marginals stay in Spark whatever their number (documents collapse to cells by partial sums
before any shuffle; the windows over a category hold cells, not documents); every few cycles they are
written to the shared folder, and only the largest deviation and the size (one number each) reach the driver.

Defined results: null text has no tokens; null source, language or topic is a category of its own;
a cell without tokens has probability 0 and its documents stay (they weigh nothing); repeated rows are
drawn together; a null doc_id is drawn by its text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import stored

DIMENSIONS = ("source", "lang", "topic")
#: Production targets: flatten sources and languages, keep topics near their shares.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.7, "lang": 0.8, "topic": 0.9}
BUDGET_SHARE = 0.9
TOLERANCE = 1e-6
CYCLES_PER_ROUND, MAX_ROUNDS = 4, 25
#: Bounded raking: deviation allowed, factor of the next smaller size, and what a round must at least gain.
BOUND_TOLERANCE, SMALLER, LEAST_PROGRESS, MAX_BOUND_ROUNDS = 1e-3, 0.97, 0.7, 80
BROADCAST_CELLS = 20_000
SEED = 2024


def topic_of(text: Column) -> Column:
    """A topic by the form of the text; pass another expression for a topic model's output."""
    return (
        F.when(text.contains(" | "), F.lit("tabular"))
        .when(text.rlike("(?i)licen[sc]e"), F.lit("licensed"))
        .when(F.length(text) < 600, F.lit("note"))
        .when(F.length(text) >= 8000, F.lit("longform"))
        .otherwise(F.lit("article"))
    )


def _category(column: Column) -> Column:
    """A join key that tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def measured(docs: DataFrame, *, topic: Column | None = None) -> DataFrame:
    """``row`` (all columns as one struct), the cell (c_source, c_lang, c_topic), n_tokens, draw."""
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in names else F.lit("")

    def of(name: str) -> Column:
        return F.col(name) if name in names else F.lit(None).cast("string")

    if "doc_id" in names:
        hashed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(SEED), text)).otherwise(F.xxhash64(F.lit(SEED), F.col("doc_id")))
    else:
        hashed = F.xxhash64(F.lit(SEED), text)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        _category(of("source")).alias("c_source"),
        _category(of("lang")).alias("c_lang"),
        _category(topic if topic is not None else topic_of(text)).alias("c_topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        (F.shiftrightunsigned(hashed, 11) * F.lit(2.0**-53)).alias("draw"),
    )


def _marginal(cells: DataFrame, name: str, target: float | dict[str, float]) -> DataFrame:
    """(c_<name>, share): the target share of each category that has tokens; shares sum to 1."""
    key = f"c_{name}"
    sums = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    if isinstance(target, dict):
        named = F.create_map(*[F.lit(x) for k, v in target.items() for x in (f"={k}", float(v))])
        given = F.element_at(named, F.col(key)) if target else F.lit(None).cast("double")
        left = max(0.0, 1.0 - sum(target.values()))
        rows = sums.select(key, given.alias("given"), F.when(given.isNull(), F.col("t")).otherwise(0.0).alias("free"))
        free = rows.agg(F.sum("free").alias("all_free"))
        raw = rows.crossJoin(F.broadcast(free)).select(key, F.coalesce("given", left * F.col("free") / F.greatest("all_free", F.lit(1.0))).alias("raw"))
    else:
        raw = sums.select(key, F.pow("t", F.lit(float(target))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))  # one row
    return raw.crossJoin(F.broadcast(total)).select(key, (F.col("raw") / F.col("total")).alias("share")).where("share > 0")


def rake(spark: SparkSession, cells: DataFrame, targets: dict[str, float | dict[str, float]]) -> DataFrame:
    """``cells`` (c_*, tokens > 0) with ``weight``: shares of 1 whose marginals are the targets (as
    near as the cells allow: after ``MAX_ROUNDS`` rounds the last weights are taken)."""
    keys = [f"c_{name}" for name in DIMENSIONS]
    weights = cells.select(*keys, "tokens", F.col("tokens").cast("double").alias("weight"))
    for name, target in targets.items():
        marginal = _marginal(cells, name, target).withColumnRenamed("share", f"share_{name}")
        weights = weights.join(marginal, f"c_{name}", "left")
    weights = stored(spark, weights.fillna(0.0, [f"share_{name}" for name in targets]), "raked")

    def now(name: str) -> Column:
        return F.sum("weight").over(Window.partitionBy(f"c_{name}"))

    for _ in range(MAX_ROUNDS):
        for _ in range(CYCLES_PER_ROUND):
            for name in targets:
                weights = weights.withColumn("weight", F.try_divide(F.col("weight") * F.col(f"share_{name}"), now(name)))
        weights = stored(spark, weights.fillna(0.0, ["weight"]), "raked")
        off = weights.withColumns({f"off_{name}": F.abs(F.try_divide(now(name), F.col(f"share_{name}")) - 1) for name in targets})
        worst = off.agg(F.max(F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"off_{name}") for name in targets]))).first()[0]  # one number
        if worst is None or worst <= TOLERANCE:
            break
    return weights.select(*keys, "tokens", "weight")


def bounded(spark: SparkSession, weights: DataFrame, budget_share: float, names: tuple[str, ...] = DIMENSIONS) -> tuple[DataFrame, float]:
    """``weights`` raked again to their own marginals with no cell above its tokens at the returned
    sample size (a share of all tokens, at most ``budget_share``)."""
    total = weights.agg(F.sum("tokens").cast("double").alias("t"), F.sum("weight").alias("w")).first()
    if not total["t"] or not total["w"]:
        return weights, 0.0

    def of(name: str, column: str) -> Column:
        return F.sum(column).over(Window.partitionBy(f"c_{name}"))

    rows = weights.withColumn("weight", F.col("weight") / total["w"])
    rows = stored(spark, rows.withColumns({f"share_{name}": of(name, "weight") for name in names}), "raked")
    # No category can give more tokens than it has.
    sizes = [rows.groupBy(f"c_{name}").agg((F.sum("tokens") / total["t"]).alias("have"), F.sum("weight").alias("want")).where("want > 0").agg(F.min(F.col("have") / F.col("want"))).first()[0] for name in names]
    size, before = min([budget_share, *[x for x in sizes if x is not None]]), None
    for _ in range(MAX_BOUND_ROUNDS):
        cap = F.col("tokens") / F.lit(total["t"] * size)
        for _ in range(CYCLES_PER_ROUND):
            for name in names:
                rows = rows.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"share_{name}"), of(name, "weight")), F.lit(0.0)))
                rows = rows.withColumn("weight", F.least("weight", cap))
        rows = stored(spark, rows, "raked")
        off = rows.withColumns({f"off_{name}": F.abs(F.try_divide(of(name, "weight"), F.col(f"share_{name}")) - 1) for name in names})
        worst = off.agg(F.max(F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"off_{name}") for name in names]))).first()[0]
        if worst <= BOUND_TOLERANCE:
            break
        if before is not None and worst > LEAST_PROGRESS * before:
            size, worst = size * SMALLER, None
        before = worst
    return rows.select(*weights.columns), size


def probabilities(weights: DataFrame, size: float) -> DataFrame:
    """``weights`` with ``lift`` (weight over tokens) and ``probability``: what makes the expected tokens of
    each cell its weight's part of a sample of ``size`` of all tokens."""
    total = weights.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    lifted = weights.withColumn("lift", F.col("weight") / F.col("tokens"))
    if not total["t"] or not total["w"]:
        return lifted.withColumn("probability", F.lit(0.0))
    scale = size * total["t"] / total["w"]
    return lifted.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("lift") * scale), 9))


def cell_probabilities(
    spark: SparkSession, rows: DataFrame, *, targets: dict[str, float | dict[str, float]] | None = None, budget_share: float = BUDGET_SHARE
) -> DataFrame:
    """(c_*, tokens, weight, lift, probability) of the cells of ``rows`` (from ``measured``)."""
    keys = [f"c_{name}" for name in DIMENSIONS]
    cells = stored(spark, rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    weights, size = bounded(spark, rake(spark, cells, TARGETS if targets is None else targets), budget_share)
    return stored(spark, probabilities(weights, size), "probabilities")


def drawn(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with probability, weight (of the cell) and kept. The cells are broadcast when they
    are at most ``BROADCAST_CELLS`` (counted here), else joined by cell."""
    keys = [f"c_{name}" for name in DIMENSIONS]
    side = cells.select(*keys, "weight", "probability")
    side = F.broadcast(side) if cells.count() <= BROADCAST_CELLS else side
    kept = (F.col("n_tokens") == 0) | (F.col("draw") < F.coalesce("probability", F.lit(0.0)))
    return rows.join(side, keys, "left").withColumn("kept", kept)


def sample_documents(
    spark: SparkSession, docs: DataFrame, *, targets: dict[str, float | dict[str, float]] | None = None, budget_share: float = BUDGET_SHARE, topic: Column | None = None
) -> DataFrame:
    """The sampled documents, with their own columns. The texts are read twice and never shuffled."""
    rows = measured(docs, topic=topic)
    cells = cell_probabilities(spark, rows.drop("row", "draw"), targets=targets, budget_share=budget_share)
    return drawn(rows, cells).where("kept").select("row.*")
