"""Toxicity scores from two class-conditional Kneser-Ney models that share their backoff counts.

Words are runs of letters, digits, apostrophes and non-ASCII bytes, lower-cased A-Z, coded by 32 bits. Counts n are
numbers of training documents (a long or repetitive one counts once), n_c those of class c (toxic or ordinary).
Words of at least ``LEAST_COUNT`` documents are known, whatever the corpus. An unknown word is an event of its stem (its
first ``STEM_BYTES`` bytes, if in enough documents), or the one event of all others.

An expression's class share starts from the share it backs off to, with K pseudo-counts (pair to word, word to
stem, stem to the class's share of all documents):

    c(x) = (n_c(x) + K * c(below x)) / (n(x) + K)

and is that lower share itself unless it raises the likelihood of the expression's counts by half the logarithm of
the number of training documents (what one more parameter has to pay by the Bayesian information criterion: 4 nats for
2,500 documents, 7.5 for 3 million). Pairs of at least ``LEAST_COUNT`` documents are known if they have such a share of
their own; the others are pruned from both models, their mass goes to the backoff. So each class has smoothed counts n(x) c(x) that add up to the shared ones.
Each class's models are interpolated Kneser-Ney on these (discount D; s(e): shared continuation share, the
different words before e among all such pairs), and normalised for each class and each word before:

    P_c(e)   = (n(e) - D) c(e) / N_c + G_c / N_c * s(e)           N_c = sum n(e) c(e), G_c = sum D c(e)
    P_c(v|u) = (n(u,v) - D) c(u,v) / N_c(u) + l_c(u) P_c(v)       for known pairs; l_c(u) P_c(v) for others

with N_c(u) the smoothed counts of u's known pairs and c(u) times its other ones, and l_c(u) what is left to 1.

A text's evidence is log P_toxic - log P_ordinary, summed over its words (and its end, which always backs off).
This sum falls apart into one weight per stem, per known word (beyond its stem's) and per known pair (beyond its
words'), in steps of 1 / ``STEPS`` nat; only weights that differ from zero are kept. A logistic curve over the
length-normalised evidence (per word, and per square root of words) is fitted on a fold that the counts have not
seen (a sample of at most ``MAX_CALIBRATION_ROWS``). The counts use all other labelled training rows.

Plan. Counting is one pass with partial sums by expression; the models are joins and sums of the counted table. To
score, a pass over the texts collects postings (expression, documents) of containers of ``SLOTS`` documents, where a
bit map of bounded size drops most expressions without a weight; postings meet the weights in tasks by bucket and
slice of containers, and their sums are added up per document. No vocabulary or table of pairs goes to the driver or
to all workers.

Training reads folds 1 to 4 only (fold 0 is held out). Texts alone are scored.

Defined results: null and empty texts have no evidence and get the curve's value at zero; null labels train
nothing; several labels of one doc_id count as toxic if any is; without labels of both classes every score
is 0; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import textops as T
from logloom.llm.shared import TEST_FOLD, fold, partitions, stored

LEAST_COUNT = 3
DISCOUNT = 0.75
SHARED_COUNTS = 10.0
STEM_BYTES = 4
STEPS = 16
CALIBRATION_FOLD = 1
MAX_CALIBRATION_ROWS = 20_000
#: Labels (16 bytes each) up to which they are broadcast to the texts; beyond it both are shuffled.
BROADCAST_LABELS = 1_000_000
#: Documents of a container, links held before it is closed, buckets of its postings, entries for one task.
SLOTS, HELD, BUCKETS, TASK_ENTRIES = 1 << 12, 1 << 22, 16, 1 << 22
#: Bits of the map of weighted expressions: so many for each, between these bounds (128 KB and 128 MB).
MAP_BITS_EACH, LEAST_MAP_BITS, MOST_MAP_BITS = 16, 20, 30
#: What stands before a word code: nothing (a word), a stem's mark, the start of a text, another word.
WORD, STEM, START, FIRST_CODE = 0, 1, 2, 3

_CODES = T.fold_table(lower=True)
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False


def _code(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % ((1 << 31) - FIRST_CODE) + FIRST_CODE


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Per chunk of rows: codes of words and of their stems (0 for words that are no longer), the bounds
    of each text's words, first row, last row."""
    data, offsets = T.string_buffers(texts)
    for i, j in T.chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, bounds = T.word_spans(part, offsets[i : j + 1] - offsets[i], _SEPARATORS)
        cut = np.minimum(ends, starts + STEM_BYTES)
        both = T.span_hashes(part, np.concatenate([starts, starts]), np.concatenate([ends, cut]), _CODES)
        yield _code(both[: len(starts)]), np.where(ends > cut, _code(both[len(starts) :]), 0), bounds, i, j


def _expressions(words: np.ndarray, stems: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expression, stem of a word or 0, text) of all words, stems and pairs; the first word of a text
    stands behind START."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = START
    long = stems != 0
    none = np.zeros(len(words) + int(long.sum()), np.int64)
    return np.concatenate([words, before << 32 | words, STEM << 32 | stems[long]]), np.concatenate([stems, none]), np.concatenate([text, text, text[long]])


def _counted(rows: DataFrame) -> DataFrame:
    """(code, stem, n0, n1): documents of each class that hold an expression (and a word's stem). Each
    batch is summed before it leaves the task, each task again before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            found = []
            for words, stems, bounds, i, _ in _words(batch.column("text")):
                code, stem, text = _expressions(words, stems, bounds)
                order = np.lexsort((text, code))
                code, stem, text = code[order], stem[order], text[order] + i
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
                found.append(np.stack([code[new], stem[new], toxic[text[new]]]))
            code, stem, label = np.concatenate([*found, np.zeros((3, 0), np.int64)], 1)
            distinct, first, inverse, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            n1 = np.bincount(inverse, label, len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (distinct, stem[first], n - n1, n1)], ["code", "stem", "n0", "n1"])

    parts = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "code long, stem long, n0 long, n1 long")
    return parts.groupBy("code").agg(F.max("stem").alias("stem"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _share(n0: Column, n1: Column, below: Column, least_gain: float) -> Column:
    """The toxic share of counts, smoothed towards ``below``; ``below`` itself where that loses less than
    ``least_gain``."""
    n = n0 + n1
    gain = F.when(n1 > 0, n1 * F.log(n1 / n / below)).otherwise(0.0) + F.when(n0 > 0, n0 * F.log(n0 / n / (1 - below))).otherwise(0.0)
    return F.when(gain >= least_gain, (n1 + SHARED_COUNTS * below) / (n + SHARED_COUNTS)).otherwise(below)


@dataclass(frozen=True)
class Tables:
    """The models: ``events`` (event, kind, n, c, p0, p1, base: log ratio of the event it stands on),
    ``pairs`` (u, v, n, c, p0, p1: P_c(v|u)), ``contexts`` (u, l0, l1), the log ratio of the event of all other words
    and that of the START context's backoff."""

    events: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    other: float
    start: float


def tables(spark: SparkSession, raw: DataFrame, n_docs: int, n_toxic: int) -> Tables:
    """The formulas of the module text over counted expressions ``raw`` (code, stem, n0, n1) of ``n_docs``
    documents, ``n_toxic`` of them toxic."""
    toxic_share, least_gain = n_toxic / n_docs, 0.5 * float(np.log(n_docs))
    n, context = F.col("n0") + F.col("n1"), F.shiftright("code", 32)
    raw = raw.select(context.alias("u"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("v"), "stem", "n0", "n1", n.alias("n"))
    prior = F.lit(toxic_share)
    stems = raw.where((F.col("u") == STEM) & (F.col("n") >= LEAST_COUNT)).select(F.col("v").alias("stem"), _share(F.col("n0"), F.col("n1"), prior, least_gain).alias("stem_c"))
    before = raw.where(F.col("u") >= START).groupBy("v").agg(F.count("u").alias("before"))
    words = raw.where(F.col("u") == WORD).drop("u").join(stems, "stem", "left").join(before, "v", "left")
    below = F.coalesce("stem_c", prior)
    known = F.col("n") >= LEAST_COUNT
    words = words.select(
        F.when(known, "word").when(F.col("stem_c").isNotNull(), "stem").otherwise("other").alias("kind"),
        F.when(known, F.col("v")).when(F.col("stem_c").isNotNull(), F.col("stem")).otherwise(0).alias("event"),
        F.when(F.col("stem_c").isNotNull(), F.col("stem")).otherwise(0).alias("on"),
        F.when(known, _share(F.col("n0"), F.col("n1"), below, least_gain)).otherwise(below).alias("c"), "n", F.coalesce("before", F.lit(0)).alias("before"),
    )
    # Stems and the event of all others are events even if no unknown word was met: of count 1.
    extra = stems.select(F.lit("stem").alias("kind"), F.col("stem").alias("event"), F.lit(0).alias("on"), F.col("stem_c").alias("c"), F.lit(1).alias("n"), F.lit(1).alias("before"))
    last = spark.range(1).select(F.lit("other").alias("kind"), F.lit(0).alias("event"), F.lit(0).alias("on"), prior.alias("c"), F.lit(1).alias("n"), F.lit(1).alias("before"))
    events = words.unionByName(extra).unionByName(last).groupBy("kind", "event").agg(F.max("on").alias("on"), F.max("c").alias("c"), F.sum("n").alias("n"), F.sum("before").alias("before"))
    events = stored(spark, events, "toxic_events")
    one, zero = F.col("c"), 1 - F.col("c")
    sums = events.agg(F.sum(F.col("n") * one), F.sum(F.col("n") * zero), F.sum(DISCOUNT * one), F.sum(DISCOUNT * zero), F.sum("before")).first()
    m1, m0, g1, g0, all_before = map(float, sums)
    own, cont = F.col("n") - DISCOUNT, F.col("before") / all_before
    events = events.withColumns({"p1": own * one / m1 + g1 / m1 * cont, "p0": own * zero / m0 + g0 / m0 * cont})
    events = events.withColumn("ratio", F.log("p1") - F.log("p0"))
    other = events.where("kind = 'other'").first()["ratio"]
    base = events.where("kind = 'stem'").select(F.col("event").alias("on"), F.col("ratio").alias("base"))
    on = F.when(F.col("kind") == "word", F.col("on")).otherwise(-1)
    events = events.withColumn("on", on).join(base, "on", "left")
    events = stored(spark, events.withColumn("base", F.when(F.col("kind") == "other", 0.0).otherwise(F.coalesce("base", F.lit(other)))), "toxic_events")

    of_v = events.where("kind = 'word'").select(F.col("event").alias("v"), F.col("c").alias("c_v"), "p0", "p1")
    pairs = raw.where((F.col("u") >= START) & (F.col("n") >= LEAST_COUNT)).select("u", "v", "n0", "n1", "n").join(of_v, "v")
    pairs = pairs.select("u", "v", "n", _share(F.col("n0"), F.col("n1"), F.col("c_v"), least_gain).alias("c"), "c_v", "p0", "p1")
    pairs = stored(spark, pairs.where(F.col("c") != F.col("c_v")).drop("c_v"), "toxic_pairs")
    kept = F.col("n") - DISCOUNT
    sums = {"a": F.col("n"), "a1": F.col("n") * one, "a0": F.col("n") * zero, "b1": kept * one, "b0": kept * zero}
    by_u = pairs.groupBy("u").agg(*[F.sum(x).alias(k) for k, x in sums.items()])
    every = raw.where(F.col("u") >= START).groupBy("u").agg(F.sum("n").alias("every"))
    of_u = events.where("kind = 'word'").select(F.col("event").alias("u"), F.col("c").alias("c_u"))
    contexts = by_u.join(every, "u").join(of_u, "u", "left").withColumns({"rest": F.col("every") - F.col("a"), "c_u": F.coalesce("c_u", prior)})
    contexts = contexts.withColumns({"m1": F.col("a1") + F.col("rest") * F.col("c_u"), "m0": F.col("a0") + F.col("rest") * (1 - F.col("c_u"))})
    contexts = contexts.select("u", "m0", "m1", (1 - F.col("b0") / F.col("m0")).alias("l0"), (1 - F.col("b1") / F.col("m1")).alias("l1"))
    contexts = stored(spark, contexts, "toxic_contexts")
    pairs = pairs.join(contexts, "u").withColumns({"q1": F.col("p1"), "q0": F.col("p0")})
    pairs = pairs.withColumns({"p1": kept * one / F.col("m1") + F.col("l1") * F.col("q1"), "p0": kept * zero / F.col("m0") + F.col("l0") * F.col("q0")})
    start = contexts.where(F.col("u") == START).first()
    return Tables(events, pairs, contexts, other, float(np.log(start["l1"] / start["l0"])) if start else 0.0)


def weights(found: Tables) -> DataFrame:
    """(code, weight) of all expressions whose weight is not zero, in steps of 1 / STEPS nat."""
    left = found.contexts.select(F.col("u").alias("event"), (F.log("l1") - F.log("l0")).alias("left"))
    single = found.events.where("kind <> 'other'").join(left, "event", "left")
    own = F.col("ratio") - F.col("base") + F.when(F.col("kind") == "word", F.coalesce("left", F.lit(0.0))).otherwise(0.0)
    code = F.when(F.col("kind") == "word", F.col("event")).otherwise(F.col("event").bitwiseOR(F.lit(STEM << 32)))
    single = single.select(code.alias("code"), own.alias("w"))
    # What a pair adds to its words' weights.
    own = F.log(F.col("p1") / (F.col("l1") * F.col("q1"))) - F.log(F.col("p0") / (F.col("l0") * F.col("q0")))
    pairs = found.pairs.select(F.shiftleft("u", 32).bitwiseOR(F.col("v")).alias("code"), own.alias("w"))
    every = single.unionByName(pairs).select("code", F.round(F.col("w") * STEPS).cast("long").alias("weight"))
    return every.where("weight <> 0")


@dataclass(frozen=True)
class Model:
    """Weights of expressions (None without labels of both classes), a word's and a text's own share of the
    evidence, the map of the weighted expressions, and the curve."""

    weights: DataFrame | None
    other: float
    start: float
    bits: np.ndarray
    curve: np.ndarray


def _places(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each code in the map."""
    hashed = T.mix(codes.astype(np.uint64))
    return (hashed >> np.uint64(64 - bits)).astype(np.int64), (hashed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _map_of(found: DataFrame) -> np.ndarray:
    """The bit map of the codes of ``found``: each batch is summed up before it leaves the task."""
    bits = int(np.clip(np.ceil(np.log2(max(found.count(), 1) * MAP_BITS_EACH)), LEAST_MAP_BITS, MOST_MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(_places(batch.column("code").to_numpy(), bits)))
            word, first = np.unique(place >> 6, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (place & 63), first) if len(place) else place)], ["w", "b"])

    rows = found.select("code").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def _in_map(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(codes), bool)
    for place in _places(codes, len(bits).bit_length() + 5):
        found &= ((bits[place >> 6] >> (place & 63)) & 1).astype(bool)
    return found


def _inputs(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.column_stack([evidence / n, evidence / np.sqrt(n), np.ones(len(n))])


def _curve(evidence: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(evidence, n) @ weights, -30, 30)))


def fit_curve(evidence: np.ndarray, n: np.ndarray, label: np.ndarray, *, l2: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Logistic regression by damped Newton steps, inputs scaled to unit spread."""
    x = _inputs(evidence, n)
    scale = np.append(np.maximum(x[:, :2].std(0), 1e-9), 1.0)
    x = x / scale
    w = np.zeros(3)
    w[2] = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - label * z) + l2 * (w @ w) / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(3), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w / scale


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, text, label, fold) of the labelled rows outside the held-out fold."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold() != TEST_FOLD))
        .groupBy("doc_id")
        .agg((F.max(column) > 0).cast("int").alias("label"))
        .withColumn("fold", fold())
    )
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id")


def _sampled(rows: DataFrame) -> Column:
    """Whether a row is of the curve's sample: at most about MAX_CALIBRATION_ROWS rows of the
    calibration fold, by hash of doc_id."""
    own = F.col("fold") == CALIBRATION_FOLD
    n = rows.where(own).count()
    bound = int(2**31 * min(1.0, MAX_CALIBRATION_ROWS / max(n, 1)))
    return own & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2**31)) < bound)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, column: str = "toxic") -> Model:
    """Both models and the curve."""
    nothing = Model(None, 0.0, 0.0, np.zeros(1, np.int64), np.array([0.0, 0.0, -30.0]))
    rows = labelled(docs, labels, column)
    sampled = _sampled(rows)
    counted = rows.where(~sampled)
    classes = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}  # two rows
    if len(classes) < 2:
        return nothing
    raw = stored(spark, _counted(counted), "toxic_counts")
    found = tables(spark, raw, classes[0] + classes[1], classes[1])
    given = stored(spark, weights(found), "toxic_weights")
    model = replace(nothing, weights=given, other=found.other, start=found.start, bits=_map_of(given))
    seen = evidence(rows.where(sampled), model, "label").toArrow().to_pandas().sort_values(["doc_id", "evidence", "n"], kind="stable")
    label = seen["label"].to_numpy(float)
    if not len(label) or label.min() == label.max():
        return nothing
    return replace(model, curve=fit_curve(seen["evidence"].to_numpy(float), seen["n"].to_numpy(float), label))


ROW = pa.schema([
    ("container", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("carried", pa.int32()), ("n", pa.int64()),
    ("bucket", pa.int32()), ("n_entries", pa.int64()), ("codes", pa.binary()), ("sizes", pa.binary()), ("slots", pa.binary()), ("times", pa.binary()),
])
FIELDS = "container long, slot int, doc_id long, carried int, n long, bucket int, n_entries long, codes binary, sizes binary, slots binary, times binary"


def _postings(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row per document (``slot`` set) and the postings of each container by bucket (``bucket`` set)."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container, slots, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            code, slot = np.concatenate([*held, np.zeros((2, 0), np.int64)], 1)
            code = code % BUCKETS << 59 | code // BUCKETS  # buckets one behind the other
            key, times = _pairs_of(code, slot)
            bounds = np.searchsorted(key[0] >> 59, np.arange(BUCKETS + 1))
            out = []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a < b:
                    own = (key[0, a:b] & (1 << 59) - 1) * BUCKETS + k
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    out.append({
                        "container": container, "bucket": k, "n_entries": b - a, "codes": own[first].tobytes(), "sizes": np.diff(first, append=b - a).astype("<u2").tobytes(),
                        "slots": key[1, a:b].astype("<u2").tobytes(), "times": times[a:b].astype("<u4").tobytes(),
                    })
            return pa.RecordBatch.from_pylist(out, ROW)

        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                if slots + len(part) > SLOTS or size > HELD:
                    yield close()
                    container, slots, size, held = container + 1, 0, 0, []
                n = np.zeros(len(part), np.int64)
                for words, stems, bounds, a, b in _words(part.column("text")):
                    n[a:b] = np.diff(bounds)
                    code, _, text = _expressions(words, stems, bounds)
                    hit = _in_map(code, shared.value)
                    held.append(np.stack([code[hit], text[hit] + a + slots]))
                    size += int(hit.sum())
                columns = [pa.array([container] * len(part), pa.int64()), pa.array(np.arange(slots, slots + len(part)), pa.int32()), part.column("doc_id"), part.column("carried"), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(part), f.type) for f in list(ROW)[5:]]], schema=ROW)
                slots += len(part)
        if slots:
            yield close()

    return rows.mapInArrow(run, FIELDS)


def _pairs_of(code: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (code, slot) in order, and how often each occurs."""
    order = np.lexsort((slot, code))
    code, slot = code[order], slot[order]
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0))
    return np.stack([code[first], slot[first]]), np.diff(first, append=len(code))


def evidence(docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """doc_id, ``carry`` (an int column), evidence and number of words (n) of every row."""
    spark = docs.sparkSession
    carried = F.col(carry).cast("int") if carry else F.lit(None).cast("int")
    found = _postings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("carried")), model.bits)
    found = stored(spark, found, "toxic_postings")
    slices = 1 + (found.agg(F.sum("n_entries")).first()[0] or 0) // (BUCKETS * TASK_ENTRIES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, table = None, [], None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "is_posting")), strict=True))
            i = 0
            while i < len(rows):
                if rows[i][:2] != at:
                    at, known, table = rows[i][:2], [], None
                if not rows[i][2]:
                    j = i
                    while j < len(rows) and not rows[j][2] and rows[j][:2] == at:
                        j += 1
                    known.append([batch.column(c).slice(i, j - i).to_numpy() for c in ("code", "weight")])
                    i = j
                    continue
                if table is None:
                    code, weight = (np.concatenate(c) for c in zip(*known, strict=True)) if known else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
                    order = np.argsort(code)
                    table = code[order], weight[order]
                row = batch.slice(i, 1).to_pylist()[0]
                code = np.frombuffer(row["codes"], np.int64)
                place = np.minimum(np.searchsorted(table[0], code), len(table[0]) - 1)
                weight = np.where(table[0][place] == code, table[1][place], 0)
                total = np.zeros(SLOTS, np.int64)
                np.add.at(total, np.frombuffer(row["slots"], "<u2"), np.repeat(weight, np.frombuffer(row["sizes"], "<u2")) * np.frombuffer(row["times"], "<u4"))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["container"])), pa.array(some, pa.int32()), pa.array(total[some])], ["container", "slot", "steps"])
                i += 1

    own = found.where(F.col("slot").isNotNull()).select("container", "slot", "doc_id", "carried", "n")
    sent = found.where(F.col("bucket").isNotNull()).select(
        "bucket", F.pmod(F.xxhash64("container"), F.lit(slices)).cast("int").alias("slice"), F.lit(True).alias("is_posting"), "container", "codes", "sizes", "slots", "times"
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    given = model.weights if model.weights is not None else spark.createDataFrame([], "code long, weight long")
    given = given.select(F.pmod("code", F.lit(BUCKETS)).cast("int").alias("bucket"), every, F.lit(False).alias("is_posting"), "code", "weight")
    both = given.unionByName(sent, allowMissingColumns=True).repartition(max(partitions(spark), BUCKETS * slices), "bucket", "slice")
    sums = both.sortWithinPartitions("bucket", "slice", "is_posting").mapInArrow(add, "container long, slot int, steps long")
    sums = sums.groupBy("container", "slot").agg(F.sum("steps").alias("steps"))
    total = F.coalesce("steps", F.lit(0)) / F.lit(float(STEPS)) + F.col("n") * F.lit(model.other) + F.when(F.col("n") > 0, F.lit(model.start)).otherwise(0.0)
    found = own.join(sums, ["container", "slot"], "left").withColumn("evidence", total)
    return found.select("doc_id", *([F.col("carried").alias(carry)] if carry else []), "evidence", "n")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the log-likelihood ratio per word (0 without words) of every row."""
    a, b, constant = map(float, model.curve)
    n = F.greatest("n", F.lit(1))
    z = F.col("evidence") / n * a + F.col("evidence") / F.sqrt(n) * b + constant
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    return evidence(docs, model).select("doc_id", score.alias("score"), (F.col("evidence") / n).alias("log_ratio_per_word"))
