"""Links between the tokens of two tokenizers, scored by inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A, of a space and the text) and a piece model (B, which adds
that space itself). Byte offsets where tokens of both end cut them into groups; an A and a B token whose
byte ranges overlap are linked. A pair of ids counts the documents that hold it linked, and each document's
links are scored with these counts.

Plan.

1. One pass over the texts. Texts are cut into units before single spaces and newlines between other
   characters, where both tokenizers always end a token; a unit's ids, groups and links are worked out once
   per worker (new units of a batch together: one call of each library, overlaps by binary search of the
   token ends) and looked up after that. Documents fill containers of ``SLOTS`` numbers. The links of a
   container become one posting per id pair: a document bitmap, held as a sorted array of numbers where it is
   sparse, and planes with the bits of (multiplicity - 1) of its documents. Parts of a container are merged
   (OR of bitmaps, sum of multiplicities) whenever ``HELD_LINKS`` have come together. Postings of a container
   are written in ``BUCKETS`` rows by A id.
2. Containers hold different documents, so a pair's bitmap over all of them is their concatenation: its
   popcount, the pair's document count, is the sum of theirs (first inside tasks, then by Spark).
3. Postings return scores: tasks by (bucket, slice of the containers) read the counts of their bucket's pairs,
   then unpack posting after posting and add its pair's count, times multiplicity, to its documents. Spark adds
   the at most ``BUCKETS`` sums of a document and joins them with the document's own numbers. The number of
   slices grows with the postings, so that neither the counts sent to the slices (at most a share of the
   postings) nor a task's postings grow without bound; a frequent A id is dealt over the slices.

Defined results: texts that are null, empty, or not given back by both tokenizers' bytes (U+2581 in a
text) have no tokens: zeros and an empty digest; special tokens' strings are plain text; every row is a
document, repeated doc_ids included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import partitions, stored
from logloom.llm.textops import runs

SLOTS = 1 << 12
BUCKETS = 32
HELD_LINKS = 1 << 22
#: A worker remembers the first units it meets, so many or so many links of them; later ones are worked out
#: for each batch of texts anew (frequent units come early).
CACHE_UNITS, CACHE_LINKS = 600_000, 6_000_000
#: Entries of the postings for one task, and at least so many per count sent to a slice.
TASK_ENTRIES, ENTRIES_PER_COUNT = 1 << 22, 32
#: A bitmap with at least one document in so many is held as bits, else as numbers.
SPARSE = 16
WEIGHT_BITS = 14

_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
_MARK = "▁"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both libraries, and the bytes of every id."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        code = byte_of_char()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(code[c] for c in name) for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.n_b = len(pieces)
        self.a_names = [str(i) for i in range(len(names))]
        self.b_names = [str(i) for i in range(self.n_b)]

    def encode(self, text: str, *, first: bool = True) -> tuple[list[int], list[int]] | None:
        """Ids of a space and ``text`` (of ``text`` alone unless ``first``: it then starts with a newline
        inside a longer text); None if they do not give back these bytes."""
        a = self.a.encode(" " + text if first else text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        if not first:
            if not b or self.b_bytes[b[0]] != b" ":
                return None
            b = b[1:]
        whole = (" " + text if first else text).encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return a, b


def pair_code(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of an id pair, and its number inside the bucket."""
    return a % BUCKETS, a // BUCKETS * n_b + b


class Lexicon:
    """What a worker knows about units: counts, group text and links of each.

    A unit is named by its text without the leading space; a name with a leading newline is a unit that
    follows another one, a name with a leading space is a text's first unit that itself starts with white
    space.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[bytes | None] = []
        self.numbers = np.zeros((4, 1024), np.int64)  # tokens of A, tokens of B, groups, links
        self.links = np.zeros(1 << 14, np.int64)  # bucket and pair number of every link, unit by unit
        self.start = np.zeros(1025, np.int64)
        self.fixed = -1  # units remembered, once there are enough

    def room(self) -> None:
        """Called between batches of texts: beyond the remembered units all are forgotten."""
        if self.fixed < 0 and (len(self.text) > CACHE_UNITS or self.start[len(self.text)] > CACHE_LINKS):
            self.fixed = len(self.text)
        if 0 <= self.fixed < len(self.text):
            for unit in self.passing:
                del self.place[unit]
            del self.text[self.fixed :]
        self.passing: list[str] = []

    def learn(self, units: list[str]) -> None:
        """Adds new units: plain ones by one call over their concatenation."""
        if self.fixed >= 0:
            self.passing += units
        plain = [u for u in units if not u[0] == " " and not u[-1].isspace() and _MARK not in u]
        for i in range(0, len(plain), 8192):
            part = plain[i : i + 8192]
            body = "".join(u if u[0] == "\n" else " " + u for u in part)
            ids = self.t.encode("x" + body)
            if ids is None:  # some unit is not given back: one at a time
                self._each(part)
            else:
                head = [next(k for k in range(len(x)) if len(b"".join([names[y] for y in x[: k + 1]])) == 2) + 1 for x, names in zip(ids, (self.t.a_bytes, self.t.b_bytes), strict=True)]
                sizes = [len(u.encode()) + (u[0] != "\n") for u in part]
                self._add(part, np.array(ids[0][head[0] :], np.int64), np.array(ids[1][head[1] :], np.int64), np.cumsum(sizes))
        known = set(plain)
        self._each([u for u in units if u not in known])

    def _each(self, units: list[str]) -> None:
        for u in units:
            ids = self.t.encode(u[1:] if u[0] == " " else u, first=u[0] != "\n")
            if ids is None:
                self._room_for(1, 0)
                k = len(self.text)
                self.place[u] = k
                self.text.append(None)
                self.numbers[:, k] = 0
                self.start[k + 1] = self.start[k]
            else:
                a, b = (np.array(x, np.int64) for x in ids)
                self._add([u], a, b, np.array([self.t.a_size[a].sum()]))

    def _room_for(self, n: int, n_links: int) -> None:
        k = len(self.text) + n
        if k > self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros((4, max(k, len(self.text))), np.int64)], 1)
            self.start = np.concatenate([self.start, np.zeros(max(k, len(self.text)), np.int64)])
        size = self.start[len(self.text)] + n_links
        if size > len(self.links):
            self.links = np.concatenate([self.links, np.zeros(max(size, len(self.links)), np.int64)])

    def _add(self, units: list[str], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> None:
        """Units whose ids stand one behind the other; ``ends``: their ends in bytes."""
        a_end, b_end = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
        a_at, b_at = np.searchsorted(a_end, ends) + 1, np.searchsorted(b_end, ends) + 1  # tokens up to each unit's end
        if not ((a_end[a_at - 1] == ends).all() and (b_end[b_at - 1] == ends).all()):
            raise ValueError("a token crosses the border of two units")
        cut = np.intersect1d(a_end, b_end, assume_unique=True)
        ga, gb = np.searchsorted(a_end, cut) + 1, np.searchsorted(b_end, cut) + 1
        g_at = np.searchsorted(cut, ends) + 1
        # B tokens that overlap an A token: from the first that ends behind its start to the last that starts before its end.
        first = np.searchsorted(b_end, a_end - self.t.a_size[a], "right")
        last = np.searchsorted(b_end - self.t.b_size[b], a_end, "left")
        token, nth = runs(last - first)
        bucket, number = pair_code(a[token], b[first[token] + nth], self.t.n_b)
        links = (bucket << 40) | number
        l_at = np.cumsum(last - first)[a_at - 1]
        n, k = len(units), len(self.text)
        self._room_for(n, len(links))
        for row, at in enumerate((a_at, b_at, g_at, l_at)):
            self.numbers[row, k : k + n] = np.diff(at, prepend=0)
        base = self.start[k]
        self.links[base : base + len(links)] = links
        self.start[k + 1 : k + n + 1] = base + l_at
        a_names, b_names = list(map(self.t.a_names.__getitem__, a.tolist())), list(map(self.t.b_names.__getitem__, b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(ga.tolist(), gb.tolist(), strict=True):
            groups.append(f"{a_names[i] if x == i + 1 else ','.join(a_names[i:x])}|{b_names[j] if y == j + 1 else ','.join(b_names[j:y])}")
            i, j = x, y
        i = 0
        for u, x in zip(units, g_at.tolist(), strict=True):
            self.place[u] = len(self.text)
            self.text.append(";".join(groups[i:x]).encode())
            i = x


@functools.lru_cache(maxsize=1)
def lexicon(byte_file: str, piece_file: str) -> Lexicon:
    """The worker's memory of units (for the worker's life)."""
    return Lexicon(Tokenizers(byte_file, piece_file))


def units_of(text: str) -> list[str]:
    units = _CUT.split(text)
    if units[0][0].isspace():
        units[0] = " " + units[0]
    return units


# Postings. An entry is (pair, slot, multiplicity); entries are held in one number each, sorted, with the
# pair's bucket in front: bucket (5 bits), pair number in the bucket, slot (12), multiplicity (14).


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Entries of equal pair and slot become one: OR of the bitmaps, sum of multiplicities (in steps that
    fit the field: what is too large stays in further entries of the same pair and slot)."""
    whole = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    key = whole >> WEIGHT_BITS
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return whole
    weight = np.add.reduceat(whole & ((1 << WEIGHT_BITS) - 1), first)
    return _entries(key[first], weight)


def _entries(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    most = (1 << WEIGHT_BITS) - 1
    if len(weight) and weight.max() > most:
        times = -(-weight // most)
        group, nth = runs(times)
        key, weight = key[group], np.minimum(weight[group] - nth * most, most)
    return (key << WEIGHT_BITS) | weight


def _split(entries: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, pair number, slot, multiplicity), every pair and slot once."""
    key = entries >> WEIGHT_BITS
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weight = np.add.reduceat(entries & ((1 << WEIGHT_BITS) - 1), first) if len(first) else np.zeros(0, np.int64)
    bucket, pair = np.divmod(key[first] >> 12, n_pairs)
    return bucket, pair, key[first] & (SLOTS - 1), weight


def pack_postings(pair: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> dict:
    """Postings of sorted entries, as binary columns: pair numbers, array lengths (0: a bitmap), numbers of
    the sparse ones, bits of the others, planes of (multiplicity - 1) over the entries in order."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    size = np.diff(first, append=len(pair))
    dense = size >= SLOTS // SPARSE
    of = np.repeat(np.arange(len(first)), size)
    inside = dense[of]
    bits = np.zeros((int(dense.sum()), SLOTS), bool)
    bits[(np.cumsum(dense) - 1)[of[inside]], slot[inside]] = True
    rest, planes = weight - 1, []
    while rest.any():
        planes.append(np.packbits((rest & 1).astype(bool)).tobytes())
        rest = rest >> 1
    return {
        "pairs": pair[first].astype("<u4").tobytes(),
        "sizes": np.where(dense, 0, size).astype("<u2").tobytes(),
        "sparse": slot[~inside].astype("<u2").tobytes(),
        "dense": np.packbits(bits, axis=1).tobytes(),
        "planes": b"".join(planes),
        "n_entries": len(pair),
    }


def document_counts(pairs: bytes, sizes: bytes, dense: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pair numbers, documents): array lengths, and the popcount of each bitmap."""
    size = np.frombuffer(sizes, "<u2").astype(np.int64)
    bits = np.frombuffer(dense, np.uint64).reshape(-1, SLOTS // 64)
    size[size == 0] = np.bitwise_count(bits).sum(1, dtype=np.int64)
    return np.frombuffer(pairs, "<u4").astype(np.int64), size


def unpack_postings(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair numbers, documents of each, slots of all entries, their multiplicities)."""
    pair, size = document_counts(row["pairs"], row["sizes"], row["dense"])
    inside = np.repeat(np.frombuffer(row["sizes"], "<u2") == 0, size)
    slot = np.empty(len(inside), np.int64)
    slot[~inside] = np.frombuffer(row["sparse"], "<u2")
    bits = np.frombuffer(row["dense"], np.uint8).reshape(-1, SLOTS // 8)
    slot[inside] = np.nonzero(np.unpackbits(bits, axis=1))[1]
    weight = np.ones(len(slot), np.int64)
    width = -(-len(slot) // 8)
    for k in range(len(row["planes"]) // width if width else 0):
        plane = np.frombuffer(row["planes"], np.uint8, width, k * width)
        weight += np.unpackbits(plane, count=len(slot)).astype(np.int64) << k
    return pair, size, slot, weight


ROW = pa.schema([
    ("container", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("n_entries", pa.int64()), ("pairs", pa.binary()), ("sizes", pa.binary()), ("sparse", pa.binary()), ("dense", pa.binary()), ("planes", pa.binary()),
])
FIELDS = (
    "container long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "bucket int, n_entries long, pairs binary, sizes binary, sparse binary, dense binary, planes binary"
)


def link_documents(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Step 1: a row per document (``slot`` set) and the postings of each container (``bucket`` set)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(byte_file, piece_file)
        n_pairs = -(-len(lex.t.a_bytes) // BUCKETS) * lex.t.n_b
        container, slots = TaskContext.get().partitionId() << 32, 0
        held: list[np.ndarray] = []
        size = 0

        def postings() -> pa.RecordBatch:
            bucket, pair, slot, weight = _split(_merged(held), n_pairs)
            bounds = np.searchsorted(bucket, np.arange(BUCKETS + 1))
            rows = []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a < b:
                    rows.append({"container": container, "bucket": k} | pack_postings(pair[a:b], slot[a:b], weight[a:b]))
            return pa.RecordBatch.from_pylist(rows, ROW)

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                if slots + len(part) > SLOTS or size > 2 * HELD_LINKS:
                    yield postings()
                    container, slots, held, size = container + 1, 0, [], 0
                lex.room()
                split = [units_of(t) if t else [] for t in part.column("text").to_pylist()]
                flat = [u for units in split for u in units]
                lex.learn([u for u in dict.fromkeys(flat) if u not in lex.place])
                index = np.fromiter(map(lex.place.__getitem__, flat), np.int64, len(flat))
                ends = np.cumsum([len(units) for units in split])
                whole, sums, digests = [], [], []
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    mine = index[a:b]
                    texts = list(map(lex.text.__getitem__, mine.tolist()))
                    if not texts or None in texts:
                        sums.append(np.zeros(4, np.int64))
                        digests.append("")
                        whole.append(False)
                    else:
                        sums.append(lex.numbers[:, mine].sum(1))
                        digests.append(hashlib.sha256(b";".join(texts)).hexdigest())
                        whole.append(True)
                doc, _ = runs(np.diff(ends, prepend=0))
                some = np.array(whole, bool)[doc]
                key, times = np.unique(doc[some] * len(lex.text) + index[some], return_counts=True)
                doc, unit = np.divmod(key, len(lex.text))
                entry, nth = runs(lex.start[unit + 1] - lex.start[unit])
                link = lex.links[lex.start[unit[entry]] + nth]
                code = (link >> 40) * n_pairs + (link & ((1 << 40) - 1))
                held.append(_entries((code << 12) | (doc[entry] + slots), times[entry]))
                size += len(held[-1])
                if size > HELD_LINKS:
                    held = [_merged(held)]
                    size = len(held[0])
                n = len(part)
                columns = [pa.array([container] * n, pa.int64()), pa.array(np.arange(slots, slots + n), pa.int32()), part.column("doc_id")]
                columns += [pa.array(c) for c in np.stack(sums, 1)] + [pa.array(digests, pa.string())]
                columns += [pa.nulls(n, f.type) for f in list(ROW)[8:]]
                yield pa.RecordBatch.from_arrays(columns, schema=ROW)
                slots += n
        if slots:
            yield postings()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(link, FIELDS)


def pair_counts(postings: DataFrame) -> DataFrame:
    """Step 2: (bucket, pair, n): documents of every id pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, parts in held.items():
                pair, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                n = np.zeros(len(pair), np.int64)
                np.add.at(n, place, np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), bucket), pa.int32()), pa.array(pair), pa.array(n)], ["bucket", "pair", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["bucket"], []).append(document_counts(row["pairs"], row["sizes"], row["dense"]))
                size += len(row["sizes"]) // 2
                if size > HELD_LINKS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    parts = postings.select("bucket", "pairs", "sizes", "dense").mapInArrow(count, "bucket int, pair long, n long")
    return parts.groupBy("bucket", "pair").agg(F.sum("n").alias("n"))


def return_scores(postings: DataFrame, counts: DataFrame, slices: int, n_partitions: int) -> DataFrame:
    """Step 3: (container, slot, n_best, count_sum) from the postings and (bucket, pair, n, best)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            rows = batch.select(["bucket", "slice", "is_posting"]).to_pylist()
            i = 0
            while i < len(rows):
                if (here := (rows[i]["bucket"], rows[i]["slice"])) != at:
                    at, known, table = here, [], None
                if not rows[i]["is_posting"]:
                    j = i
                    while j < len(rows) and not rows[j]["is_posting"] and (rows[j]["bucket"], rows[j]["slice"]) == at:
                        j += 1
                    part = batch.slice(i, j - i)
                    known.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
                    i = j
                    continue
                if table is None:
                    pair, n, best = (np.concatenate(c) for c in zip(*known, strict=True))
                    order = np.argsort(pair)
                    table, known = (pair[order], n[order], best[order].astype(np.int64)), []
                row = batch.slice(i, 1).to_pylist()[0]
                pair, size, slot, weight = unpack_postings(row)
                place = np.repeat(np.searchsorted(table[0], pair), size)
                total, best = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
                np.add.at(total, slot, table[1][place] * weight)
                np.add.at(best, slot, table[2][place] * weight)
                some = np.flatnonzero(total)
                columns = [pa.array(np.full(len(some), row["container"])), pa.array(some, pa.int32()), pa.array(best[some]), pa.array(total[some])]
                yield pa.RecordBatch.from_arrays(columns, ["container", "slot", "n_best", "count_sum"])
                i += 1

    blobs = ["container", "pairs", "sizes", "sparse", "dense", "planes"]
    sent = postings.select("bucket", F.pmod(F.xxhash64("container"), F.lit(slices)).cast("int").alias("slice"), F.lit(True).alias("is_posting"), *blobs)
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    both = counts.select("bucket", every, F.lit(False).alias("is_posting"), "pair", "n", "best").unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(n_partitions, "bucket", "slice").sortWithinPartitions("bucket", "slice", "is_posting")
    parts = dealt.mapInArrow(score, "container long, slot int, n_best long, count_sum long")
    return parts.groupBy("container", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(spark: SparkSession, docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    n_b = len(Tokenizers(byte_file, piece_file).b_bytes)
    linked = stored(spark, link_documents(docs, byte_file, piece_file), "alignment_links")
    postings = linked.where(F.col("bucket").isNotNull())
    order = Window.partitionBy("bucket", F.expr(f"pair div {n_b}"))
    counts = pair_counts(postings).withColumn("best", F.col("n") == F.max("n").over(order))
    counts = stored(spark, counts, "alignment_counts")
    entries = postings.agg(F.sum("n_entries")).first()[0] or 0
    slices = 1 + min(entries // (BUCKETS * TASK_ENTRIES), entries // (ENTRIES_PER_COUNT * max(1, counts.count())))
    scores = return_scores(postings, counts, slices, max(partitions(spark), BUCKETS * slices))
    own = linked.where(F.col("slot").isNotNull()).select("container", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return own.join(scores, ["container", "slot"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
