"""Token-id files, compressed per shard by a Re-Pair grammar with random-access decoding.

Writing: documents are range-partitioned by doc_id, each task sorts its range and encodes every whole
text (byte-level BPE of the tokenizers library, ``end_id`` appended), and cuts its stream into shards
of about ``SHARD_IDS`` ids. In each shard pairs of neighbouring symbols are replaced by new symbols until no
pair occurs ``LEAST_COUNT`` times. Each round counts all pairs exactly (a sort of the pair codes) and replaces,
most frequent first, every pair frequent enough whose left part is no right part and whose right part is
no left part of another one of the round, so that all replacements of a round are independent; a pair
of two equal symbols has a round of its own parts and is taken left to right. A shard is one row of a
Parquet table:

    part, shard       place of the shard: shards in (part, shard) order hold ascending doc_ids
    doc_ids, starts   little-endian int64: the documents and the place of their first id in the shard
    n_ids             ids in the shard
    rules             little-endian uint32 pairs: symbol ``base_id + i`` stands for pair i
    lengths           little-endian uint32: ids that symbol ``base_id + i`` expands to
    symbols           the compressed sequence, little-endian uint16 or uint32 (``width`` bytes each)

``Shard.ids(first, last)`` decodes any range: a running sum of expansion lengths finds the symbols that
cover it, and only those are expanded.

Encoding looks up units: the pre-tokeniser always cuts before a single space and before a single newline
that stand between other characters, so the ids of a text are those of its units. New units of many texts
are encoded by one call of the library over their concatenation, where they start and end as in the texts;
a worker remembers the first ``CACHE_UNITS`` it meets. Texts with other white-space around these, or with a special
token's string, go to the library whole.

Defined results: null text counts as empty (only the end id); rows are ordered by doc_id, equal doc_ids
by text, null doc_id first; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm import textops as T
from logloom.llm.shared import partitions
from logloom.session import shared_dir

END_ID = 0
SHARD_IDS = 1 << 20
LEAST_COUNT = 64
CACHE_UNITS, CACHE_UNIT_BYTES = 900_000, 200
#: Texts whose unknown units are held together: bytes, and rows; and bytes worked on at once.
GROUP_BYTES, GROUP_ROWS = 1 << 23, 4096
PART_BYTES = 1 << 21
# Texts are cut at spaces and newlines; texts with other white space are not: bytes, then wide characters (C2 xx as
# C2 xx 00).
_CUTS = np.zeros(256, bool)
_CUTS[[10, 32]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[9, 11, 12, 13, *range(0x1C, 0x20)]] = True
# Marks that end a unit, behind an ASCII letter, and the places of their units.
_MARKS = ".,;:!?"
_MARK_PLACE = np.full(256, -1, np.int64)
_MARK_PLACE[[ord(m) for m in _MARKS]] = np.arange(len(_MARKS))
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_WIDE = np.array([int.from_bytes(chr(c).encode().ljust(3, b"\0")) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_LEADS = np.zeros(256, bool)
_LEADS[np.unique(_WIDE >> 16)] = True

SCHEMA = "part int, shard int, n_docs long, n_ids long, base_id long, width int, doc_ids binary, starts binary, rules binary, lengths binary, symbols binary"


class Tokenizer:
    """Ids of texts by units (see the module text); ids are 16- or 32-bit little-endian numbers."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(file)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Characters of a byte-level name are bytes, so a name's length is its size.
        names = [self.library.id_to_token(i) or "" for i in range(self.size)]
        self.bytes_of = np.array([len(n) for n in names], np.int64)
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, self.type)
        self.start = np.zeros(1 << 12, np.int64)
        self.n = self.kept = 0  # units known now, and remembered
        for m in _MARKS:  # by names that no unit has
            ids = self._library(m)
            self._add([b" " + m.encode()], ids, np.array([len(ids)]))

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type)

    def _add(self, units: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.n + len(units) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        first = int(self.start[self.n])
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first : first + len(ids)] = ids
        self.start[self.n + 1 : self.n + len(units) + 1] = first + np.cumsum(counts)
        self.place.update(zip(units, range(self.n, self.n + len(units)), strict=True))
        self.n += len(units)

    def _learn(self, new: list[bytes]) -> None:
        """New units: words without the space before them, or with the newline before them. Short ones come
        first, so that long ones are not remembered."""
        new.sort(key=len)
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            marked = [u if u[0] == 10 else b" " + u for u in part]
            ids = self._library("x" + b"".join(marked).decode())[1:]
            end = np.cumsum(self.bytes_of[ids])
            sizes = np.cumsum(list(map(len, marked)))
            at = np.searchsorted(end, sizes) + 1
            if len(end) and at[-1] == len(ids) and (end[at - 1] == sizes).all():
                self._add(part, ids, np.diff(at, prepend=0))
            else:
                for u, text in zip(part, marked, strict=True):
                    ids = self._library(text.decode())
                    self._add([u], ids, np.array([len(ids)]))

    def _forget(self) -> None:
        """Keep what is remembered: the first ``CACHE_UNITS`` units."""
        if self.kept < CACHE_UNITS:
            self.kept = min(self.n, CACHE_UNITS)
        if self.n > self.kept:
            for u in list(itertools.islice(reversed(self.place), self.n - self.kept)):
                del self.place[u]
            self.n = self.kept

    def _whole(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are not cut: those with a space or newline beside another or at an end, with other
        white space, or with a special token's string."""
        space = np.concatenate([[True], _CUTS[data], [True]])
        beside = space[1:-1] & (space[:-2] | space[2:])
        edges = np.concatenate([offsets[:-1], offsets[1:] - 1])[np.tile(np.diff(offsets) > 0, 2)]
        beside[edges] |= _CUTS[data[edges]]
        odd = np.flatnonzero(beside | _OTHER[data])
        wide = np.flatnonzero(_LEADS[data])
        pad = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        code = pad[wide] << 16 | pad[wide + 1] << 8 | np.where(pad[wide] == 0xC2, 0, pad[wide + 2])
        odd = np.concatenate([odd, wide[np.isin(code, _WIDE)]])
        whole = np.zeros(len(offsets) - 1, bool)
        whole[np.searchsorted(offsets, odd, "right") - 1] = True
        for special in self.special:
            whole |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        return whole

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) one behind the other, and the number of each."""
        _, offsets = T.string_buffers(column)
        # In parts whose arrays stay in the processor's caches.
        parts = [self._encode(column.slice(i, j - i)) for i, j in T.chunks(offsets, PART_BYTES)]
        self._forget()
        ids, counts = zip(*parts, strict=True) if parts else ((), ())
        return np.concatenate([*ids, np.zeros(0, self.type)]), np.concatenate([*counts, np.zeros(0, np.int64)])

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of one part. The first word of a text has no space before it: it goes to the
        library, as texts do that are not cut."""
        data, offsets = T.string_buffers(column)
        whole = self._whole(column, data, offsets)
        starts, ends, bounds = T.word_spans(data, offsets, _CUTS)
        words = np.diff(bounds)
        # Heads: whole texts, or first words.
        last = np.where(whole | (np.diff(bounds) == 0), offsets[1:], ends[np.minimum(bounds[:-1], max(len(ends) - 1, 0))] if len(ends) else offsets[1:])
        raw = data.tobytes()
        heads = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), last.tolist(), strict=True)]
        # Units: all words behind the first of the texts that are cut.
        of, nth = T.runs(words)
        used = (nth > 0) & ~whole[of]
        of, starts, ends = of[used], starts[used], ends[used]
        line = data[starts - 1] == 10
        starts = starts - line
        # A mark behind a letter at a unit's end is a token of its own: the unit is known by what is before it.
        marked = (ends - starts > 1) & (_MARK_PLACE[data[ends - 1]] >= 0) & _LETTERS[data[ends - 2]]
        mark = _MARK_PLACE[data[ends[marked] - 1]]
        ends = ends - marked
        size = ends - starts
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1  # starts differ from each other, and ends do
        inside[ends] -= 1
        body = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.place.get, names, itertools.repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(place < 0).tolist()
        if unknown:
            self._learn([names[k] for k in unknown if size_ok(names[k])])
            self._learn([names[k] for k in unknown if not size_ok(names[k])])
            place[unknown] = [self.place[names[k]] for k in unknown]
        unit = place[coded.indices.to_numpy()]
        # Marks follow their units.
        at = np.arange(len(unit)) + np.cumsum(marked) - marked
        every = np.empty(len(unit) + len(mark), np.int64)
        every[at], every[at[marked] + 1] = unit, mark
        of = np.repeat(of, 1 + marked)
        unit = every
        # Heads and units in the order of the texts.
        found = self.library.encode_batch(heads, add_special_tokens=False)
        n_head = np.array([len(e.ids) for e in found], np.int64)
        head_ids = np.array([i for e in found for i in e.ids], self.type)
        count = self.start[unit + 1] - self.start[unit]
        total = n_head + np.bincount(of, count, len(heads)).astype(np.int64)
        out = np.empty(int(total.sum()), self.type)
        first = np.cumsum(total) - total
        text, nth = T.runs(n_head)
        out[first[text] + nth] = head_ids
        # Ids of the units fill what the heads leave, in order.
        left = np.ones(len(out), bool)
        left[first[text] + nth] = False
        piece, nth = T.runs(count)
        out[left] = self.ids[self.start[unit][piece] + nth]
        return out, total


def size_ok(unit: bytes) -> bool:
    """Whether a unit is among the short ones, which are remembered first."""
    return len(unit) <= CACHE_UNIT_BYTES


@functools.lru_cache(maxsize=1)
def tokenizer(file: str) -> Tokenizer:
    """The worker's tokenizer (its memory of units lasts for the worker's life)."""
    return Tokenizer(file)


def _chosen(seq: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) to replace in this round, most frequent first. (Their table is small: a shard of n
    ids has at most n / LEAST_COUNT of them.)"""
    wide = seq.astype(np.uint64)
    code = np.sort(wide[:-1] << np.uint64(32) | wide[1:]) if room > 65536 else np.sort(seq[:-1] << np.uint32(16) | seq[1:])
    first = np.flatnonzero(np.diff(code, prepend=~code[:1]))
    count = np.diff(first, append=len(code))
    best = np.flatnonzero(count >= LEAST_COUNT)
    best = best[np.argsort(-count[best], kind="stable")]
    code = code[first[best]].astype(np.uint64)
    shift = np.uint64(32 if room > 65536 else 16)
    left, right = (code >> shift).astype(np.int64), (code & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    role = bytearray(room)  # 1: a left part, 2: a right part, 3: both parts of its only pair
    taken = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if a == b:
            if not role[a]:
                role[a] = 3
                taken.append(k)
        elif role[a] < 2 and role[b] in (0, 2):
            role[a], role[b] = 1, 2
            taken.append(k)
    return left[taken], right[taken]


def re_pair(ids: np.ndarray, base_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths) of one shard's ids."""
    seq = ids.astype(np.uint32)
    rules = [np.zeros((0, 2), np.uint32)]
    length = np.ones(base_id, np.uint32)
    while len(seq) >= 2:
        size = len(length)
        left, right = _chosen(seq, size)
        if not len(left):
            break
        # Few positions have a left part and a right part behind it; only these are looked up.
        is_left, is_right = np.zeros(size, bool), np.zeros(size, bool)
        is_left[left], is_right[right] = True, True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        rule_of = np.full((int(is_left.sum()), int(is_right.sum())), -1, np.int32)
        row, column = np.cumsum(is_left) - 1, np.cumsum(is_right) - 1
        rule_of[row[left], column[right]] = np.arange(len(left))
        rule = rule_of[row[seq[at]], column[seq[at + 1]]]
        at, rule = at[rule >= 0], rule[rule >= 0]
        # Runs of one symbol: every second pair, from the left.
        twin = left[rule] == right[rule]
        if twin.any():
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at, rule = at[~twin | (nth % 2 == 0)], rule[~twin | (nth % 2 == 0)]
        seq[at] = size + rule.astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([left, right], 1).astype(np.uint32))
        length = np.concatenate([length, length[left] + length[right]])
    return seq, np.concatenate(rules), length[base_id:]


class Shard:
    """One stored shard: whole or random-access decoding."""

    def __init__(self, row: dict):
        self.base_id = row["base_id"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.n_ids = row["n_ids"]
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
        self.lengths = np.frombuffer(row["lengths"], "<u4")
        rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        # All expansions one behind the other, plain ids (their own expansion) first. Parts are older than
        # their rule; rules whose parts are all expanded are expanded together.
        self.length = np.concatenate([np.ones(self.base_id, np.int64), self.lengths])
        self.at = np.cumsum(self.length) - self.length
        self.text = np.empty(int(self.length.sum()), np.uint32)
        self.text[: self.base_id] = np.arange(self.base_id)
        newest = np.maximum.accumulate(rules.max(1, initial=0).astype(np.int64)) if len(rules) else np.zeros(0, np.int64)
        done = 0
        while done < len(rules):
            stop = int(np.searchsorted(newest, self.base_id + done))
            parts = rules[done:stop].ravel()
            start = int(self.at[self.base_id + done])
            self.text[start : start + int(self.length[parts].sum())] = self.expand(parts)
            done = stop

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        length = self.length[symbols]
        end = np.cumsum(length, dtype=np.int64)
        place = np.repeat(self.at[symbols] - (end - length), length)
        place += np.arange(len(place))
        return self.text[place]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last of the shard; only the symbols that cover them are expanded."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint32)
        if first == 0 and last == self.n_ids:
            return self.expand(self.symbols)
        length = self.length[self.symbols]
        end = np.cumsum(length)
        a, b = np.searchsorted(end, first, "right"), np.searchsorted(end, last, "left") + 1
        skipped = int(end[a] - length[a])
        return self.expand(self.symbols[a:b])[first - skipped : last - skipped]

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else None)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, pa.Array]]:
    """(part, doc_ids, texts without nulls) of neighbouring rows, up to about GROUP_BYTES and GROUP_ROWS."""
    part, held, rows, size = 0, [], 0, 0

    def group() -> tuple[int, list, pa.Array]:
        table = pa.Table.from_batches(held)
        return part, table["doc_id"].to_pylist(), table["text"].cast(pa.large_string()).combine_chunks().fill_null("")

    for batch in batches:
        if len(batch):
            part = batch.column("part")[0].as_py()
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if size >= GROUP_BYTES or rows >= GROUP_ROWS:
                yield group()
                held, rows, size = [], 0, 0
    if held:
        yield group()


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of ``docs`` (doc_id, text) to ``path``, a folder that the cluster shares."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_file)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        held_counts: list[np.ndarray] = []
        size, shard, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            counts, stream = np.concatenate(held_counts), np.concatenate(held)
            symbols, rules, lengths = re_pair(stream, t.size)
            width = 2 if t.size + len(rules) <= 65536 else 4
            row = {
                "width": width, "part": part, "shard": shard, "n_docs": len(ids), "n_ids": len(stream), "base_id": t.size,
                "doc_ids": np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes(), "starts": (np.cumsum(counts) - counts).astype("<i8").tobytes(),
                "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], ARROW)

        for part, numbers, texts in _groups(batches):
            stream, counts = t.encode(texts)
            # The end id behind each text's ids.
            whole = np.full(len(stream) + len(texts), end_id, t.type)
            ends = np.cumsum(counts) + np.arange(len(texts))
            body = np.ones(len(whole), bool)
            body[ends] = False
            whole[body] = stream
            first, row = 0, 0
            while row < len(texts):  # shards end behind the document that fills them
                last = min(int(np.searchsorted(ends, first + shard_ids - size - 1)), len(texts) - 1)
                piece = whole[first : ends[last] + 1]
                ids += numbers[row : last + 1]
                held_counts.append(counts[row : last + 1] + 1)
                held.append(piece)
                size += len(piece)
                first, row = int(ends[last]) + 1, last + 1
                if size >= shard_ids:
                    yield flush()
                    ids, held, held_counts, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), "doc_id")
    ranged = ranged.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    ranged.mapInArrow(write, SCHEMA).write.parquet(path)


NULL_ID = -(2**63)
ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("base_id", pa.int64()), ("width", pa.int32()),
    ("doc_ids", pa.binary()), ("starts", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and
    its shard. Only the shards' headers (one small row each) meet in the window over shards."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "shard", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                ids = s.ids().astype("<u4")
                bounds = np.append(s.starts, s.n_ids)
                counts = np.diff(bounds)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(counts)
                doc_id = pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(s.starts), pa.array(counts), pa.array(crc, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32())],
                    ["doc_id", "inside", "n_tokens", "ids_crc32", "part", "shard"],
                )

    found = shards.mapInArrow(read, "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, shard int")
    return found.join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def store_documents(spark: SparkSession, docs: DataFrame, tokenizer_file: str, **options) -> str:
    """``write_shards`` to a new folder below the shared checkpoint folder; returns the folder."""
    path = shared_dir(spark, "llm", "token_files")
    write_shards(spark, docs, path, tokenizer_file, **options)
    return path
