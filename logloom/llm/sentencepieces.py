"""SentencePiece BPE encoding and decoding by suffix-array matching.

Inside a task, each batch of texts is cut before spaces and newlines into units (no piece holds a
space behind another character, and a newline is no piece at all, so units are independent), and the
units that the worker does not remember are encoded together:

1. their characters are concatenated into one sequence (a separator after each unit) and its suffix
   array is built to the depth of the longest piece, by prefix doubling;
2. every piece of the vocabulary is binary-searched in it, which gives its range of occurrences;
3. all occurrences are edges (start, end, piece), sorted by end position inside their unit;
4. relaxation in that order: an edge is taken if it can follow the piece that ends at its start. Two
   pieces can be neighbours in a BPE result exactly when no merge across their border would come
   before the merges that form them; each position then has exactly one taken edge, and the path back
   from a unit's end is the BPE segmentation, equal to the sentencepiece library's.

Characters outside the vocabulary become their UTF-8 byte pieces (and nothing merges across them).
At most ``CACHE_UNITS`` units are remembered in a worker, the first ones met (frequent ones come early).

Defined results: null and empty texts give no ids and decode to the empty text; U+2581 counts as a
space, as in the library; everything else is restored exactly; long texts are handled whole; empty
tables give empty results; other columns are carried along by ``encode_documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CACHE_UNITS = 500_000
CACHE_UNIT_CHARS = 200
#: Characters indexed at once, and units looked up at once.
BATCH_CHARS = 1 << 17
GROUP_UNITS = 200_000
MAX_DEPTH = 16
NEVER = np.int64(1) << 40


class Vocabulary:
    """The pieces of a BPE model with byte fallback and identity normalisation, as arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte_id = np.full(256, -1, np.int64)
        plain: list[int] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        if (self.byte_id < 0).any() or model.encode(" a  ﬁ", out_type=str)[-1] == "fi":
            raise ValueError("the model must have byte fallback and identity normalisation")
        self.bytes_of = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for value, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([value])
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.bytes_of[i] = b""
        self.byte_len = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)])[:-1]
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # Runs of spaces merge last, all with one score, leftmost first: they are handled apart.
        self.space_run = {len(names[i]): i for i in plain if not names[i].strip(SPACE)}
        pieces = [i for i in plain if names[i].strip(SPACE) or names[i] == SPACE]
        pieces = [i for i in pieces if len(names[i]) <= MAX_DEPTH and (len(names[i]) == 1 or not names[i].startswith(SPACE * 2))]
        if any(SPACE in names[i][1:] for i in pieces) or len(pieces) + len(self.space_run) - 1 < len(plain):
            raise ValueError("a piece holds an inner space or is too long")
        by_rank = sorted(pieces, key=lambda i: (len(names[i]) > 1, -model.get_score(i), i))
        self.ids = np.array(by_rank, np.int64)  # index = merge rank; single characters come first
        text = [names[i] for i in by_rank]
        self.length = np.array([len(t) for t in text], np.int64)
        letters = sorted({c for t in text for c in t})
        self.code = {c: k + 1 for k, c in enumerate(letters)}  # 0: separator or unknown character
        self.code_table = np.zeros(0x110000, np.uint16)
        self.code_table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.codes = np.zeros((len(text), MAX_DEPTH), np.uint64)
        for k, t in enumerate(text):
            self.codes[k, : len(t)] = [self.code[c] for c in t]
        self._merges(text)

    def _merges(self, text: list[str]) -> None:
        """All splits of each piece into two pieces, and the split by which merging forms it."""
        rank = {t: k for k, t in enumerate(text)}
        pairs, ranks = [], []
        left, right = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
        for k, t in enumerate(text):
            splits = [(rank[t[:i]], rank[t[i:]]) for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
            pairs += [(a << 32) | b for a, b in splits]
            ranks += [k] * len(splits)
            if len(t) > 1:
                formed = _merge_all(t, rank, k)
                if len(formed) == 2:
                    left[k], right[k] = formed
        order = np.argsort(np.array(pairs, np.int64))
        self.pair = np.append(np.array(pairs, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array(ranks, np.int64)[order], NEVER)
        self.left, self.right = left, right
        self.single = self.length == 1
        # A piece that merging never forms from its own text cannot occur in a result.
        self.usable = self.single | (left >= 0)

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER)

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a, b (ranks) stay apart when their joined text is merged.

        Going back in time from (a, b), the younger of the two pieces at the border is split; a merge
        across the border wins if it is older than the merge that next takes one of them (a tie goes
        to the left one)."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            q = self.merged_rank(x, y)
            lost = (q < until_x) & (q <= until_y) & (q < NEVER)
            ok[live[lost]] = False
            inner_x, inner_y = ~self.single[x], ~self.single[y]
            go = ~lost & (inner_x | inner_y)
            live, x, y, until_x, until_y = live[go], x[go], y[go], until_x[go], until_y[go]
            back_x = (~self.single[x]) & (self.single[y] | (x > y))
            until_x, until_y = np.where(back_x, x, until_x), np.where(back_x, until_y, y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return ok

    def spaces(self, n: int) -> list[int]:
        """Ids of n >= 1 bare spaces, merged leftmost first."""
        groups: list[int] = []
        for _ in range(n):
            groups.append(1)
            while len(groups) > 1 and groups[-2] + groups[-1] in self.space_run:
                last = groups.pop()
                groups[-1] += last
        return [self.space_run[g] for g in groups]


def _merge_all(t: str, rank: dict[str, int], whole: int) -> list[int]:
    """Pieces of ``t`` after all merges older than ``whole``, best first, leftmost on ties."""
    parts = list(t)
    while True:
        best = min(((rank.get(a + b, whole), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(whole, 0))
        if best[0] >= whole:
            return [rank[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


class SuffixIndex:
    """Suffixes of a code sequence (0 ends a unit), sorted by their first MAX_DEPTH codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        padded = np.zeros(n + MAX_DEPTH, np.uint64)
        padded[:n] = codes
        four = np.zeros(n + MAX_DEPTH, np.uint64)
        for i in range(4):
            four[: n + MAX_DEPTH - i] |= padded[i:] << np.uint64(16 * (3 - i))
        self.keys4, r4 = _dense(four)
        eight = (r4.astype(np.int64) << 32)[: n + 8]
        eight[:] |= r4[4 : n + 12]
        self.keys8, r8 = _dense(eight)
        full = (r8.astype(np.int64) << 32)[:n] | r8[8 : n + 8]
        self.order = np.argsort(full, kind="stable")
        self.full = full[self.order]
        self.rank4, self.rank8 = r4[self.order], r8[self.order]

    def _four(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds among keys4 of the first min(length, 4) codes."""
        low, high = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
        for i in range(4):
            shift = np.uint64(16 * (3 - i))
            low |= codes[:, i] << shift
            high |= np.where(i < length, codes[:, i], np.uint64(0xFFFF)) << shift
        return np.searchsorted(self.keys4, low, "left"), np.searchsorted(self.keys4, high, "right")

    def _eight(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds among keys8 of the first min(length, 8) codes."""
        a, b = self._four(codes, length)
        low, high = a.astype(np.int64) << 32, b.astype(np.int64) << 32
        longer = length > 4
        c, d = self._four(codes[:, 4:], length - 4)
        low = np.where(longer, (a.astype(np.int64) << 32) | c, low)
        high = np.where(longer, (a.astype(np.int64) << 32) | d, high)
        none = longer & (a >= b)
        found = np.searchsorted(self.keys8, low, "left"), np.searchsorted(self.keys8, high, "left")
        return found[0], np.where(none, found[0], found[1])

    def find(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, its range in ``order``."""
        a, b = self._eight(codes, length)
        longer = length > 8
        c, d = self._eight(codes[:, 8:], length - 8)
        low = np.where(longer, (a.astype(np.int64) << 32) | c, a.astype(np.int64) << 32)
        high = np.where(longer, (a.astype(np.int64) << 32) | d, b.astype(np.int64) << 32)
        first, last = np.searchsorted(self.full, low, "left"), np.searchsorted(self.full, high, "left")
        return first, np.where((longer & (a >= b)) | (last < first), first, last)


def encode_units(v: Vocabulary, units: list[str]) -> list[bytes]:
    """The ids (little-endian 16 bits) of each unit, as if a space stood before it."""
    marked = [u if u[0] == "\n" else SPACE + u for u in units]
    points = np.frombuffer(("\x00".join(marked) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked)) + 1  # with the separator
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = starts[1:] - 1
    starts = starts[:-1]
    codes = v.code_table[points].astype(np.uint64)
    codes[ends] = 0
    n = len(codes)

    index = SuffixIndex(codes)
    first, last = index.find(v.codes, v.length)
    last = np.where(v.usable, last, first)
    count = last - first
    piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
    place = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    start = index.order[place]
    end = start + v.length[piece]

    unit_of = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    offset = end - starts[unit_of[start]]
    order = np.argsort(offset.astype(np.uint16) if len(offset) and offset.max() < 65536 else offset, kind="stable")
    start, end, piece, offset = start[order], end[order], piece[order].astype(np.int64), offset[order]

    # taken[i]: the piece that ends before position i; -1: nothing before it can merge; -2: not reached.
    taken = np.full(n + 1, -2, np.int64)
    taken[starts] = -1
    unknown = codes == 0
    unknown[ends] = False
    taken[np.flatnonzero(unknown) + 1] = -1
    bounds = np.flatnonzero(np.diff(offset, prepend=-1, append=-1)) if len(offset) else np.zeros(0, np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        before = taken[start[lo:hi]]
        fits = before == -1
        test = np.flatnonzero(before >= 0)
        if len(test):
            fits[test] = v.can_follow(before[test], piece[lo:hi][test])
        hit = np.flatnonzero(fits)
        taken[end[lo:hi][hit]] = piece[lo:hi][hit]

    # Back from each unit's end, marking where its pieces end.
    closes = np.zeros(n + 1, bool)
    at, stop = ends.copy(), starts
    while len(at):
        closes[at] = True
        step = np.where(unknown[at - 1], 1, v.length[np.maximum(taken[at], 0)])
        at = at - step
        go = at > stop
        at, stop = at[go], stop[go]
    where = np.flatnonzero(closes)
    is_unknown = unknown[where - 1]
    ids = np.where(is_unknown, 0, v.ids[np.maximum(taken[where], 0)])
    parts = np.searchsorted(where, starts + 1), np.searchsorted(where, ends, "right")
    raw = ids.astype("<u2").tobytes()
    odd = np.diff(np.concatenate([[0], np.cumsum(is_unknown)])[np.append(parts[0], parts[1][-1])]) > 0
    out = [raw[2 * a : 2 * b] for a, b in zip(parts[0].tolist(), parts[1].tolist(), strict=True)]
    byte_id = v.byte_id.astype("<u2")
    for u in np.flatnonzero(odd).tolist():
        made = []
        for k in range(parts[0][u], parts[1][u]):
            if is_unknown[k]:
                utf8 = chr(points[where[k] - 1]).encode("utf-8", "surrogatepass")
                made.append(byte_id[np.frombuffer(utf8, np.uint8)].tobytes())
            else:
                made.append(raw[2 * k : 2 * k + 2])
        out[u] = b"".join(made)
    return out


class Encoder:
    """Encodes batches of texts; remembers the ids of the units met (bounded)."""

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        if self.v.size > 65536:
            raise ValueError("ids must fit 16 bits")
        self.known: dict[str, bytes] = {}
        self.bare = self.v.space_run[1].to_bytes(2, "little")

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of the given units that are not remembered; short ones are, while there is room."""
        new = [u for u in units if u not in self.known]
        found: dict[str, bytes] = {}
        batch: list[str] = []
        size = 0
        for k, u in enumerate(new):
            batch.append(u)
            size += len(u) + 2
            if size >= BATCH_CHARS or k == len(new) - 1:
                found.update(zip(batch, encode_units(self.v, batch), strict=True))
                batch, size = [], 0
        room = CACHE_UNITS - len(self.known)
        if room > 0:
            short = [u for u in new if len(u) <= CACHE_UNIT_CHARS][:room]
            self.known.update((u, found.pop(u)) for u in short)
        return found

    def with_space_runs(self, units: list[str], extra: dict[str, bytes]) -> bytes:
        """Ids of units of which some are empty: bare spaces, which merge with one another."""
        out, bare = [], 0
        for i, u in enumerate(units):
            if not u:
                bare += 1
                continue
            own = self.known[u] if u in self.known else extra[u]
            if bare and own[:2] == self.bare:  # the unit's own space stayed bare: it joins the run
                out.append(np.array(self.v.spaces(bare + 1), "<u2").tobytes() + own[2:])
            else:
                out.append((np.array(self.v.spaces(bare), "<u2").tobytes() if bare else b"") + own)
            bare = 0
        if bare:
            out.append(np.array(self.v.spaces(bare), "<u2").tobytes())
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        # A newline is cut off before (it never merges): a unit that starts with it has no space.
        split = [t.replace(SPACE, " ").replace("\n", " \n").split(" ") if t else [] for t in texts]
        out: list[bytes] = []
        group: list[list[str]] = []
        size, known = 0, self.known
        for k, units in enumerate(split):  # groups bound the memory of one round of learning
            group.append(units)
            size += len(units)
            if size >= GROUP_UNITS or k == len(split) - 1:
                wanted = set().union(*group)
                wanted.discard("")
                extra = self.learn(wanted)
                for units in group:
                    if "" in units:
                        out.append(self.with_space_runs(units, extra))
                    else:
                        out.append(b"".join([known[u] if u in known else extra[u] for u in units]))
                group, size = [], 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids."""
        if not len(ids):
            return ""
        length = self.v.byte_len[ids]
        total = np.cumsum(length)
        place = np.arange(total[-1]) + np.repeat(self.v.byte_at[ids] - (total - length), length)
        return self.v.all_bytes[place].tobytes().decode("utf-8", "replace").removeprefix(" ")


@functools.lru_cache(maxsize=1)
def encoder(model_file: str) -> Encoder:
    """The worker's encoder (its memory of units lasts for the worker's life)."""
    return Encoder(model_file)


def encode_documents(docs: DataFrame, model_file: str, *, text: str = "text", carry: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """The ``carry`` columns and the ids of each text (map only). ``model_file`` must name a file
    that exists on the executors."""
    carry = ["doc_id"] if carry is None else carry
    if ids in carry:
        raise ValueError(f"column {ids} is there already; name another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file)
        for batch in batches:
            found = e.encode(batch.column(text).to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in found])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(found), "<u2").astype(np.int32))
            kept = batch.select(carry)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(at, flat)], [*carry, ids])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry], f"`{ids}` array<int>"])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_file: str, *, ids: str = "ids", carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``carry`` columns and the text of each row's ids (map only)."""
    carry = ["doc_id"] if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file)
        for batch in batches:
            texts = [e.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column(ids)]
            kept = batch.select(carry)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], [*carry, text])

    schema = ", ".join([*[f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry], f"`{text}` string"])
    return encoded.select(*dict.fromkeys([*carry, ids])).mapInArrow(run, schema)
