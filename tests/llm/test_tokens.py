from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import sentencepieces as S
from logloom.llm import token_files as K

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n: int) -> list[str]:
    r = random.Random(7)
    letters = "ab c▁\nélotheing  .,'s12\t汉"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)] + ["", " ", " " * 40 + "x" + " " * 33, "a" * 3000, "x  ", "it's we'll", "a  b\x85c"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(library):
    texts = odd_texts(1500)
    encoder = S.Encoder(PIECES)
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert got == library.encode(texts, num_threads=1)
    assert [encoder.decode(np.array(x, np.int64)) for x in got] == [t.replace(S.SPACE, " ") for t in texts]


def test_pieces_without_memory(library, monkeypatch):
    monkeypatch.setattr(S, "CACHE_UNITS", 3)
    monkeypatch.setattr(S, "BATCH_CHARS", 50)
    monkeypatch.setattr(S, "GROUP_UNITS", 10)
    texts = odd_texts(100)
    assert [np.frombuffer(x, "<u2").tolist() for x in S.Encoder(PIECES).encode(texts)] == library.encode(texts, num_threads=1)


def test_suffix_ranges_equal_plain_search():
    v = S.Vocabulary(PIECES)
    text = "▁the▁theme\x00▁them\x00other\x00"
    index = S.SuffixIndex(np.array([v.code.get(c, 0) for c in text], np.uint64))
    first, last = index.find(v.codes, v.length)
    for k in np.flatnonzero(last > first):
        piece = "".join(list(v.code)[int(c) - 1] for c in v.codes[k, : v.length[k]])
        places = [i for i in range(len(text)) if text.startswith(piece, i)]
        assert sorted(index.order[first[k] : last[k]].tolist()) == places
    assert int((last > first).sum()) >= len(set("▁themor"))


def test_piece_documents(spark, edges, nothing, edge_rows, library):
    encoded = S.encode_documents(edges, PIECES, carry=["doc_id", "n", "text"])
    for r in encoded.collect():
        assert r.ids == library.encode(r.text or "")
    decoded = S.decode_documents(encoded, PIECES, carry=["n"], text="row").collect()
    assert {r.n: r.row for r in decoded} == {r[-1]: (r[1] or "").replace(S.SPACE, " ") for r in edge_rows}
    assert S.encode_documents(nothing, PIECES).count() == 0
    with pytest.raises(ValueError):
        S.encode_documents(edges, PIECES, carry=["n"], ids="n")


def test_units_equal_whole_texts():
    from tokenizers import Tokenizer

    texts = [*odd_texts(1500), "a<|endoftext|>b c", "x\ny z. w, v.. u.", "a\u2003b c", "é\u0085 x", "a b\u3000", " a", "a ", "a\n", "a it's. b? x;", "b 3. z., é. a!\nc: d", "q .. ,a .b", "\na", "汉 字\n汉", "a " + "long" * 90 + " b"]
    t = K.Tokenizer(BPE)
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # unknown units, then remembered ones
        ids, counts = t.encode(pa.array(texts, pa.large_string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_units_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(K, "CACHE_UNITS", 40)
    t = K.Tokenizer(BPE)
    for k in range(3):
        texts = [f"w{i} x{i + k} once{i}" for i in range(100)]
        ids, counts = t.encode(pa.array(texts, pa.large_string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in t.library.encode_batch(texts, add_special_tokens=False)]
        assert len(t.place) == t.n == 40
    assert [len(x) for x in t.encode(pa.array([], pa.large_string()))] == [0, 0]


def test_repeated_passages_fold_into_rules():
    r = np.random.default_rng(5)
    passage = r.integers(0, 900, 64)
    ids = np.concatenate([np.concatenate([passage, r.integers(900, 1000, 3)]) for _ in range(300)])
    symbols, rules, lengths = K.re_pair(ids.astype("<u2"), 1000)
    assert lengths.max() >= 64 and len(symbols) < 300 * 6  # the passage is one symbol
    for n in (4, 5, 1000, 4097):
        symbols, rules, _ = K.re_pair(np.zeros(n, "<u2"), 10)
        assert len(symbols) <= max(n if n < 2 * K.LEAST_COUNT else 0, 2 * K.LEAST_COUNT)
    count = Counter(zip(symbols.tolist(), symbols[1:].tolist(), strict=False))
    assert max(count.values()) < 2 * K.LEAST_COUNT


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(6)
    ids = (r.zipf(1.3, 30_000) % 700).astype("<u2")
    symbols, _, _ = K.re_pair(ids, 700)
    a, b = symbols[:-1].tolist(), symbols[1:].tolist()
    count = Counter(p for p in zip(a, b, strict=True) if p[0] != p[1])
    assert max(count.values()) < K.LEAST_COUNT


def test_re_pair_round_trip_and_random_access():
    r = np.random.default_rng(3)
    for ids in (r.integers(0, 40, 20_000), np.zeros(5000, int), np.arange(300), np.zeros(0, int), np.tile([1, 2, 3, 1, 2, 4], 3000)):
        symbols, rules, lengths = K.re_pair(ids.astype("<u2"), 1000)
        row = {"base_id": 1000, "width": 4, "n_ids": len(ids), "doc_ids": b"", "starts": b"", "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes()}
        shard = K.Shard(row)
        assert shard.ids().tolist() == ids.tolist()
        for _ in range(30):
            a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
            assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    assert len(K.re_pair(np.tile([1, 2, 3, 1, 2, 4], 3000), 1000)[0]) < 18_000 / 2


def test_token_files(spark, edges, nothing, edge_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r in order:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = K.store_documents(spark, edges, BPE, shard_ids=500)
    got = K.read_documents(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    shards = [r.asDict() for r in spark.read.parquet(path).orderBy("part", "shard").collect()]
    assert len(shards) > 3
    documents = [s.document(k) for s in map(K.Shard, shards) for k in range(len(s.starts))]
    assert [zlib.crc32(d.astype("<u4").tobytes()) for d in documents] == [w[3] for w in want]
    assert K.read_documents(spark, K.store_documents(spark, nothing, BPE)).count() == 0
    assert edges.select(F.max("n")).first()[0] == len(edge_rows) - 1
