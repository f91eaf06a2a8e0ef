from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from logloom.llm import near_dedup as N
from logloom.llm import paragraph_sketch as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows: list[tuple], k: int, percent: int) -> list[int | None]:
    """The component of each (doc_id, text) row, over all pairs of distinct sets."""
    sets = [shingles(t, k) for _, t in rows]
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            groups[s].append(rows[i][0])
    distinct = list(groups)
    parent = list(range(len(distinct)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(distinct)):
        for b in range(a):
            common = len(distinct[a] & distinct[b])
            if 100 * common >= percent * (len(distinct[a]) + len(distinct[b]) - common):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 60)
    for i, s in enumerate(distinct):
        least[root(i)] = min(least[root(i)], *groups[s])
    place = {s: i for i, s in enumerate(distinct)}
    return [least[root(place[s])] if s and r[0] is not None else r[0] for r, s in zip(rows, sets, strict=True)]


def check(spark, rows, k, percent):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    got = N.near_duplicates(spark, df, shingle_words=k, percent=percent).collect()
    want = brute_components(rows, k, percent)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id or -1, r.kept) for r in got) == sorted(
        (i is not None, i or 0, len(shingles(t, k)), c or -1, i is None or i == c) for (i, t), c in zip(rows, want, strict=True)
    )


def test_shingles_equal_brute_force(edge_rows):
    texts = [r[1] for r in edge_rows]
    column = pa.array(texts, pa.string())
    data, offsets = N.T.string_buffers(column)
    for k in (1, 3, 5):
        _, sizes = N._distinct(data, offsets, k)
        assert sizes.tolist() == [len(shingles(t, k)) for t in texts]


def test_components_of_star_chain_and_copies(spark):
    """A centre whose variants are near it but not near each other, a chain, copies, short texts."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(40):
        words = list(base)
        for p in r.sample(range(200), 4):
            words[p] = f"v{i}x{p}"
        rows.append((i + 1, " ".join(words)))
    chain = list(base)[::-1]
    for i in range(12):
        chain[i * 15 : i * 15 + 4] = [f"c{i}a", f"c{i}b", f"c{i}c", f"c{i}d"]
        rows.append((100 + i, " ".join(chain)))
    common = " ".join(f"shared{i}" for i in range(12))
    rows += [(200 + i, common + " " + " ".join(f"own{i}y{j}" for j in range(6))) for i in range(30)]
    rows += [(300, "a b"), (301, "A  B"), (302, "a"), (303, ""), (304, None), (None, "a b"), (305, rows[3][1]), (306, rows[3][1].upper())]
    check(spark, rows, 3, 85)


def test_components_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 5, 80)


def test_pairs_of_few_equal_half_bands_are_linked(spark):
    """Pairs at the threshold that share a table key, but fewer than LEAST_SHARED half-bands."""
    r, texts = random.Random(4), []
    for _ in range(20_000):
        words = [f"w{r.randrange(10**9)}" for _ in range(50)]
        texts += [" ".join(words[:45]), " ".join(words[:40] + words[45:])]  # 40 of 50
    found = []
    for i in range(0, len(texts), 4000):
        data, offsets = N.T.string_buffers(pa.array(texts[i : i + 4000]))
        bands = N._half_bands(*N._distinct(data, offsets, 1))
        same = bands[::2] == bands[1::2]
        few = same[:, : N.HALVES].any(1) & same[:, N.HALVES :].any(1) & (same.sum(1) < N.LEAST_SHARED)
        found += [i + 2 * int(k) for k in np.flatnonzero(few)]
    assert found
    rows = [(k + j, texts[k + j]) for k in found for j in (0, 1)]
    got = N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=1, percent=80).collect()
    assert {x.doc_id: x.component_id for x in got} == {k + j: k for k in found for j in (0, 1)}


def test_versions_of_one_doc_id_lose_no_document(spark, monkeypatch):
    """doc_ids with several texts: each row is judged by its own text, and no text goes without a copy of it
    staying."""
    monkeypatch.setattr(N, "HOT_ROWS", 3)
    r = random.Random(8)

    def table(t: int) -> list[tuple]:
        words = {c: [f"{c}{t}x{r.randrange(10**6)}" for _ in range(60)] for c in "XYZ"}
        x, y, z = (" ".join(w) for w in words.values())
        near = " ".join(words["X"][:58])
        half = " ".join(words["X"][:48] + words["Z"][:12])  # shares much with x, but less than 80 of 100
        rows = [
            [(1, y), (5, x), (5, y), (7, x)],
            [(0, near), (1, x), (1, y)],
            [(1, x), (1, y), (7, x), (8, y), (8, z)],
            [(1, half), (5, x), (5, half), (6, x), (6, x), (None, half)],
            [(3, x)] * 5 + [(4, near)] * 5 + [(2, z), (4, z)],
        ][t]
        return [(i if i is None else i + 100 * t, text) for i, text in rows]

    rows = [row for t in range(5) for row in table(t)]
    check(spark, rows, 5, 80)
    kept = N.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [row for row, c in zip(rows, brute_components(rows, 5, 80), strict=True) if row[0] is None or row[0] == c]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))
    left = [shingles(t, 5) for _, t in want]
    assert all(any(100 * len(s & k) >= 80 * len(s | k) for k in left) for s in (shingles(t, 5) for _, t in rows))


def test_near_duplicate_edges(spark, edges, nothing):
    kept = N.drop_near_duplicates(spark, edges)
    assert kept.schema == edges.schema
    # 2 is an exact copy of 1 (both its rows go), 6 is near 5; all others stay, null doc_ids too.
    assert sorted(r.n for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 9, 10, 11]
    assert N.drop_near_duplicates(spark, nothing).count() == 0 and N.near_duplicates(spark, nothing).count() == 0


def test_component_steps(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {i: i for e in links for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.id: x.component for x in N.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for e in links if e[0] != e[1] for i in e}


def test_only_what_the_result_reads_is_left(spark, capsys):
    """Tables that no step reads any more are gone, and the texts are not shuffled for a few ids."""
    from pathlib import Path

    from logloom.llm import shared

    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(words[: 120 - i % 7])) for i in range(60)] + [(100 + i, f"own{i} text{i} of{i}") for i in range(20)]
    before, bound = set(shared._STORED), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = N.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
        kept.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
        left = [Path(f.removeprefix("file:")) for f in shared._STORED if f not in before]
        assert [f.parent.name for f in left] == ["dropped"] and left[0].exists()
        want = brute_components(rows, 5, 80)
        assert sorted(x.doc_id for x in kept.collect()) == sorted(i for (i, _), c in zip(rows, want, strict=True) if i == c)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_shuffle_files_of_a_stored_table_are_deleted(spark):
    """The shuffle of a write is gone when it has ended, and the session's setting is as before."""
    import time

    from logloom.llm import shared

    rows = spark.range(200_000).select((N.F.col("id") % 1000).alias("k"), "id")
    setting = spark.conf.get(shared.CLEAR_SHUFFLES, None)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark._jvm.System.gc()

    def files() -> set:
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().endswith(".data")}

    before = files()
    table = shared.stored(spark, rows.groupBy("k").agg(N.F.collect_list("id").alias("ids")), "test_cleared")
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.5)
    assert not files() - before
    assert table.count() == 1000 and spark.conf.get(shared.CLEAR_SHUFFLES, None) == setting


def paragraphs(text: str) -> set:
    return {p for p in text.split("\n") if p}


def test_sketches_equal_brute_force(spark, edge_rows):
    r = random.Random(4)
    texts = ["\n".join(f"line {r.randrange(9)}" for _ in range(r.randrange(12))) for _ in range(25)]
    texts += ["\n".join(f"row {i} of {j}" for i in range(n)) for j, n in enumerate((30, 120, 700))]
    rows = [(i, t) for i, t in enumerate(texts, 1000)] + [(x[0], x[1]) for x in edge_rows]
    df = spark.createDataFrame([(*x, "f") for x in rows], "doc_id long, text string, fingerprint string")
    got = P.fingerprints(spark, df).collect()
    # Documents in order of doc_id (null first); of rows with one id any may stand for the next document,
    # so ids with different texts (here: null) are compared with each of them.
    ids = sorted({x[0] for x in rows}, key=lambda i: (i is not None, i or 0))
    of = defaultdict(list)
    for i, t in rows:
        of[i].append(t or "")
    want = defaultdict(list)
    for place, i in enumerate(ids):
        for t in of[i]:
            options = []
            for following in of[ids[(place + 1) % len(ids)]]:
                half = len(t) // 2
                edited = t[: len(t) - half] + following[:half]
                options.append((edited, following))
            want[i].append((t, options))
    import hashlib

    def near(a: str, b: str) -> float:
        x, y = paragraphs(a), paragraphs(b)
        return len(x & y) / len(x | y) if x | y else 1.0

    left = {i: [(len(t), {(hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, f)) for e, f in o}) for t, o in v] for i, v in want.items()}
    for row in got:
        match = next(x for x in left[row.doc_id] if x[0] == row.n_chars and any(row.edited_sha256 == h and abs(row.near_edited - a) < 1e-9 and abs(row.near_next - b) < 1e-9 for h, a, b in x[1]))
        left[row.doc_id].remove(match)
    assert not any(left.values())


def test_fingerprints_of_equal_texts_and_empty_tables(spark, edges, nothing):
    rows = P.fingerprints(spark, edges).collect()
    first = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(rows) == edges.count() and len(first) == 1
    assert P.fingerprints(spark, nothing).count() == 0
    one = P.fingerprints(spark, edges.where("doc_id = 1")).first()
    assert (one.near_next, one.n_chars) == (1.0, 61)


def test_difference_recovers_every_digest(spark):
    r = np.random.default_rng(8)
    rows = []
    for k, n in enumerate((0, 1, 5, 9, 20, 60, 300)):
        a, b = r.integers(-(2**62), 2**62, (2, n))
        both = r.integers(-(2**62), 2**62, 15)
        rows.append((k, "x", sorted({*a.tolist(), *both.tolist()}), sorted({*b.tolist(), *both.tolist()})))
    pairs = spark.createDataFrame(rows, "id long, kind string, a array<long>, b array<long>")
    got = {x.id: (x.only_a, x.only_b) for x in P.differences(spark, pairs).collect()}
    assert got == {k: (len(set(a) - set(b)), len(set(b) - set(a))) for k, _, a, b in rows}
