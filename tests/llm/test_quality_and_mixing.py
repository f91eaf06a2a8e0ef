from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing as M
from logloom.llm import oracle, registry
from logloom.llm import quality_classifier as C
from logloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in text),
    }


def test_statistics_equal_brute_force(spark, edges, edge_rows):
    texts = ["a b c a b c", "a a a a", "x\nx\n x\n\n", "A#*b <c> | d", "a b c d a b c e a b c", "\x00    x"]
    rows = [*edge_rows, *[(100 + i, t, "en", "s", None, "", "", None, 0.0, "", 100 + i) for i, t in enumerate(texts)]]
    got = {r.row.n: r.base.asDict() for r in Q.statistics(spark.createDataFrame(rows, edges.schema)).collect()}
    assert got == {r[-1]: brute_statistics(r[1]) for r in rows}


def test_sketch_buckets_and_percentiles(spark):
    values = [0, 1, 5, 63, 64, 65, 127, 128, 129, 9999, 123456]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(Q.bucket(F.col("v"))).collect()]
    assert got == [(v >> max(v.bit_length() - 6, 0)) << max(v.bit_length() - 6, 0) for v in values]
    rows = [(k, "s", v) for k, n in (("a", 1), ("b", 7), ("c", 400)) for v in np.random.default_rng(n).integers(0, 60, n).tolist()]
    sketch = spark.createDataFrame(rows, "lang string, stat string, bucket long").groupBy("lang", "stat", "bucket").agg(F.count(F.lit(1)).alias("n"))
    for r in Q.percentiles(sketch, ["lang"]).collect():
        own = sorted(v for k, _, v in rows if k == r.lang)
        assert (r.p10, r.p50, r.p90) == tuple(own[-(-q * len(own) // 100) - 1] for q in (10, 50, 90))


def prose(i: int, extra: str = "", n: int = 120) -> str:
    return " ".join(f"word{(i * 7919 + k * 104729) % 100003}{'x' * ((i + k) % 5)}" for k in range(n)) + extra


def test_sources_need_different_limits(spark):
    """A source of formulas, in which symbols are ordinary, and one of prose: the same share of symbols is
    an outlier in one of them only, and far more is one in both."""
    rows = []
    for i in range(1200):
        rows.append((i, "en", "prose", prose(i)))
        rows.append((10_000 + i, "en", "formulas", prose(i, " $x$ " * (i % 40))))
    rows += [(50_000, "en", "prose", prose(1, " $x$ " * 30)), (50_001, "en", "formulas", prose(1, " $x$ " * 30))]
    rows += [(50_002, "en", "prose", prose(2, "$" * 20_000)), (50_003, "en", "formulas", prose(2, "$" * 20_000))]
    measured = Q.measure(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    limits = Q.limits_of(spark, measured)
    judged = {r.row.doc_id: r.failed_rule for r in Q.verdicts(measured, limits).collect()}
    assert [judged.pop(i) for i in (50_000, 50_001, 50_002, 50_003)] == ["symbol_rate", None, "symbol_rate", "symbol_rate"]
    assert not any(judged.values())
    assert "symbol_rate" in {r.source: r.decided for r in limits.collect()}["formulas"]


def test_most_limits_come_from_the_sketch(spark):
    """On the test documents: three of five limits, and no good document past the base rule is rejected."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "source", "text")
    measured = Q.stored(spark, Q.measure(docs).withColumn("row", F.struct("row.doc_id")), "test_measured")
    limits = Q.limits_of(spark, measured)
    decided = [len(r.decided) for r in limits.collect()]
    assert sum(decided) >= 0.55 * len(Q.JUDGED) * len(decided)
    judged = Q.verdicts(measured, limits).select(F.col("row.doc_id").alias("doc_id"), "base_failed", "kept")
    found = judged.where("not base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").agg(F.count("kept").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    n = {r.quality: (r.n, r.k) for r in found.collect()}
    assert n[1][0] == n[1][1] and n[0][1] <= 0.02 * n[0][0]


def test_rules_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rel = con.sql(oracle.oracle_sql()["op6_quality_rules"])
    want = {tuple(r) for r in rel.fetchall()}
    got = registry.op6_quality_rules(spark, folder).select(*rel.columns)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_rules_on_edges(spark, edges, nothing):
    limits = Q.limits_of(spark, Q.measure(edges))
    judged = Q.verdicts(Q.measure(edges), limits).collect()
    assert all(r.kept == (r.failed_rule is None) and (not r.base_failed or r.failed_rule == "base") for r in judged)
    assert all(not r.kept for r in judged if not r.row.text)
    kept = Q.filter_documents(spark, edges)
    assert kept.schema == edges.schema and kept.count() == sum(r.kept for r in judged)
    assert Q.filter_documents(spark, nothing).count() == 0
    assert Q.filter_documents(spark, edges.select("text")).columns == ["text"]


def brute_margins(trees: C.Trees, row: np.ndarray) -> float:
    total, inner = trees.base, trees.feature.shape[1]
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < inner:
            node = 2 * node + 1 + int(row[feature[node]] > cut[node])
        total += leaf[node - inner]
    return total


def test_trees_learn_and_flatten():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = C.fit(x[:2000], y[:2000], trees=30, depth=3)
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(trees.margins(x[:50]), [brute_margins(trees, row) for row in x[:50]])
    assert C.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert C.fit(x[:9], np.ones(9)).scores(x[:2]).min() > 0.5


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    trees = C.train(docs, labels, trees=30)
    found = C.score_documents(docs, trees).join(labels, "doc_id").where(registry.fold() == 0).select("quality", "score").toArrow().to_pandas()
    assert len(found) > 500 and ((found.score >= C.PREDICT_FROM) == (found.quality == 1)).mean() > 0.99


def test_classifier_on_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    trees = C.train(edges, labels)
    scores = [r.score for r in C.score_documents(edges, trees).collect()]
    assert len(scores) == edges.count() and all(0 <= s <= 1 for s in scores)
    assert np.isfinite(C.features(pa.array([None, "", " ", "a", "\n\n"]))).all()
    none = C.train(edges, labels.limit(0))
    assert {r.score for r in C.score_documents(edges, none).collect()} == {0.5}
    assert C.filter_documents(spark, edges, labels.limit(0)).schema == edges.schema
    assert C.filter_documents(spark, nothing, labels).count() == 0


def brute_rake(tokens: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
    w = tokens.astype(float)
    for _ in range(500):
        for axis, share in enumerate(shares):
            other = tuple(a for a in range(tokens.ndim) if a != axis)
            now = w.sum(other)
            shape = [1] * tokens.ndim
            shape[axis] = -1
            w = w * np.divide(share, now, out=np.zeros_like(now), where=now > 0).reshape(shape)
    return w


def test_raking_equals_brute_force(spark):
    r = np.random.default_rng(5)
    tokens = r.integers(1, 500, (3, 2, 2))
    tokens[0] *= 30  # a hot source
    tokens[1, 1, 0] = 0
    cells = spark.createDataFrame(
        [(f"=s{i}", f"=l{j}", f"=t{k}", int(tokens[i, j, k])) for i, j, k in np.ndindex(3, 2, 2) if tokens[i, j, k]], "c_source string, c_lang string, c_topic string, tokens long"
    )
    lang = tokens.sum((0, 2)) ** 0.5
    topic = tokens.sum((0, 1))
    targets = {"source": {"s0": 0.2, "s1": 0.5}, "lang": 0.5, "topic": 1.0}
    want = brute_rake(tokens, [np.array([0.2, 0.5, 0.3]), lang / lang.sum(), topic / topic.sum()])
    rows = M.rake(spark, cells, targets).collect()
    assert len(rows) == 11
    for row in rows:
        i, j, k = int(row.c_source[2]), int(row.c_lang[2]), int(row.c_topic[2])
        assert row.weight == pytest.approx(want[i, j, k], rel=1e-4)


def test_sample_follows_the_targets(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 4)) as source", "if(id % 5 = 0, 'de', 'en') as lang", "repeat('word ', cast(id % 50 + 1 as int)) as text")
    targets = {"source": {"hot": 0.1}, "lang": 1.0, "topic": 1.0}
    kept = M.sample_documents(spark, docs, targets=targets, budget_share=0.5)
    n = dict(kept.groupBy(F.col("source") == "hot").agg(F.sum(F.size(F.split("text", " ")) - 1)).collect())
    total = docs.agg(F.sum(F.size(F.split("text", " ")) - 1)).first()[0]
    assert n[True] / (n[True] + n[False]) == pytest.approx(0.1, abs=0.01)
    assert (n[True] + n[False]) / total == pytest.approx(0.5, abs=0.02)
    assert kept.schema == docs.schema and kept.select("doc_id").distinct().count() == kept.count()


def test_production_sample_meets_its_targets(spark):
    """At the production budget: every source, language and topic has its target share of the expected
    sample, and of the drawn one within a hundredth."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "lang", "text")
    rows = M.stored(spark, M.measured(docs).drop("row"), "test_rows")
    cells = M.cell_probabilities(spark, rows)
    found = cells.toArrow().to_pandas()
    assert found.probability.max() <= 1
    size = (found.tokens * found.probability).sum() / found.tokens.sum()
    assert 0.6 < size <= M.BUDGET_SHARE
    kept = M.drawn(rows, cells).where("kept").groupBy("c_source", "c_lang", "c_topic").agg(F.sum("n_tokens").alias("t")).toArrow().to_pandas()
    for name, exponent in M.TARGETS.items():
        key = f"c_{name}"
        have = found.groupby(key).tokens.sum()
        want = have**exponent / (have**exponent).sum()
        expected = (found.tokens * found.probability).groupby(found[key]).sum()
        assert np.allclose(expected / expected.sum(), want, rtol=5e-3)
        drawn = kept.groupby(key).t.sum()
        assert np.abs(drawn / drawn.sum() - want).max() < 0.01


def test_mixing_edges(spark, edges, nothing):
    kept = M.sample_documents(spark, edges, budget_share=1.0)
    assert kept.schema == edges.schema and kept.where("text is null or trim(text) = ''").count() == edges.where("text is null or trim(text) = ''").count()
    assert M.sample_documents(spark, nothing).count() == 0
    assert M.sample_documents(spark, edges.select("text"), budget_share=1.0).columns == ["text"]
