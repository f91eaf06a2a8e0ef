from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.llm import license_scan as L
from logloom.llm import toxicity as X
from logloom.llm.shared import fold

BAD = ["vilething", "nastyword", "grimslur"]


def corpus(n: int) -> list[tuple[int, str, int]]:
    """Random prose; toxic texts hold a few bad words, or words of one bad stem."""
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "to", "mi", "ren") for b in ("lor", "nu", "ska") for c in ("", "t", "ing", "es", "ol")]
    rows = []
    for i in range(n):
        text = [words[int(len(words) * r.random() ** 2)] for _ in range(r.choice((20, 80, 300, 900)))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(text) // 60)):
                text[r.randrange(len(text))] = r.choice(BAD) if i % 12 else f"qzxw{r.randrange(10**6)}"
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def given(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = given(spark, corpus(1500))
    model = X.train(spark, docs, labels)
    found = X.score_documents(docs, model).join(labels, "doc_id").where(fold() == 0).toArrow().to_pandas()
    assert len(found) > 200
    predicted = found.score >= 0.5
    assert (predicted & (found.toxic == 0)).sum() <= 1
    assert (predicted & (found.toxic == 1)).sum() >= 0.9 * found.toxic.sum()
    # The models alone, without the curve: toxic texts stand above nearly all ordinary ones.
    usual = found.log_ratio_per_word[found.toxic == 0].quantile(0.95)
    assert (found.log_ratio_per_word[found.toxic == 1] > usual).mean() > 0.9


def brute_model(rows: list[tuple]) -> dict:
    """The module's formulas over Python dictionaries; rows: (text, label)."""
    words_of = [brute_words(t) for t, _ in rows]
    n, c, before = {}, {}, {}

    def count(seen: set, label: int) -> None:
        for x in seen:
            n.setdefault(x, [0, 0])[label] += 1

    for words, (_, label) in zip(words_of, rows, strict=True):
        pairs = {("pair", u, v) for u, v in zip(["<start>", *words], words, strict=False)}
        count({("word", w) for w in words} | {("stem", w[: X.STEM_BYTES]) for w in words if len(w) > X.STEM_BYTES} | pairs, label)
        for _, u, v in pairs:
            before.setdefault(v, set()).add(u)
    prior, gain = sum(label for _, label in rows) / len(rows), 0.5 * np.log(len(rows))

    def share(x: tuple, below: float) -> float:
        n0, n1 = n[x]
        won = sum(k * np.log(k / (n0 + n1) / b) for k, b in ((n1, below), (n0, 1 - below)) if k)
        return (n1 + X.SHARED_COUNTS * below) / (n0 + n1 + X.SHARED_COUNTS) if won >= gain else below

    stems = {x[1]: share(x, prior) for x in n if x[0] == "stem" and sum(n[x]) >= X.LEAST_COUNT}
    known = {x[1] for x in n if x[0] == "word" and sum(n[x]) >= X.LEAST_COUNT}

    def stem(w: str) -> str | None:
        return w[: X.STEM_BYTES] if len(w) > X.STEM_BYTES and w[: X.STEM_BYTES] in stems else None

    def event(w: str) -> tuple:
        return ("word", w) if w in known else ("stem", stem(w)) if stem(w) else ("other",)

    events = {("stem", z): [1, 1, s] for z, s in stems.items()} | {("other",): [1, 1, prior]}
    for x in [x for x in n if x[0] == "word"]:
        e = events.setdefault(event(x[1]), [0, 0, None])
        e[0] += sum(n[x])
        e[1] += len(before[x[1]])
        if event(x[1]) == x:
            e[2] = share(x, stems.get(stem(x[1]), prior))
    c = {e: v[2] for e, v in events.items()}
    single, pair, left = {}, {}, {}
    for k in (0, 1):
        of = (lambda s: s) if k else (lambda s: 1 - s)
        total, g, cont = sum(v[0] * of(v[2]) for v in events.values()), sum(X.DISCOUNT * of(v[2]) for v in events.values()), sum(v[1] for v in events.values())
        for e, v in events.items():
            single[e, k] = (v[0] - X.DISCOUNT) * of(v[2]) / total + g / total * v[1] / cont
        for u in {x[1] for x in n if x[0] == "pair"}:
            mine = [x for x in n if x[0] == "pair" and x[1] == u]
            good = {x[2]: share(x, c["word", x[2]]) for x in mine if sum(n[x]) >= X.LEAST_COUNT}
            good = {v: of(s) for v, s in good.items() if s != c["word", v]}
            if not good:
                continue
            size = {v: sum(n["pair", u, v]) for v in good}
            m = sum(size[v] * good[v] for v in good) + sum(sum(n[x]) for x in mine if x[2] not in good) * of(c.get(("word", u), prior))
            left[u, k] = 1 - sum((size[v] - X.DISCOUNT) * good[v] for v in good) / m
            for v in good:
                pair[u, v, k] = (size[v] - X.DISCOUNT) * good[v] / m + left[u, k] * single[("word", v), k]
    return {"single": single, "pair": pair, "left": left, "event": event}


def brute_evidence(model: dict, text: str) -> float:
    total, u, sign = 0.0, "<start>", (-1, 1)
    for w in brute_words(text):
        for k in (0, 1):
            p = model["pair"].get((u, w, k)) or model["left"].get((u, k), 1.0) * model["single"][model["event"](w), k]
            total += sign[k] * np.log(p)
        u = w
    if u != "<start>":
        total += sum(sign[k] * np.log(model["left"].get((u, k), 1.0)) for k in (0, 1))
    return total


def test_class_models_equal_brute_force(spark, monkeypatch):
    """Every evidence is the difference of both models' log-likelihoods, worked out from the definition."""
    monkeypatch.setattr(X, "STEPS", 1 << 20)
    monkeypatch.setattr(X, "TASK_ENTRIES", 50)
    monkeypatch.setattr(X, "SLOTS", 512)
    rows = corpus(260)
    docs, labels = given(spark, rows)
    counted = X.labelled(docs, labels, "toxic")
    taken = [(r.text, r.label) for r in counted.collect()]
    found = X.tables(spark, X.stored(spark, X._counted(counted), "test_counts"), len(taken), sum(label for _, label in taken))
    brute = brute_model(taken)
    weights = X.weights(found)
    model = X.Model(weights, found.other, found.start, X._map_of(weights), np.zeros(3))
    got = {r.doc_id: r.evidence for r in X.evidence(docs, model).collect()}
    assert max(abs(got[i] - brute_evidence(brute, text)) for i, text, _ in rows) < 1e-3
    assert max(map(abs, got.values())) > 5


def test_class_models_sum_to_one(spark):
    """P_c(e) over all events, and P_c(v|u) over them for every word before, for each class."""
    docs, labels = given(spark, corpus(400))
    counted = X.labelled(docs, labels, "toxic")
    size = {r.label: r["count"] for r in counted.groupBy("label").count().collect()}
    found = X.tables(spark, X.stored(spark, X._counted(counted), "test_counts"), size[0] + size[1], size[1])
    events, pairs = found.events.toArrow().to_pandas(), found.pairs.toArrow().to_pandas()
    own = (events.c[events.kind == "word"] != size[1] / (size[0] + size[1])).mean()
    assert len(events) > 40 and 0.02 < own < 1
    for k in ("0", "1"):
        assert abs(events["p" + k].sum() - 1) < 1e-9
        for _, mine in pairs.groupby("u"):
            left = mine["l" + k].iloc[0]
            assert abs(mine["p" + k].sum() + left * (1 - mine["q" + k].sum()) - 1) < 1e-9
    assert pairs.u.nunique() > 3


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (5, 0), (6, 0), (7, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        scored = X.score_documents(edges, X.train(spark, edges, some)).collect()
        assert len(scored) == edges.count() and all(0 <= r.score <= 1 and np.isfinite(r.log_ratio_per_word) for r in scored)
    assert X.score_documents(nothing, X.train(spark, nothing, labels)).count() == 0


def test_rare_words_stay_known_beside_many_others(spark):
    """A word of four toxic training documents has a weight of its own beside two million other counts."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(7000))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in texts], "doc_id long, toxic int")
    fold_of = {r.doc_id: r.f for r in docs.select("doc_id", fold().alias("f")).collect()}
    chosen = [i for i in range(0, 400, 10) if fold_of[i] in (2, 3, 4)][:4]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(chosen), F.concat("text", F.lit(" zyxwrareword"))).otherwise(F.col("text")))
    model = X.train(spark, docs, labels)
    _, stems, _, _, _ = next(X._words(pa.array(["zyxwrareword"])))
    assert model.weights.where(F.col("code") == int(stems[0] | X.STEM << 32)).first()["weight"] > X.STEPS // 2


def brute_words(text: str) -> list[str]:
    out, word = [], b""
    for b in text.encode() + b" ":
        if bytes([b]).isalnum() or b == 39 or b > 127:
            word += bytes([b]).lower() if b < 128 else bytes([b])
        elif word:
            out.append(word.decode("utf-8", "replace"))
            word = b""
    return out


def edit_matches(template: list[str], region: list[str]) -> int:
    """Most equal words over all alignments (no band), by longest common subsequence."""
    best = [0] * (len(region) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(region, 1):
            new.append(max(best[j], new[-1], best[j - 1] + (t == w)))
        best = new
    return best[-1]


def test_licenses_equal_brute_force(spark):
    r = random.Random(6)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "the", "license", "version"]
    rows, planted = [], {}
    every = [(name, t) for name, texts in L.TEMPLATES.items() for t in texts]
    for i, (name, text) in enumerate(every * 2):
        words = text.split(" ")
        if i >= len(every) and len(words) > 15:  # an edited long notice
            words[4], words[9] = "altered", "words inserted here"
        before = " ".join(r.choice(filler) for _ in range(r.randrange(30)))
        notice = " ".join(words)
        rows.append((i, f"é {before}\n{notice} {r.choice(filler)}"))
        planted[i] = (name, notice)
    rows += [(900, None), (901, ""), (902, " ".join(filler * 50)), (None, "Released under the MIT License."), (903, "Released under the MIT License. x " * 3)]
    got = L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for i, (name, notice) in planted.items():
        own = [g for g in got if g.doc_id == i]
        assert [g.license for g in own] == [name], (i, name, own)
        span = texts[i][own[0].start : own[0].end]
        assert span.strip(".") in notice and len(span) >= 0.8 * len(notice)
        template = max((brute_words(t) for t in L.TEMPLATES[name]), key=lambda t: edit_matches(t, brute_words(notice)) / len(t))
        assert own[0].matched_words == edit_matches(template, brute_words(notice)) and own[0].template_words == len(template)
    others = [g for g in got if g.doc_id not in planted]
    assert sorted((g.doc_id or -1, g.start) for g in others) == [(-1, 0), (903, 0), (903, 34), (903, 68)]


def test_license_edges(spark, edges, nothing):
    assert L.scan_documents(edges).count() == 0 and L.scan_documents(nothing).count() == 0


def test_winnowing_keeps_every_shared_run():
    r = np.random.default_rng(2)
    for _ in range(50):
        run = r.integers(0, 2**60, L.GRAM + L.WINDOW - 1).astype(np.uint64)
        texts = [np.concatenate([r.integers(0, 2**60, k).astype(np.uint64), run, r.integers(0, 2**60, 9 - k).astype(np.uint64)]) for k in (2, 7)]
        found = [set(L.gram_hashes(t, L.winnowed(t, np.zeros(len(t), int))).tolist()) for t in texts]
        assert found[0] & found[1]


def test_index_is_of_the_templates():
    index = L.Index.of({"a": ["one two three four five"], "b": ["one two three"]})
    assert sorted(set(index.template.tolist())) == [0, 1] and (np.diff(index.hashes.astype(np.float64)) >= 0).all()
    assert L.scan_texts(index, pa.array(["x one two three four five y"]), 0.8)[0][:4] == (0, "a", 5, 5)



def test_one_word_edits_of_every_template():
    """A word altered, left out or put in, at every place: found with the words that brute force finds,
    and not at all without a word of the license's name or version."""
    for name, texts in L.TEMPLATES.items():
        for text in texts:
            template = brute_words(text)
            index = L.Index.of({name: [text]})
            edits = [(put, cut, i) for i in range(len(template)) for put, cut in ((["altered"], 1), ([], 1), (["inserted"], 0))]
            edited = [template[:i] + put + template[i + cut :] for put, cut, i in edits]
            got = L.scan_texts(index, pa.array(["lorem ipsum " + " ".join(e) + " dolor" for e in edited]), 0.8)
            least = [edit_matches(template, e) >= 0.8 * len(template) and not (cut and index.distinct[0][i]) for e, (_, cut, i) in zip(edited, edits, strict=True)]
            assert [g[:3] for g in got] == [(k, name, edit_matches(template, edited[k])) for k in range(len(edits)) if least[k]], text


def test_licenses_keep_their_own_names():
    gpl = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, {}"
    later = "either version {} of the License, or (at your option) any later version."
    given = {
        gpl.format("program", "", later.format(3)): ["GPL-3.0-or-later"],
        gpl.format("library", "", later.format(2)): ["GPL-2.0-or-later"],
        gpl.format("library", "Lesser ", later.format("2.1")): ["LGPL-2.1-or-later"],
        gpl.format("library", "Library ", later.format(2)): ["LGPL-2.0-or-later"],
        gpl.format("program", "Affero ", later.format(3)): ["AGPL-3.0-or-later"],
        gpl.format("program", "", "version 2 of the License."): ["GPL-2.0-only"],
        gpl.format("program", "", later.format(4)): [],
        L._BSD + ":": ["BSD-2-Clause OR BSD-3-Clause"],
        L._BSD_2 + " THIS SOFTWARE IS PROVIDED": ["BSD-2-Clause"],
        L._BSD_2 + " 3. " + L._BSD_CLAUSE_3.replace("the copyright holder", "ACME") + ". THIS SOFTWARE IS PROVIDED": ["BSD-3-Clause"],
        "Released under the BSD License.": [],
        "Released under the Artistic License.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under the Apache License, Version 2.0": ["Apache-2.0"],
        "This work is licensed under the GNU General Public License, version 3.1": [],
        "This work is licensed under the GNU General Public License, version 3.0": ["GPL-3.0-only"],
        "This work is licensed under the GNU General Public License, version 3 or later.": ["GPL-3.0-or-later"],
        "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"],
        "Licensed under CC BY-SA 3.0.": ["CC-BY-SA-3.0"],
        "Licensed under CC BY-SA 5.0.": [],
        "Licensed under CC BY-NC-XX-SA 4.0 and more": ["CC-BY-NC-SA-4.0"],
    }
    got = L.scan_texts(L.Index.of(L.TEMPLATES), pa.array(list(given)), 0.8)
    assert {t: [g[1] for g in got if g[0] == i] for i, t in enumerate(given)} == given
