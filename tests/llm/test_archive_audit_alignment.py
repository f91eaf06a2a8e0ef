"""WARC archives and their index, source divergence, token alignment: against brute force and SQL."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from logloom.llm import oracle, registry, source_divergence, token_alignment, warc_archive

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, key string, top long, file string, refers_to long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql(name, **tables):
    con = duckdb.connect()
    for table, value in tables.items():
        con.register(table, value) if not isinstance(value, str) else con.sql(f"create view {table} as select * from '{value}'")
    return con.sql(oracle.oracle_sql()[name]).fetchall(), [c[0] for c in con.sql(oracle.oracle_sql()[name]).description]


# WARC


def page_rows():
    long = "é" * 500  # 1,000 bytes
    html = [(1, "http://Blog.Example.com:80/a?x=1#top", long), (2, "https://blog.example.com/a?x=1", long), (3, "http://b.example.com", "short"), (4, "http://b.example.com/", "short")]
    html += [(5, None, None), (6, "", ""), (7, "not a url", "x" * 999), (8, "not a url", "x" * 999), (None, "http://c.org/1", long), (None, "http://c.org/2", "n" * 2000), (None, "http://c.org/2", "n" * 2000)]
    html += [(9, "http://d.org/\r\nWARC-Type: revisit", "a\r\n\r\nb" * 300), (10, "http://user:pw@[::1]/x y", "a\r\n\r\nb" * 300), (10, "http://user:pw@[::1]/x y", "a\r\n\r\nb" * 300)]
    html += [(100 + i, "http://hot.example.net/same", "hot page " * 200) for i in range(60)] + [(200 + i, f"http://hot.example.net/{i}", "many " * 40_000) for i in range(3)]
    return [(*r, "k", 1, "f", 0) for r in html]


def expected_pages(pages):
    top = {}
    for page_id, _, html, *_ in pages:
        if len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html, *_ in pages:
        raw = (html or "").encode()
        first = top.get(html, -1)
        revisit = first >= 0 and first != page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


CONTRACT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_archive_reads_back_every_page(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(warc_archive, "HOT_ROWS", hot_rows)
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    archive = warc_archive.write_archive(spark, pages, file_bytes=3000, block_lines=4)
    found = warc_archive.read_captures(warc_archive.lookup(spark, archive, pages.select("url")))
    assert rows(found.select(*CONTRACT)) == expected_pages(page_rows())
    texts = {r["page_id"]: r["payload"] for r in found.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert texts[10] == "a\r\n\r\nb" * 300 and texts[5] == "" and texts[202] == "many " * 40_000


def test_lookup_reads_only_asked_keys(spark):
    pages = spark.createDataFrame(page_rows(), PAGES)
    archive = warc_archive.write_archive(spark, pages, file_bytes=3000, block_lines=4)
    asked = spark.createDataFrame([("http://blog.example.com/a?x=1",), ("http://hot.example.net/same#z",), ("http://nowhere.example/",), (None,), ("http://blog.example.com/a?x=1",)], "url string")
    found = warc_archive.lookup(spark, archive, asked).captures.collect()
    ids = Counter(r["page_id"] for r in found)
    assert ids == Counter([1, 2, 5, 6, *range(100, 160)])
    assert {r["url_key"] for r in found} == {"com,example,blog)/a?x=1", "net,example,hot)/same", ""}


def test_files_are_warc_and_neighbours_share_the_index(spark):
    pages = spark.createDataFrame(page_rows(), PAGES).coalesce(1)
    archive = warc_archive.write_archive(spark, pages, block_lines=4)
    folder = warc_archive._Folder(archive.path)
    names = [f.path for f in folder.fs.get_file_info(warc_archive.fs.FileSelector(f"{folder.path}/warc"))]
    records = 0
    for name in names:
        with folder.fs.open_input_file(name) as f:
            text = gzip.decompress(f.read())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        at = 0
        while at < len(text):  # record after record, by their lengths
            end = text.index(b"\r\n\r\n", at) + 4
            at = end + int(text[at:end].split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
            assert text[at : at + 4] == b"\r\n\r\n"
            at += 4
            records += 1
    assert records == len(page_rows()) + len(names)
    assert list(archive.index) == sorted(archive.index, key=lambda f: f[1])
    assert all(a <= b for _, a, b in archive.index)


def test_damaged_payload_is_noticed():
    raw = warc_archive.record(1, "http://a.org/", b"payload", None)
    assert warc_archive.parse_record(raw)["payload"] == "payload"
    with pytest.raises(ValueError, match="digest"):
        warc_archive.parse_record(raw.replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n"))


def test_archive_query_equals_sql(spark):
    want, names = sql("op11_warc_archive", pages=f"{SF}/pages.parquet")
    assert rows(registry.queries()["op11_warc_archive"](spark, SF).select(*names)) == sorted(want, key=repr)


def test_empty_archive(spark):
    pages = spark.createDataFrame([], PAGES)
    archive = warc_archive.write_archive(spark, pages)
    assert archive.index == () and warc_archive.read_captures(warc_archive.lookup(spark, archive, pages)).count() == 0


# Source divergence


def brute_audit(documents, least_docs=3, k=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in documents:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        text = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text or "")
        terms = [t for t in text.split(" ") if t]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = [g[1] for g in groups if g[0] == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            over = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < k]
    return sorted(out, key=repr)


def random_documents(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "ÄLPHA", "Δelta", "x1y", "it's", "中文", "rare%d"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    out = [(None, None, None), ("", "en", "s0"), ("only three words", "la", "s0"), ("12 34 --", "xx", "s1"), ("", "xx", "s2")]
    for i in range(n):
        text = rng.choice([" ", ", ", "\x00"]).join(rng.choice(words[: rng.randint(3, len(words))]).replace("%d", str(i)) for _ in range(rng.randint(0, 40)))
        out.append((text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", "s2", "é", None])))
    return out


@pytest.mark.parametrize("k", [3, 200])
def test_audit_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 50)
    documents = random_documents(4, 300) * 2  # repeated rows
    schema = "text string, lang string, source string, n long, term string, p long, place int"
    docs = spark.createDataFrame([(*d, 1, "t", 2, 3) for d in documents], schema).repartition(5)
    assert rows(source_divergence.audit(spark, docs, k=k)) == brute_audit(documents, k=k)


def test_audit_of_edges_and_nothing(spark, edges, nothing, edge_rows):
    assert rows(source_divergence.audit(spark, edges)) == brute_audit([(r[1], r[2], r[3]) for r in edge_rows])
    assert source_divergence.audit(spark, nothing).count() == 0


def test_skyband_keeps_exactly_the_little_dominated(monkeypatch):
    monkeypatch.setattr(source_divergence, "COMPARED", 7)
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (40, 1), (300, 5), (300, 400)):
        count, low = rng.integers(1, 9, n), rng.integers(1, 9, n)
        term = [f"t{i}".encode() for i in rng.permutation(n)]
        over = [sum(count[a] >= count[b] and low[a] <= low[b] and term[a] < term[b] for a in range(n)) for b in range(n)]
        assert sorted(source_divergence.skyband(count, low, term, k)) == [b for b in range(n) if over[b] < k]


def test_audit_query_equals_sql(spark):
    want, names = sql("op12_source_divergence", documents=f"{SF}/documents.parquet")
    assert rows(registry.queries()["op12_source_divergence"](spark, SF).select(*names)) == sorted(want, key=repr)


# Token alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(documents):
    t = token_alignment.Tokenizers(*FILES)
    found, count = [], Counter()
    for _, text in documents:
        ids = t.encode(text) if text else None
        if ids is None:
            found.append(None)
            continue
        spans = []
        for names, mine in zip((t.a_bytes, t.b_bytes), ids, strict=True):
            at = 0
            spans.append([(at, at := at + len(names[i]), i) for i in mine])
        # Sweep over both lists of spans.
        links, groups, i, j = [], [([], [])], 0, 0
        while i < len(spans[0]) and j < len(spans[1]):
            a, b = spans[0][i], spans[1][j]
            links.append((a[2], b[2]))
            if a[1] <= b[1]:
                groups[-1][0].append(str(a[2]))
                i += 1
            if b[1] <= a[1]:
                groups[-1][1].append(str(b[2]))
                j += 1
            if a[1] == b[1]:
                groups.append(([], []))
        found.append((len(ids[0]), len(ids[1]), groups[:-1], links))
        count.update(set(links))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), one in zip(documents, found, strict=True):
        if one is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = one
            digest = hashlib.sha256(";".join(",".join(a) + "|" + ",".join(b) for a, b in groups).encode()).hexdigest()
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


ODD = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "é", "汉", "<|endoftext|>", "<s>", "'s", "don't", "1", "23", "\xa0", "\x1c", ".", ",", "😀", "<0x41>", "word", "words", "\r\n", "▁", "ﬁ", "\x00"]


def test_alignment_equals_brute_force_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "HELD_LINKS", 300)
    monkeypatch.setattr(token_alignment, "TASK_ENTRIES", 20)
    monkeypatch.setattr(token_alignment, "ENTRIES_PER_COUNT", 1)
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 50)
    rng = random.Random(9)
    documents = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    documents += [(1, "word " * 40_000), (1, "word " * 40_000), (None, "words words"), (None, None), (2, "a\nb"), (3, "汉" * 5000)]
    docs = spark.createDataFrame([(*d, 7, "s", None) for d in documents], "doc_id long, text string, slot int, bucket string, pairs binary").repartition(3)
    assert rows(token_alignment.align_documents(spark, docs, *FILES)) == brute_alignment(documents)


def test_alignment_of_documents_edges_and_nothing(spark, edges, nothing, edge_rows):
    table = registry.table(spark, SF, "documents").select("doc_id", "text")
    assert rows(registry.queries()["op13_token_alignment"](spark, SF)) == brute_alignment([tuple(r) for r in table.collect()])
    assert rows(token_alignment.align_documents(spark, edges, *FILES)) == brute_alignment([r[:2] for r in edge_rows])
    assert token_alignment.align_documents(spark, nothing, *FILES).count() == 0


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    pair = np.sort(rng.integers(0, 50, 4000)) ** 2
    slot = rng.integers(0, token_alignment.SLOTS, 4000)
    pair[2000:], slot[2000:3000] = 9000, np.arange(1000)  # one frequent pair
    keys, times = np.unique(np.stack([pair, slot]), axis=1, return_counts=True)
    weight = times * rng.integers(1, 90_000, len(times))
    row = token_alignment.pack_postings(keys[0], keys[1], weight)
    got = token_alignment.unpack_postings(row)
    assert (np.repeat(got[0], got[1]) == keys[0]).all() and (got[2] == keys[1]).all() and (got[3] == weight).all()
    assert (token_alignment.document_counts(row["pairs"], row["sizes"], row["dense"])[1] == np.unique(keys[0], return_counts=True)[1]).all()


def test_multiplicities_beyond_their_field_are_kept():
    key = np.array([5, 9], np.int64)
    weight = np.array([3, 40_000], np.int64)
    part = token_alignment._entries(key, weight)
    merged = token_alignment._merged([part, part])
    _, _, slot, total = token_alignment._split(merged, 10)
    assert slot.tolist() == [5, 9] and total.tolist() == [6, 80_000]
