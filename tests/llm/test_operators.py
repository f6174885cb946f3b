"""The training-data operators against plain versions, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import components as C
from graphloom.llm import graph_ann, jaccard_join, language_id, line_dedup, packing, quality_rules, queries, range_coder, sentencepiece_bpe, suffix_dedup, textkit, token_files, warc

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, k):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, copies, near copies, repeated rows, columns with names that operators use."""
    rnd = random.Random(1)
    words = [rnd.choice(["alpha", "Beta", "gämma", "δ", "x1", "the"]) + str(rnd.randint(0, 60)) for _ in range(4000)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([3, 8, 40, 120]))) for _ in range(12)]
    texts = [None, "", " \n\t", "one", "One two", "a\n\nb\na\n\nb\na", " ".join(words), "日本語のテキスト " * 30, "\x00 　 x", "a" * 3000, "é" * 200, "<|endoftext|>  two  spaces </s> ▁x"]
    for t in base:
        w = t.split(" ")
        texts += [t, t, t.upper(), " ".join(w[:-1] + ["new"]), t + " " + base[0], t.replace(" ", "\n"), "head\n" + t.replace(" ", "\n")]
    rows = [(i, t, None if i % 5 == 0 else ["en", "de"][i % 2], None, i) for i, t in enumerate(texts)]
    rows += [rows[13], rows[13], (None, base[1], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, doc string, n_chars long").withColumnRenamed("doc", "ranges")


def once(df):
    return {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def test_components(spark):
    rnd = random.Random(2)
    for n, m in ((50, 40), (300, 250), (200, 1000)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 60)] + [(None, 1)]
        got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = union_find(range(n + 61), [(a, b) for a, b in edges if a is not None])
        touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
        assert got == {x: want[x] for x in touched}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(odd, nothing, k, percent):
    texts = once(odd)
    sets = {d: shingles(t, k) for d, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    got = jaccard_join.jaccard_components(odd, words=k, percent=percent).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.doc_id is None and r.component_id is None or (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_blocks_of_one_large_neighbourhood(spark, monkeypatch):
    """Neighbourhoods larger than a block are searched as pairs of blocks, with the same result."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 57 + i % 3] + [f"n{rnd.randint(0, 30)}" for _ in range(3)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, words=2, percent=85).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 700)
    assert whole == {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, words=2, percent=85).collect()}
    assert len(set(whole.values())) < 80


def test_search_finds_every_link():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        edges = np.array(jaccard_join.bands(1 << 20, percent))
        for _ in range(12):
            vocabulary = rng.integers(0, 2**62, 300).astype(np.uint64)
            sets = []
            for _ in range(5):
                base = rng.choice(vocabulary, rng.integers(3, 80), replace=False)
                for _ in range(rng.integers(1, 20)):
                    k = int(rng.integers(0, max(1, len(base) // 8) + 1))
                    x = np.concatenate((base[rng.permutation(len(base))[k:]], rng.integers(0, 2**62, rng.integers(0, k + 1)).astype(np.uint64)))
                    if len(x):
                        sets.append(np.unique(x))
            plain = [set(x.tolist()) for x in sets]
            links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j])]
            assert union_find(range(len(sets)), links) == union_find(range(len(sets)), jaccard_join.search(sets, percent))
            keys = [set(jaccard_join.routing_keys(x, percent, edges).tolist()) for x in sets]
            assert all(plain[i] == plain[j] or keys[i] & keys[j] for i, j in links)


def test_sentencepiece_equals_the_library(odd, nothing):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.codec(path)
    rnd = random.Random(3)
    pool = list("abcdeé  ▁\n\t\x00ßü中文字🙂aaaabbb  111..--́ ﻿") + ["  ", "the", "tion", "====", "return", "\r\n", "<s>", "</s>", "<0x41>"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [t for t in once(odd).values() if t]
    for t in texts:
        ids = m.encode(t, add_bos=True, add_eos=True)
        mine = own.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids and own.decode(mine) == m.decode(ids), t
    for _ in range(3000):
        ids = [rnd.choice([rnd.randint(3, 258), rnd.randint(3, 31999), 1, 2, 0]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(np.array(ids, dtype="<u4")) == m.decode(ids), ids
    got = {r.doc_id: r for r in sentencepiece_bpe.round_trip(odd, path).collect()}
    for d, t in once(odd).items():
        ids = m.encode(t or "", add_bos=True, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(m.decode(ids).encode()).hexdigest()
    encoded = sentencepiece_bpe.encode_documents(odd, path)
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode_documents(encoded, path).collect()}
    assert back[13] == once(odd)[13] and sentencepiece_bpe.round_trip(nothing, path).count() == 0


def repeated_bytes(texts, length):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        cover = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(b[i : i + length])
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("length", [100, 64, 130])
def test_suffix_dedup(odd, nothing, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD_RUNS", 5)
    want = repeated_bytes(once(odd), length)
    got = suffix_dedup.suffix_dedup(odd, length=length).collect()
    assert len(got) == odd.count() and sum(w[1] for w in want.values()) > 0
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_dedup_of_periodic_and_overlapping_texts(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.choice([100, 101, 130, 260]))) for _ in range(6)]
    rows = []
    for d in range(120):
        parts = [rnd.choice([rnd.choice(base), rnd.choice(base)[: rnd.randint(0, 260)], rnd.choice(base)[rnd.randint(0, 100) :], "a" * rnd.randint(0, 300), "xy" * rnd.randint(0, 90)]) for _ in range(rnd.randint(0, 6))]
        rows.append((d, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeated_bytes(dict(rows), 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == want
    monkeypatch.setattr(suffix_dedup, "HELD_POSITIONS", 50)
    for length in (64, 140, 201):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, length=length).collect()}
        assert got == repeated_bytes(dict(rows), length)
    import pyarrow as pa

    # very large classes arrive in pieces, and in every round the same positions go on
    schema = pa.schema([(c.split(" ")[0], pa.list_(pa.int64()) if c.endswith("array<long>") else pa.int64()) for c in suffix_dedup.POSITIONS.split(", ")])
    rows = [(1, 5, d, 0, 0, [9]) for d in range(7)] + [(1, 6, 7, 3, 0, [9])] + [(2, 5, 9, s, 0, [s]) for s in (5, 6)] + [(8, 1, 1, 1, 0, [0]), (1 << 60, 1, 4, 0, 140, [])]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in suffix_dedup._reranked(100, True)(iter(batches)) for r in b.to_pylist()]
        gone = Counter()
        for d, _, n in found:
            gone[d] += n
        assert gone == {1: 100, 2: 100, 3: 100, 4: 240, 5: 100, 6: 100, 9: 100}
        onward = [tuple(r.values()) for b in suffix_dedup._reranked(130, False)(iter(batches)) for r in b.to_pylist()]
        assert sorted((d, s, z, n) for _, n, d, s, z, _ in onward if not z) == sorted([(d, 0, 0, 9) for d in range(7)] + [(9, 5, 0, 5), (9, 6, 0, 6)])
        ranks = {}
        for r, _, d, _, z, _ in onward:
            ranks.setdefault(r, set()).add((d, z))
        assert sorted(map(len, ranks.values())) == [1, 1, 7]


def test_language_id(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict(docs, language_id.fit(language_id.training_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out())
    assert out.where("lang_pred = lang").count() / out.count() > 0.95
    assert out.where("rejected").count() == 0 and out.where("score < 0 or score > 1").count() == 0
    crc = [(d, zlib.crc32(str(d).encode()) % 3 == 1) for d in range(50)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d, _ in crc], "doc_id long").select("doc_id", language_id.held_out()).collect()}
    assert got == dict(crc)
    model = language_id.fit(language_id.training_rows(odd))
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == odd.count()
    texts = once(odd)
    for r in rows:
        t = texts.get(r.doc_id) if r.doc_id is not None else "x"
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t)), (t, r)
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(nothing)).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0
    assert language_id.recognised(spark, odd, "").columns == odd.columns


def test_language_id_leaves_no_label_out(spark):
    words = ["".join(random.Random(f"{i} {j}").choices("abcdefghijklmnopqrstuvwxyz", k=9)) for i in range(65) for j in range(20)]
    rows = [(8 * i + j, " ".join(words[20 * i : 20 * i + 20]), f"l{i:02}") for i in range(65) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="64 labels"):
        language_id.fit(docs)
    assert len(language_id.fit(docs, max_languages=65).names) == 65
    assert len(language_id.fit(docs.where("lang <> 'l64'")).names) == 64


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:400] = x[0]  # a large class of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0]), (5100, [None] + [1.0] * 15), (5120, [float("inf")] * 16), (None, [1.0] * 16), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in graph_ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q in range(0, 3000, 20):
        s = exact[q].copy()
        s[q] = -np.inf
        order = np.lexsort((np.arange(3000), -s))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(v - exact[q, i]) < 1e-9 for _, i, v in mine)
        assert [i for _, i, _ in mine] == [i for _, i, _ in sorted(mine, key=lambda m: (-m[2], m[1]))]
        hits += len({i for _, i, _ in mine} & set(order.tolist()))
        if q < 400:  # ties of equal vectors go to the smallest ids
            assert [i for _, i, _ in mine if i < 400] == [i for i in order.tolist() if i < 400]
    assert set(got) == set(range(0, 3000, 20)) and hits / (150 * 20) >= 0.9
    few = graph_ann.nearest(df.where("vec_id in (20, 40, 999)")).collect()
    assert len(few) == 4
    assert graph_ann.nearest(df.where("false")).count() == 0


def test_nearest_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(2)
    n = 4000
    for x in (rng.normal(size=(n, 16)), rng.normal(size=(40, 16))[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, 16))):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {}
        for r in graph_ann.nearest(df).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, n, 20):
            s = x.astype(np.float64) @ x[q].astype(np.float64)
            s[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        assert hits / (n // 20 * 20) >= 0.98


def test_reachable_cells_hold_all_neighbours():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 8))[rng.integers(0, 50, 5000)] + 0.05 * rng.normal(size=(5000, 8))
    x = (x * rng.uniform(0.2, 3, (5000, 1))).astype(np.float32)
    largest = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
    points = graph_ann.augmented(x, largest)
    centroids = graph_ann.kmeans(points, 80)
    cell = ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)
    unit = centroids / np.sqrt((centroids**2).sum(axis=1))[:, None]
    cosine = (points * unit[cell]).sum(axis=1) / largest
    least = np.array([cosine[cell == c].min(initial=1) for c in range(80)])
    visit = graph_ann.reachable(x[:200], centroids, least, largest, x[rng.permutation(5000)[:1000]], 20)
    scores = x[:200].astype(np.float64) @ x.astype(np.float64).T
    best = np.argsort(-scores, axis=1)[:, :21]
    assert visit[np.arange(200)[:, None], cell[best]].all() and visit.mean() < 0.6


def test_range_coder_and_files(spark, odd, nothing, tmp_path):
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint16), np.full(3000, 65535, np.uint16), rng.integers(0, 65536, 2000).astype(np.uint16), np.array([7], np.uint16), (rng.zipf(1.5, 5000) % 500).astype(np.uint16)]
    coded = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[1]) < 100 and len(coded[4]) < 6000
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for name, docs in (("odd", odd.where("doc_id is not null").dropDuplicates(["doc_id"])), ("none", nothing)):
        token_files.write_tokens(docs, str(tmp_path / name), path, block_ids=50 if name == "odd" else 4096)
        got = sorted(map(tuple, token_files.read_digests(spark, str(tmp_path / name)).collect()))
        at, want = 0, []
        for d, text in sorted(once(docs).items()):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want
    parts = token_files.read_tokens(spark, str(tmp_path / "odd")).where("id = 6").orderBy("part").collect()
    assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == [*t.encode(once(odd)[6], add_special_tokens=False).ids, 2]
    blocks = spark.read.parquet(str(tmp_path / "odd"))
    blocks.withColumn("crc", blocks.crc + 1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="checksum"):
        token_files.read_tokens(spark, str(tmp_path / "bad")).count()
    a, b = b"abc" * 50, b"defg" * 33
    assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_byte_bpe_equals_the_library():
    import pyarrow as pa

    from graphloom.llm.byte_bpe import ByteBpe

    own = ByteBpe(P.path("byte_bpe_50k.json"))
    rnd = random.Random(0)
    pool = list("ab é　\n\t\x1c\x85\xa0'’s123中🙂́  ") + [" the", " <|endoftext|>", "<|endoftext|>", "'s", " 's", "\r\n", "  "]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))) for _ in range(8000)] + [None, ""]
    flat, ends = own.encode(pa.array(texts, pa.string()))
    counts = own.counts(pa.array(texts, pa.string()))
    for i, e in enumerate(own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert flat[(ends[i - 1] if i else 0) : ends[i]].tolist() == e.ids and counts[i] == len(e.ids), texts[i]


def test_packing(spark, odd, nothing):
    rnd = random.Random(5)
    for _ in range(30):
        items = [(rnd.randint(1, 64), i) for i in range(rnd.randint(0, 200))]
        placed = packing.pack(items, (8, 16, 32, 64), 4)
        assert sorted(p[3] for p in placed) == list(range(len(items)))
        bins = {}
        for b, start, capacity, i in placed:
            bins.setdefault(b, []).append((start, items[i][0], capacity))
        for content in bins.values():
            end = 0
            for start, n, capacity in sorted(content):
                assert start == end
                end += n
            assert end <= capacity and all(c < end for c in (8, 16, 32, 64) if c < capacity)
    out = packing.best_fit(odd, P.path("byte_bpe_50k.json"), capacities=(64, 128)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
        assert (r.bin is None) == (r.n_tokens == 0)
    copies = Counter(r.doc_id for r in odd.collect())
    for d, text in once(odd).items():
        assert total[d] == copies[d] * len(t.encode(text or "", add_special_tokens=False).ids)
    assert packing.best_fit(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_warc(spark, tmp_path):
    long = "é" * 60
    rows = [(1, "http://a.example/x y?q=1#f", long), (2, None, long), (3, "http://b.example", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n" + "x" * 200 + "\r\n\r\n"), (0, "u", long + "!"), (None, "u", long), (7, "u", ""), (8, "u", "l\r\nm\n" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "sf/pages.parquet"))
    got = sorted(map(str, queries.QUERIES["op8_warc"](spark, str(tmp_path / "sf")).collect()))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/sf/pages.parquet/*.parquet'")
    q = c.sql(warc.OP8_SQL)
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(q.columns, r, strict=True)))) for r in q.fetchall())
    warc.write_warc(pages, str(tmp_path / "out"))
    captures = {r["metadata"].fields["page-id"]: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "out"), payloads=True)).collect()}
    assert bytes(captures["6"].main.payload).decode() == rows[5][2] and captures["2"].main.type == "revisit" and captures["2"].main.refers_to == captures["1"].capture_id
    assert all(r.request.type == "request" for r in captures.values()) and len(captures) == 9
    import gzip

    plain = b"".join(b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\nContent-Length: 2\r\n%s\r\nhi\r\n\r\n" % (k, i, extra) for i, (k, extra) in enumerate([(b"resource", b""), (b"metadata", b"WARC-Concurrent-To: <0>\r\nWARC-Concurrent-To: <9>\r\n")]))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/a.warc").write_bytes(plain)
    (tmp_path / "other/b.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(plain))
    found = warc.read_warc(spark, str(tmp_path / "other"))
    assert found.count() == 6 and {r.capture_id: r.main is not None for r in warc.assemble(found).collect()} == {"<0>": True, "<9>": False}
    empty = pages.where("false")
    warc.write_warc(empty, str(tmp_path / "empty"))
    assert warc.read_warc(spark, str(tmp_path / "empty")).count() == 0


def test_line_dedup(spark, odd, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD_WINDOWS", 7)
    rnd = random.Random(5)
    rows = [(i, None if i % 40 == 7 else "\n".join(rnd.choice(["a", "b", "c", "d", "", "x", " \t", "a\r"]) for _ in range(rnd.randint(0, 12)))) for i in range(300)]
    for name, docs in (("random", spark.createDataFrame(rows, "doc_id long, text string")), ("odd", odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"))):
        docs.write.parquet(str(tmp_path / name))
        c = duckdb.connect()
        c.sql(f"create view documents as select * from '{tmp_path}/{name}/*.parquet'")
        assert sorted(map(tuple, line_dedup.line_dedup(docs).collect())) == sorted(c.sql(line_dedup.OP9_SQL).fetchall())
    assert line_dedup.line_dedup(odd).count() == odd.count() and line_dedup.line_dedup(nothing).count() == 0


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(lines)


def test_quality_rules(odd, nothing):
    book = quality_rules.ledger(odd)
    texts = once(odd)
    for r in book.collect():
        if r.doc_id is not None:
            assert tuple(r[m] for m in quality_rules.MEASURES) == measures(texts[r.doc_id])
            assert bool(r.failures & 1) == (r.n_words < 20) and bool(r.failures & 2) == (100 * r.n_repeat_words > 30 * r.n_words)
    rows = [r.failures & quality_rules.bits(quality_rules.POLICIES["v1"]) for r in book.collect()]
    for r in quality_rules.ablations(book, "v1").collect():
        bit = quality_rules.bits([r.rule])
        assert (r.failed, r.only_rule) == (sum(bool(x & bit) for x in rows), sum(x == bit for x in rows))
    assert quality_rules.failing_rules(book).first().any_failed == np.bitwise_or.reduce(rows)
    assert quality_rules.ledger(nothing).count() == 0 and quality_rules.ablations(quality_rules.ledger(nothing), "v1").count() == 0


def test_shingles_do_not_depend_on_chunks(odd):
    import pyarrow as pa

    texts = list(once(odd).values())
    data, offsets, _ = textkit.utf8(pa.array(texts, pa.string()))
    whole = textkit.shingle_sets(data, offsets, 4)
    for i, t in enumerate(texts):
        own, at, _ = textkit.utf8(pa.array([t], pa.string()))
        assert (textkit.shingle_sets(own, at, 4)[0] == whole[i]).all() and (t is None or len(whole[i]) == len({tuple(WORD.findall(t)[j : j + 4]) for j in range(max(1, len(WORD.findall(t)) - 3))} - {()}))
