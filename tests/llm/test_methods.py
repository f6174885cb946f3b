"""The methods of the operators against plain versions, beyond the results that other tests compare."""

import random

import pytest

from graphloom.llm import packing

P = pytest.importorskip("public_tokenizers")


def plain_pack(lengths, sizes, overhead, attention):
    """The rule of packing.pack in lists: bins as (room, contents, capacity), claims as counts."""
    todo = sorted(lengths, reverse=True)
    claimed, bins = [], []
    while todo:
        n = todo.pop(0)
        if n in claimed:  # pieces of a length are alike: a claimed one comes first
            claimed.remove(n)
        fits = [b for b in bins if b[0] >= n]
        if fits:
            least = min(b[0] for b in fits)
            b = bins.pop(max(k for k, b in enumerate(bins) if b[0] == least))
        else:
            options = []
            for c in sizes:
                if c >= n:
                    room, taken, pool = c - n, [], list(todo)
                    for x in claimed:
                        pool.remove(x)
                    for x in pool:
                        if x <= room:
                            taken.append(x)
                            room -= x
                    end = min(s for s in sizes if s >= n + sum(taken))
                    options.append((packing.cost(end, overhead, attention) / (n + sum(taken)), c, taken))
            _, c, taken = min(options, key=lambda o: o[:2])
            claimed += taken
            b = [c, []]
        b[0] -= n
        b[1].append(n)
        bins.append(b)  # the last one that came to a room is used first
    return sorted(sorted(b[1]) for b in bins)


def contents(placed, items):
    bins = {}
    for b, _, capacity, i in placed:
        bins.setdefault(b, ([], capacity))[0].append(items[i][0])
    return bins


def test_packing_equals_the_plain_rule():
    rnd = random.Random(8)
    for _ in range(150):
        top = rnd.choice([16, 64, 64])
        sizes = (8, 16, 32, 64)[: (2 if top == 16 else 4)]
        items = [(rnd.randint(1, rnd.choice([6, top])), i) for i in range(rnd.randint(1, 40))]
        overhead, attention = rnd.choice([(0, 32), (4, 64), (2, 8), (20, 10000)])
        got = contents(packing.pack(items, sizes, overhead, attention), items)
        assert sorted(sorted(c) for c, _ in got.values()) == plain_pack([x[0] for x in items], sizes, overhead, attention)


def cheapest(lengths, sizes, price):
    """The least cost of any packing, over all partitions."""
    best = [float("inf")]

    def place(at, bins, spent):
        if spent >= best[0]:
            return
        if at == len(lengths):
            best[0] = min(best[0], spent)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[at] <= sizes[-1]:
                more = [*bins[:k], bins[k] + lengths[at], *bins[k + 1 :]]
                place(at + 1, more, sum(price(next(s for s in sizes if s >= b)) for b in more))
        more = [*bins, lengths[at]]
        place(at + 1, more, sum(price(next(s for s in sizes if s >= b)) for b in more))

    place(0, [], 0)
    return best[0]


def test_packing_against_the_optimum():
    """On tiny inputs the cost is near that of the best of all packings; bins of one size alone are worse."""
    rnd = random.Random(4)
    sizes, ours, best, single = (8, 16, 32), 0, 0, 0
    for _ in range(60):
        items = [(rnd.randint(1, 32), i) for i in range(rnd.randint(1, 7))]
        price = lambda c: packing.cost(c, 2, 32)
        got = contents(packing.pack(items, sizes, 2, 32), items)
        own, least = sum(price(c) for _, c in got.values()), cheapest([x[0] for x in items], sizes, price)
        assert least - 1e-9 <= own <= 1.35 * least
        ours, best, single = ours + own, best + least, single + price(32) * len(contents(packing.pack(items, (32,), 2, 32), items))
    assert ours <= 1.05 * best < single


def test_packing_uses_several_sizes(spark):
    rnd = random.Random(6)
    items = [(int(rnd.lognormvariate(6, 1)) % 4096 + 1, i) for i in range(5000)]
    placed = packing.pack(items)
    sizes = {}
    for _, capacity in contents(placed, items).values():
        sizes[capacity] = sizes.get(capacity, 0) + 1
    assert all(sizes.get(c, 0) * 50 >= sum(sizes.values()) for c in packing.CAPACITIES[1:])
    rows = [(7, "one two three " * rnd.randint(1, 60)) for _ in range(60)] + [(7, "the same")] * 20 + [(8, "x " * 9000)]
    out = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).toPandas()
    assert (out.groupby("bin").n_tokens.sum() <= out.groupby("bin").capacity.first()).all() and len(out[out.doc_id == 7]) == 80
    long = out[out.doc_id == 8].sort_values("token_start")
    assert long.piece.tolist() == list(range(len(long))) and (long.token_start == long.piece * 4096).all()
    spots = out.sort_values(["bin", "bin_start"])
    assert ((spots.bin_start + spots.n_tokens).groupby(spots.bin).shift(fill_value=0) == spots.bin_start).all()


# -- ids that repeat, ties


def sql_rows(sql, **tables):
    import duckdb

    c = duckdb.connect()
    for name, path in tables.items():
        c.sql(f"create view {name} as select * from '{path}/*.parquet'")
    q = c.sql(sql)
    return q.columns, q.fetchall()


def test_warc_keeps_every_row_of_repeated_ids(spark, tmp_path):
    from graphloom.llm import warc

    x, y, z = "x" * 120, "y" * 150, "z" * 40_000
    rows = [(1, "a", x), (1, "a", x), (1, "a", y), (2, "b", x), (3, "c", y), (3, "d", y), (4, None, "short"), (4, None, "short"), (5, "e", z), (6, "f", z)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "sf/pages.parquet"))
    columns, want = sql_rows(warc.OP8_SQL, pages=tmp_path / "sf/pages.parquet")
    got = [tuple(r[c] for c in columns) for r in warc.op8_warc(spark, str(tmp_path / "sf")).collect()]
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, want))


def test_jaccard_links_through_any_row_of_an_id(spark, tmp_path):
    from graphloom.llm import jaccard_join

    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, text(100, 200)), (1, text(107, 207)), (9, text(114, 214)), (8, text(93, 193)), (7, text(500, 540)), (7, ""), (7, text(500, 540)), (5, None), (6, text(501, 541)), (6, text(900, 910)), (4, text(900, 910)), (9, text(700, 710))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "sf/documents.parquet"))
    columns, want = sql_rows(jaccard_join.OP1_SQL, documents=tmp_path / "sf/documents.parquet")
    got = [tuple(r[c] for c in columns) for r in jaccard_join.op1_jaccard_join(spark, str(tmp_path / "sf")).collect()]
    assert sorted(got) == sorted(want)
    assert {r[0]: r[2] for r in got if r[1]} == {1: 1, 9: 1, 8: 1, 7: 4, 6: 4, 4: 4}


def test_nearest_breaks_ties_by_id(spark):
    from graphloom.llm import graph_ann

    rows = [(0, [1.0, 0.0])] + [(i, [1.0, i / 100]) for i in range(60, 0, -1)]
    got = sorted(tuple(r) for r in graph_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id = 0").collect())
    assert [(r[1], r[2], r[3]) for r in got] == [(i, i, 1.0) for i in range(1, 21)]


def test_nearest_without_clusters(spark):
    """Vectors without any structure, in full shards: most neighbours are still found."""
    import numpy as np

    from graphloom.llm import graph_ann

    x = np.random.default_rng(5).normal(size=(5000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in graph_ann.nearest(df, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 5000, 50):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (100 * 20) >= 0.9


def test_token_files_order_rows_of_one_id(spark, tmp_path):
    from graphloom.llm import token_files

    path = P.path("byte_bpe_50k.json")
    rows = [(5, "beta gamma delta"), (6, "z"), (5, "alpha"), (5, None), (None, "b"), (None, "a")]
    seen = []
    for k in range(3):
        random.Random(k).shuffle(rows)
        out = str(tmp_path / str(k))
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), out, path)
        seen.append(sorted(map(str, token_files.read_digests(spark, out).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 6
    starts = [(r.start, r.n_tokens) for r in token_files.read_digests(spark, out).where("id = 5").orderBy("start").collect()]
    assert [n for _, n in starts] == [1, len(encoded("alpha")) + 1, len(encoded("beta gamma delta")) + 1]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


# -- winnowing


def plain_line_ranges(docs, window, long_words):
    """Lines to delete, {id: numbers among lines with a word}, by comparing every run of lines with all earlier ones."""
    import re

    seen, gone = set(), {}
    for d in sorted(docs):
        own = [x for x in docs[d].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out = set()
        for i in range(len(own)):
            runs = [own[i : i + window]] if i + window <= len(own) else []
            if long_words and len(re.findall(r"[^\x20\x09-\x0D]+", own[i])) >= long_words:
                runs.append([own[i]])
            for run in runs:
                key = (len(run), tuple(run))
                if key in seen:
                    out |= set(range(i, i + len(run)))
                seen.add(key)
        gone[d] = out
    return gone


@pytest.mark.parametrize("window, long_words", [(3, None), (3, 4), (2, 3), (5, None), (1, None)])
def test_winnowing_equals_plain_comparison(spark, monkeypatch, window, long_words):
    from graphloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HELD_WINDOWS", 40)
    rnd = random.Random(window)
    passage = [f"line {i} of it" for i in range(9)]
    docs = {}
    for d in range(120):
        own = [rnd.choice(["a", "b", "c", "", "one two three four", "five six seven", f"only {d} {rnd.random()}"]) for _ in range(rnd.randint(0, 9))]
        if d % 3 == 0:
            cut = rnd.randint(0, 6)
            own[1:1] = passage[cut : cut + rnd.randint(1, 6)]
        docs[d] = "\n".join(own)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    want = plain_line_ranges(docs, window, long_words)
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, window=window, long_words=long_words).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {d: len(w) for d, w in want.items()} and any(want.values())
    for d, t in docs.items():
        k, stay = -1, []
        for x in t.split("\n"):
            k += bool(x.strip())
            if not (x.strip() and k in want[d]):
                stay.append(x)
        assert got[d].kept_text == "\n".join(stay)


def test_only_window_minima_are_sent():
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import line_dedup
    from graphloom.llm.textkit import utf8

    text = "\n".join(f"line number {i}" for i in range(3000))
    data, offsets, _ = utf8(pa.array([text]))
    key, _, at, line, _, _ = line_dedup.fingerprints(data, offsets, 3)
    assert len(line) == 2998 and 0.45 < len(np.unique(at)) / 3000 < 0.55 and ((at >= line) & (at < line + 3)).all()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    assert sum(b.num_rows for b in line_dedup._selected(3, None)(iter([batch]))) == len(np.unique(at))


def test_positions_around_a_fingerprint_of_very_many_rows():
    import pyarrow as pa

    from graphloom.llm import line_dedup

    names = [c.split(" ")[0] for c in line_dedup.MARKED.split(", ")]
    rows = [(3, d, 5, 0, 3, False, [70, 71 + d]) for d in range(40)] + [(4, 1, 1, 0, 3, False, [9])] + [(5, 2, 2, 0, 3, True, [8]), (6, 2, 0, 4, 0, True, [])]
    schema = pa.schema([(n, pa.bool_() if n == "known" else pa.list_(pa.int64()) if n == "windows" else pa.int64()) for n in names])

    def run(step, held):
        line_dedup.HELD_WINDOWS, before = held, line_dedup.HELD_WINDOWS
        try:
            batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + step]], schema) for i in range(0, len(rows), step)]
            return [tuple(r.values()) for b in line_dedup._extended(iter(batches)) for r in b.to_pylist()]
        finally:
            line_dedup.HELD_WINDOWS = before

    for step, held in ((1, 6), (7, 12), (100, 1000)):
        found = run(step, held)
        windows = {(k, d, n) for k, d, n, size, _ in found if not size}
        assert {(71 + d, d, 6) for d in range(40)} <= windows and (8, 2, 2) in windows and (70, 0, 5) in windows and not any(k == 9 for k, _, _ in windows)
        later = {(d, n) for _, d, n, size, _ in found if size == 3} | {(d, n) for k, d, n in windows if k == 70}
        assert later == {(d, 5) for d in range(40)} and any(f[1:4] == (2, 0, 4) for f in found)


# -- language identification


def plain_counts(text, dims):
    """Hashed trigram counts of a text, one trigram at a time."""
    import re

    folded = re.sub(rb"[^a-z\x80-\xff]", b" ", text.encode().lower())
    out = {}
    for i in range(len(folded) - 2):
        a, b, c = folded[i : i + 3]
        if (a, b) != (32, 32) and (b, c) != (32, 32):
            code = ((a | b << 8 | c << 16) * 2654435761 % (1 << 32)) >> (32 - (dims - 1).bit_length())
            out[code] = out.get(code, 0) + 1
    return out


def plain_prediction(model, text):
    """(language, cosine, is rejected)."""
    import math

    tf = plain_counts(text, len(model.idf))
    v = {k: math.log1p(n) * float(model.idf[k]) for k, n in tf.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    cosines = [sum(x / norm * float(c[k]) for k, x in v.items()) for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    length = min(int(math.log2(max(1, sum(tf.values())))), model.floor.shape[1] - 1)
    return model.names[model.language[best]], cosines[best], cosines[best] < model.floor[best, length], sorted(cosines)[-2:]


def test_language_id_equals_a_plain_version(spark):
    import numpy as np

    from graphloom.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rnd = random.Random(7)
    greek = [" ".join("".join(rnd.choices("αβγδεζηθικλμνξοπρστυφχψω", k=rnd.randint(2, 9))) for _ in range(n)) for n in (60, 400, 2000)]
    far = spark.createDataFrame([(10_000 + i, t, None, None, len(t)) for i, t in enumerate([*greek, "x", "ß ab", "1 2 3", ""])], docs.schema)
    model = language_id.fit(language_id.training_rows(docs))
    texts = {r.doc_id: r.text for r in docs.union(far).collect()}
    rejected, stays = 0, set()
    for r in language_id.predict(docs.union(far), model).collect():
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        language, cosine, is_far, two = plain_prediction(model, t)
        assert abs(r.score - max(0.0, cosine)) < 1e-4
        if two[1] - two[0] > 1e-4:
            assert r.lang_pred == language
        assert r.rejected == is_far
        rejected += is_far
        stays |= set() if is_far else {r.doc_id}
        if 10_000 <= r.doc_id < 10_003:
            assert r.rejected
    assert rejected >= 3
    kept = {r.doc_id for r in language_id.recognised(spark, docs.union(far), "").collect()}
    assert kept == stays and not kept & {10_000, 10_001, 10_002, 10_005, 10_006}
    clean = [i for i, t in texts.items() if i < 10_000 and t and any(c.isalpha() for c in t)]
    assert len(kept & set(clean)) >= 0.98 * len(clean)
    # limits differ by centroid
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and len(np.unique(model.floor[:, -2])) > 1


def test_centroids_are_means_of_their_members():
    import numpy as np

    from graphloom.llm import language_id

    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(3, 40)))[rng.integers(0, 3, 90)] + 0.05 * np.abs(rng.normal(size=(90, 40)))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    c = language_id.spherical_kmeans(v, 3)
    own = [max(range(3), key=lambda k: sum(float(a) * float(b) for a, b in zip(x, c[k], strict=True))) for x in v]
    for k in range(3):
        mean = sum(x.astype(np.float64) for x, o in zip(v, own, strict=True) if o == k)
        assert np.allclose(c[k], mean / np.sqrt((mean**2).sum()), atol=1e-4)


# -- the mixture that codes token ids


def test_mixture_of_orders_is_a_distribution():
    import numpy as np

    from graphloom.llm import range_coder

    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 900) % 3000).astype(np.int64)
    ids[300:420] = ids[100:220]  # contexts that come again
    model = range_coder._Model(1)
    every = np.arange(65536)
    for t, x in enumerate(ids):
        model.weigh()
        if t % 89 == 0:
            start, size = (v.astype(np.int64) for v in model.place(every))
            assert (size > 0).all() and start[0] == 0 and (start[1:] == np.cumsum(size)[:-1]).all() and size.sum() == 1 << int(range_coder._TOTAL)
            zero = model.zero(every)[1] / (1 << range_coder._ZERO)
            w, p = [float(m[0]) for m in model.mix], [float(q[0]) / 65536 for q in (model.p1, model.p2)]
            plain = w[0] * zero + sum(wk * (pk * (every == int(g[0])) + (1 - pk) * zero) for wk, pk, g in zip(w[1:], p, (model.g1, model.g2), strict=True))
            assert abs(sum(w) - 1) < 1e-9 and np.abs(size / (1 << int(range_coder._TOTAL)) - plain).max() < 1e-3
            for v in [0, (1 << 32) - 1, *rng.integers(0, 1 << 32, 40).tolist()]:
                found = int(model.find(np.array([v]))[0])
                assert start[found] <= v < start[found] + size[found]
        model.place(np.array([x]))
        model.learn(np.array([x]))
    blocks = [ids.astype(np.uint16), rng.integers(0, 65536, 700).astype(np.uint16), np.tile(ids[:50], 12).astype(np.uint16)]
    coded = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[2]) < 0.35 * 2 * len(blocks[2]) and len(coded[1]) < 2.25 * len(blocks[1])


def test_jvm_codes_the_same_bytes(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from graphloom.llm import jvm_coder, range_coder, token_files

    rng = np.random.default_rng(5)
    blocks = [np.zeros(0, np.uint16), np.array([7], np.uint16), np.full(3000, 65535, np.uint16), rng.integers(0, 65536, 2000).astype(np.uint16), np.tile(rng.integers(0, 50000, 40).astype(np.uint16), 60)]
    blocks += [(rng.zipf(1.1 + rng.random(), int(rng.integers(1, 9000))) % rng.integers(2, 65536)).astype(np.uint16) for _ in range(30)]
    rows = spark.createDataFrame([(i, bytearray(b.astype("<u2").tobytes()), len(b)) for i, b in enumerate(blocks)], "i int, ids binary, n long").repartition(3)
    got = rows.withColumn("coded", jvm_coder.encoded(spark, "ids")).withColumn("back", jvm_coder.decoded(spark, "coded", "n")).orderBy("i").collect()
    assert [bytes(r.coded) for r in got] == range_coder.encode(blocks)
    assert all(r.back == r.ids for r in got)
    other = spark.newSession()
    assert other.range(1).select(F.lit(b"\x07\x00").alias("ids")).select(jvm_coder.encoded(other, "ids")).first()[0] == range_coder.encode([blocks[1]])[0]
    # the files of write_tokens are such bytes, and blocks that lack some are told by their checksum
    token_files.write_tokens(spark.createDataFrame([(i, "some words " * i) for i in range(300)], "doc_id long, text string"), str(tmp_path / "whole"), P.path("byte_bpe_50k.json"))
    stored = spark.read.parquet(str(tmp_path / "whole")).collect()
    for r, ids in zip(stored, range_coder.decode([bytes(r.payload) for r in stored], [r.n_ids for r in stored]), strict=True):
        assert token_files._crc(ids) == r.crc
    for k, damage in enumerate(("substring(payload, 1, 9)", "binary('')", "null", "payload || payload", "reverse(hex(payload))")):
        bad = spark.read.parquet(str(tmp_path / "whole")).withColumn("payload", F.expr(f"cast({damage} as binary)"))
        bad.withColumn("n_ids", F.col("n_ids") + int(k == 3)).write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(Exception, match="checksum does not match"):
            token_files.read_tokens(spark, str(tmp_path / f"bad{k}")).count()


def test_byte_bpe_asks_for_few_strings(monkeypatch):
    import pyarrow as pa

    from graphloom.llm import byte_bpe

    class Asked:
        def __init__(self, tokenizer):
            self.tokenizer, self.strings = tokenizer, 0

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **how):
            self.strings += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    def coder():
        out = byte_bpe.ByteBpe(P.path("byte_bpe_50k.json"))
        out.tokenizer = out.first.tokenizer = out.later.tokenizer = Asked(out.tokenizer)
        return out

    r = random.Random(7)
    texts = [" ".join("".join(r.choice(["th", "er", "on", "an", "\u00fc"]) for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", ".\nSo", "!!"]) for _ in range(r.randint(1, 200))) for _ in range(300)]
    own = coder()
    flat, ends = own.encode(pa.array(texts))
    library = own.tokenizer.tokenizer
    assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert own.tokenizer.strings * 50 < len({w for x in texts for w in x.split(" ")})
    # whatever stands side by side; with a cache that is full at once
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 40)
    atoms = ["a", "Ing", "foo.", "'s", "12", "\u00fc", "\u00dfe", "\n", "\t", " ", "  ", "\u00a0", "\u3000", "<|endoftext|>", "\u0120", "\u010a", "\x85", "\x1c", "\u65e5", "|", "<", "", "\r\n", "\x00", "don't", "'", "\n\n", "\nFoo.", " \n", "\n "]
    for k in range(8):
        texts = [None if r.random() < 0.03 else "".join(r.choice(atoms) + (" " if r.random() < 0.6 else "") for _ in range(r.randint(0, 30))) for _ in range(200)]
        flat, ends = own.encode(pa.array(texts, pa.string() if k % 2 else pa.large_string()), (7, 100, 5000)[k % 3])
        assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_components_around_hubs(spark, monkeypatch):
    from graphloom.llm import components as C

    monkeypatch.setattr(C, "HUB_EDGES", 20)
    seen = []
    real = C._joined
    monkeypatch.setattr(C, "_joined", lambda *x: (seen.append(x[4]), real(*x))[1])
    # stars around the smallest, the largest and a middle node, chained, and a star of its own
    edges = [(0, i) for i in range(1, 200)] + [(5000, i) for i in range(300, 500)] + [(700, i) for i in [*range(600, 700), *range(701, 800)]]
    edges += [(199, 300), (499, 600), (9000, 9001), *((8000, 8000 + i) for i in range(1, 60))]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long"), shrink=False).collect()}
    assert got == {x: 0 if x < 6000 else 8000 if x < 8900 else 9000 for e in edges for x in e}
    assert set(seen[0]) == {0, 5000, 700, 8000}


def test_members_of_a_common_key_are_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import jaccard_join as J
    from graphloom.llm.components import forest

    digests = pa.array(np.arange(2000) * 7, pa.int64())
    keyed = pa.RecordBatch.from_arrays([pa.array(np.full(2000, 5)), digests], ["key", "digest"])
    groups = pa.Table.from_batches(list(J._groups(iter([keyed]))))
    assert groups.num_rows == 2000 and not any(groups["star"].to_pylist()) and len(set(groups["group"].to_pylist())) == 1
    # dealt to blocks, all pairs still meet
    monkeypatch.setattr(J, "COMPARED_KEY", 500)
    groups = pa.Table.from_batches(list(J._groups(iter([keyed])))).to_pydict()
    assert not any(groups["star"]) and max(groups["group"].count(g) for g in set(groups["group"])) <= 500
    met = np.zeros((2000, 2000), dtype=bool)
    for g in set(groups["group"]):
        own = np.array([m // 7 for m, h in zip(groups["member"], groups["group"], strict=True) if h == g])
        met[np.ix_(own, own)] = True
    assert met.all()
    # sets that have little in common but one shingle stay apart, near copies meet
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(700):
        own = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        sets += [np.unique(np.concatenate((own[drop:], [np.uint64(9)]))) for drop in range(int(rng.integers(1, 4)))]
    n = np.array([len(x) for x in sets])
    bits = np.stack([np.frombuffer(J.odd_sketch(x), np.uint64) for x in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if np.bitwise_count(bits[i] ^ bits[j]).sum() <= (n[i] + n[j]) * 20 // 180]
    got, want = (sorted(zip(*(x.tolist() for x in forest(np.array(a), np.array(b))), strict=True)) for a, b in (J.may_link(bits, n, 80), zip(*pairs, strict=True)))
    assert got == want and len(set(a for a, _ in got)) > 300
