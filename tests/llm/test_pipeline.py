"""The pipeline's stages, each against a plain version on its own input."""

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
import corpus_pipeline  # noqa: E402
from test_operators import repeated_bytes, shingles, union_find  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "jaccard_join", "suffix_dedup", "best_fit"]
    from graphloom.llm.line_dedup import LONG_WORDS, line_dedup
    from graphloom.llm.store import written

    recognised = written(stages["language_id"](spark, docs, SF), "t")
    assert recognised.columns == docs.columns and set(texts(recognised)) == {d for d, t in texts(docs).items() if t and any(c.isalpha() for c in t)}
    lines = written(stages["line_dedup"](spark, recognised, SF), "t")
    assert texts(lines) == {r.doc_id: r.kept_text for r in line_dedup(recognised, long_words=LONG_WORDS).collect()} and lines.columns == docs.columns
    near = written(stages["jaccard_join"](spark, lines, SF), "t")
    sets = {d: shingles(t, 5) for d, t in texts(lines).items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(texts(near)) == {d for d, c in union_find(sets, links).items() if d == c}
    suffix = written(stages["suffix_dedup"](spark, near, SF), "t")
    want = repeated_bytes(texts(near), 100)
    assert texts(suffix) == {d: w[3].decode(errors="ignore") for d, w in want.items()}
    assert suffix.where("n_chars <> length(text)").count() == 0
    packed = stages["best_fit"](spark, suffix, SF).toPandas()
    assert set(packed.doc_id) == set(texts(suffix))
    full = packed[packed.bin.notna()]
    assert (full.groupby("bin").n_tokens.sum() <= full.groupby("bin").capacity.first()).all()
    assert np.isfinite(full.bin_start).all()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_input(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the same text " * 30, None, None, 3), (3, "the same text " * 30, "en", "a", 1), (3, "the same text " * 30, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, SF)
            assert out.count() <= 6, name
            assert name == "best_fit" or out.columns == docs.columns
