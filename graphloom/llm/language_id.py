"""Language identification by nearest centroid.

A text becomes the normalised TF-IDF vector of its hashed byte trigrams (ASCII
letters folded, everything in ASCII that is no letter read as one space). Each
language has several centroids, found by spherical k-means over its training
vectors; the prediction is the language of the centroid with the largest cosine
over the whole text. A text is *rejected* if it has no letter, or if it is
farther from its nearest centroid than `reject_share` times the distance of that centroid's
limit: its farthest training text of similar length, or the mean less `SPREAD` standard
deviations of their cosines where that is farther. Where a centroid has fewer than `FEW` training texts
of similar length, those of all centroids count; where these are few too, nothing of that length is rejected.

The classifier is fitted on a bounded sample: about `per_language` labelled rows
of each label, drawn by a hash of the id, so that neither the driver nor the
model grows with the input. Prediction is a single pass with a model of
`dims * languages * centroids` floats.

Null text, empty text and text without a letter are predicted `und` with score
0 and rejected. Rows with null labels take no part in fitting. Without any
training row every text is `und`. Repeated rows are repeated, null ids stay null,
an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_IS_ASCII_LETTER = np.zeros(256, dtype=bool)
_IS_ASCII_LETTER[65:91] = _IS_ASCII_LETTER[97:123] = True
#: Texts that one dense block of counts holds.
BLOCK_TEXTS = 256


def counts(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Trigram counts, texts x dims."""
    n = len(offsets) - 1
    folded = _FOLD[data].astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    if len(folded) < 3:
        return np.zeros((n, dims), dtype=np.float32)
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    keep = (text[:-2] == text[2:]) & ~((a == 32) & (b == 32)) & ~((b == 32) & (c == 32))
    code = (a | b << np.uint32(8) | c << np.uint32(16))[keep]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - (dims - 1).bit_length())
    at = text[:-2][keep] * dims + code
    return np.bincount(at, minlength=n * dims).reshape(n, dims).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray  # dims
    centroids: np.ndarray  # all centroids x dims
    language: list[int]  # of each centroid
    names: list[str]
    floor: np.ndarray  # centroids x length classes: smaller cosines are rejected

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, cosine, is rejected)."""
        cos = vectors(tf, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(best)), best]
        return np.array(self.language)[best], np.clip(top, 0, 1), top < self.floor[best, length_class(tf)]


LENGTHS = 12
#: Training texts of similar length that a limit needs at least.
FEW = 20
SPREAD = 5.0


def length_class(tf: np.ndarray) -> np.ndarray:
    """Texts of similar numbers of trigrams: short ones lie far from any centroid."""
    return np.minimum(np.log2(np.maximum(tf.sum(axis=1), 1)).astype(int), LENGTHS - 1)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are the rows farthest from those before."""
    start = [0]
    for _ in range(min(k, len(v)) - 1):
        start.append(int((v @ v[start].T).max(axis=1).argmin()))
    c = v[start]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _featured(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(1))
            for i, j in tk.chunks(offsets):
                for s in range(i, j, BLOCK_TEXTS):
                    e = min(s + BLOCK_TEXTS, j)
                    tf = counts(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], dims)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array([x.tobytes() for x in np.minimum(tf, 65535).astype(np.uint16)], pa.binary())], ["label", "tf"])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", dims: int = 4096, per_language: int = 400, max_languages: int = 64, centroids: int = 6, reject_share: float = 1.25) -> Model:
    """Fit on about per_language rows of each label, drawn by a hash of the id; more than max_languages labels are an error."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = [(r[0], r["n"]) for r in rows.groupBy(label_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label_col).limit(max_languages + 1).collect()]
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels in {label_col}: none may be left out, so pass a larger max_languages")
    names = sorted(r[0] for r in sizes)
    if not names:
        return Model(np.ones(dims, np.float32), np.zeros((1, dims), np.float32), [0], [UNKNOWN], np.full((1, LENGTHS), 2.0))
    share = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, per_language / n)])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < share[F.col(label_col)]).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    got = drawn.mapInArrow(tk.lean(_featured(dims)), "label string, tf binary").limit(2 * per_language * len(names)).collect()
    tf = np.stack([np.frombuffer(r.tf, np.uint16) for r in got]).astype(np.float32) if got else np.zeros((0, dims), np.float32)
    label = np.array([r.label for r in got])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    v = vectors(tf, idf)
    cents, language, floor = [], [], []
    classes = length_class(tf)
    for i, name in enumerate(names):
        own = v[(label == name) & (tf.sum(axis=1) > 0)]
        if not len(own):
            continue
        c = spherical_kmeans(own, centroids)
        cents.append(c)
        language += [i] * len(c)
    if not cents:
        return Model(idf, np.zeros((1, dims), np.float32), [0], [UNKNOWN], np.full((1, LENGTHS), 2.0))
    c = np.concatenate(cents).astype(np.float32)
    cos = v @ c.T
    # a text counts for the nearest centroid of its own language
    of_label = np.where(np.array(language)[None, :] == np.searchsorted(names, label)[:, None], cos, -1.0)
    best = of_label.argmax(axis=1)
    top = of_label[np.arange(len(best)), best]
    floor = np.zeros((len(c), LENGTHS))
    for j in range(LENGTHS):
        near = (abs(classes - j) <= 1) & (top >= 0)
        for k in range(len(c)):
            own = top[near & (best == k)]
            if len(own) >= FEW:
                limit = min(own.min(), own.mean() - SPREAD * own.std())
            elif near.sum() >= FEW:
                limit = top[near].min()
            else:
                continue
            floor[k, j] = 1 - reject_share * (1 - limit)
    return Model(idf, c, language, names, floor)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_IS_ASCII_LETTER[data], dtype=np.int64)))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return out


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(model.idf)
        names = np.array([*model.names, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(1))
            for i, j in tk.chunks(offsets):
                for s in range(i, j, BLOCK_TEXTS):
                    e = min(s + BLOCK_TEXTS, j)
                    own, at = data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
                    which, score, far = model.predict(counts(own, at, dims))
                    none = ~has_letter(own, at)
                    if model.names == [UNKNOWN]:
                        none[:] = True
                    which = np.where(none, len(model.names), which)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(names[which], pa.string()), pa.array(np.where(none, 0.0, score), pa.float64()), pa.array(far | none)], ["id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tk.lean(_predicted(model)), "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that fitting never sees."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull())


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    from .store import documents

    docs = documents(spark, sf_dir)
    out = predict(docs, fit(training_rows(docs)))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def _kept(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            pair = pa.RecordBatch.from_arrays([ids, batch.column(text_at)], ["id", "text"])
            for got in _predicted(model)([pair]):
                yield batch.take(got.column(0).filter(pa.compute.invert(got.column(3))))

    return run


def recognised(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that language identification rejects go; whole rows pass through one task, nothing is joined."""
    model = fit(training_rows(docs))
    return docs.mapInArrow(tk.lean(_kept(model, docs.columns.index("text"))), docs.schema)
