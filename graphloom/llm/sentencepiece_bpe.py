"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Byte-pair encoding has the property that the encoding of every prefix ends in
one well-defined token, and that a token sequence is the encoding of its text
exactly if each adjacent pair is one that merging would leave side by side. So
an automaton over the vocabulary lists the tokens that end at each position;
the one that is compatible with the last token of the prefix before it is that
prefix's entry; the ids are read off backwards. Linear in the text, no heap of
merges.

No piece has anything before a word mark inside it, so a text falls into
independent segments (a run of marks and what follows); each distinct segment
is encoded once per worker while its bounded cache holds it.

Null text counts as empty: begin and end ids only. Texts of any length and of
any characters round-trip (characters without a piece become byte pieces).
Repeated rows are repeated in the result; null ids stay null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import MODELS, lean

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct segments in each of the two generations that a worker remembers.
CACHE_SEGMENTS = 300_000


class Codec:
    """Encoder and decoder of one model file (BPE type, identity normaliser)."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        pieces = m.id_to_piece(list(range(size)))
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        ids = {pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces that span words are not supported")
        # ranks: single characters first, then merges, best score first
        chars = sorted({c for p in ids for c in p})
        merges = sorted((p for p in ids if len(p) > 1), key=lambda p: (-m.get_score(ids[p]), ids[p]))
        self.rank = {p: r for r, p in enumerate(chars + merges)}
        self.base = set(chars)
        self.first_merge = len(chars)
        order = chars + merges
        self.left = list(range(len(order)))
        self.right = list(range(len(order)))
        self.pair: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for c in chars:
            automaton.add_word(c, (self.rank[c], 1))
        for p in merges:
            split = self._last_merge(p)
            if split:
                r = self.rank[p]
                self.left[r], self.right[r] = split
                self.pair[split[0] << 20 | split[1]] = r
                automaton.add_word(p, (r, len(p)))
        automaton.make_automaton()
        self.automaton = automaton
        self.emit = [np.array([ids[p]] if p in ids else [self.byte_id[b] for b in p.encode()], dtype="<u4").tobytes() for p in order]
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        raw = [b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else bytes([int(pieces[i][3:5], 16)]) if m.is_byte(i) else pieces[i].replace(MARK, " ").encode() for i in range(size)]
        self.raw = raw
        self.is_byte = np.array([m.is_byte(i) for i in range(size)])
        self.marked = np.array([pieces[i].startswith(MARK) for i in range(size)])
        self.silent = np.array([m.is_control(i) for i in range(size)])

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens that merging leaves of a piece before its last step; None if merging never makes the piece."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def fits(self, a: int, b: int) -> bool:
        """Would merging leave token a directly before token b?"""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        """Take the merges on both sides of the border back, latest first, looking for one across it that came earlier."""
        limit = 1 << 40
        while True:
            across = self.pair.get(a << 20 | b)
            if across is not None and across < limit:
                return False
            if a > b:
                if a >= self.first_merge:
                    limit, a = a, self.right[a]
                elif b >= self.first_merge:
                    limit, b = b + 1, self.left[b]
                else:
                    return True
            elif b >= self.first_merge:
                limit, b = b + 1, self.left[b]
            elif a >= self.first_merge:
                limit, a = a, self.right[a]
            else:
                return True

    def _run(self, run: str) -> list[int]:
        """Tokens of characters that all have a rank."""
        n = len(run)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits, known = self.fits, self._fits
        for end, (token, length) in self.automaton.iter(run):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = known.get(before << 20 | token)
                if not (fits(before, token) if ok is None else ok):
                    continue
            last[end], back[end] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def segment(self, text: str) -> bytes:
        """Ids of one segment without cache, as little-endian unsigned 32-bit integers."""
        if self.base.issuperset(text):
            return b"".join([self.emit[t] for t in self._run(text)])
        out, run = [], []
        for c in text:
            if c in self.base:
                run.append(c)
                continue
            if run:
                out += [self.emit[t] for t in self._run("".join(run))]
                run = []
            out.append(np.array([self.byte_id[b] for b in c.encode()], dtype="<u4").tobytes())
        if run:
            out += [self.emit[t] for t in self._run("".join(run))]
        return b"".join(out)

    def encode(self, text: str | None, ends: bool = True) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; ends: with begin and end ids."""
        body = b""
        if text:
            if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
                parts = [s[1:] for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))]
            else:
                parts = text.split(" ")
            cache = self._cache
            try:
                body = b"".join([cache[p] for p in parts])
            except KeyError:
                if len(cache) > CACHE_SEGMENTS:
                    self._old, self._cache = cache, {}
                    cache = self._cache
                known, old = [], self._old
                for p in parts:
                    ids = cache.get(p)
                    if ids is None:
                        ids = old.get(p)
                        if ids is None:
                            ids = self.segment(MARK + p)
                        if len(p) <= 64:
                            cache[p] = ids
                    known.append(ids)
                body = b"".join(known)
        return self._begin + body + self._end if ends else body

    @property
    def _begin(self) -> bytes:
        return self.bos.to_bytes(4, "little")

    @property
    def _end(self) -> bytes:
        return self.eos.to_bytes(4, "little")

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Text of ids; bytes that form no character become U+FFFD, control ids nothing."""
        ids = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else np.asarray(ids, dtype=np.uint32)
        loud = ids[~self.silent[ids]]
        if not len(loud):
            return ""
        raw = self.raw
        data = b"".join([raw[i] for i in loud.tolist()])
        if self.marked[loud[0]]:
            data = data[1:]
        broken = self.silent[ids[1:-1]].any() and self.is_byte[loud].any()  # a control id ends a run of bytes
        try:
            if not broken:
                return data.decode()
        except UnicodeDecodeError:
            pass
        out, held, k = [], b"", -1
        for i in ids.tolist():
            k += not self.silent[i]
            if self.is_byte[i]:
                held += raw[i]
                continue
            out.append(_bytewise(held))
            held = b""
            if self.silent[i]:
                continue
            piece = raw[i].decode()
            out.append(piece[1:] if k == 0 and self.marked[i] else piece)
        return "".join(out) + _bytewise(held)


def _bytewise(data: bytes) -> str:
    """Characters where bytes form them, else one U+FFFD a byte."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}
MODELS.append(_codecs)


def codec(model_file: str) -> Codec:
    """One per worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): ids binary, little-endian unsigned 32-bit integers, with begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            ids = [own.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, models=True), "id long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of what encode_documents gives; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [None if (v := x.as_py()) is None else own.decode(bytes(v)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(lean(run, models=True), "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass, ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for x in batch.column(1):
                ids = own.encode(x.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, models=True), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .store import documents

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
