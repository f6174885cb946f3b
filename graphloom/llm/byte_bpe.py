"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct word encoded once.

The pre-tokeniser of such a vocabulary starts a piece before every space but those
inside a run of white space, so a text without such spaces can be cut at its
spaces and the library's ids of the parts put together. Cutting, finding the
distinct parts and putting ids together are Arrow and numpy calls over a whole
batch; the library sees only parts that a worker's bounded cache does not hold.
Where a piece surely ends (between ASCII letters, digits and other marks, and around a line feed alone) parts are cut
again, so that fewer are distinct, and what is asked of the library is joined to strings of many parts, whose ids show
where each begins. Other texts are cut elsewhere, one by one.

Where only the number of ids is wanted, the merges of distinct parts of printable ASCII
are carried out with the vocabulary's merge table in numpy, all parts of one length
together; the counts are the library's (tested). All other parts go to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import MODELS, utf8

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Distinct words in each of the two generations that a worker remembers.
CACHE_WORDS = 250_000
#: Words that are joined to one string for the library.
JOINED = 250
#: Texts that are cut in one call.
ROWS = 3000
#: A space that neither begins nor ends its run of white space, or two spaces (RE2 syntax).
_INNER_SPACE = "  |[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] [\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

#: White space at an end of a word, or nothing at all (RE2 syntax).
_EDGE_SPACE = "^$|^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]$"


class _Words:
    """Ids of words that have the same text before them, in two generations."""

    def __init__(self, tokenizer, before: str):
        self.tokenizer, self.before = tokenizer, before
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        now, old = self.now, self.old
        found = [now.get(w) for w in words]
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            ask = []
            for i in missing:
                known = old.get(words[i])
                if known is None:
                    ask.append(i)
                else:
                    found[i] = now[words[i]] = known
            for s in range(0, len(ask), 20_000):
                part = ask[s : s + 20_000]
                for i, e in zip(part, self.tokenizer.encode_batch_fast([self.before + words[i] for i in part], add_special_tokens=False), strict=True):
                    found[i] = now[words[i]] = array("H", e.ids).tobytes()
            if len(now) > CACHE_WORDS:
                self.old, self.now = now, {}
        return found


def _gathered(code: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of codes, one behind the other."""
    n = length[code]
    start = np.cumsum(length) - length
    return ids[np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class _Joined:
    """Ids of many words, joined to few strings for the library: by spaces, if a space is before each, else by line feeds.

    A space begins a piece, and nothing else makes ids that begin with a space; a line feed between other marks is a
    piece and an id of its own. So these ids show where words begin. Words that hold a line feed, or begin or end
    with white space, which would run into the next, are left to `one_by_one`.
    """

    def __init__(self, tokenizer, one_by_one: _Words, fits: bool):
        self.tokenizer, self.one_by_one, self.fits, self.spaced = tokenizer, one_by_one, fits, one_by_one.before == " "
        self.begins = np.zeros(1 << 16, dtype=bool)
        for piece, i in tokenizer.get_vocab().items():
            self.begins[i] = piece.startswith("\u0120") if self.spaced else piece == "\u010a"
        self.lead = len(tokenizer.encode("x", add_special_tokens=False).ids)  # a string begins with it
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint16))

    def _keep(self, words: pa.Array, length: np.ndarray, ids: np.ndarray) -> None:
        """Words seen more than once in a batch, with their ids."""
        self.words, self.length, self.kept = words, length, ids

    def _singly(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = self.one_by_one.ids(words.to_pylist())
        return np.array([len(x) // 2 for x in raw], dtype=np.int64), np.frombuffer(b"".join(raw), "<u2")

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, all ids) of words that do not run into each other."""
        ends = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        mark = " " if self.spaced else "\n"
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), mark).to_pylist()
        found = self.tokenizer.encode_batch_fast(["x" + mark + x for x in lines], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids[self.lead :], dtype=np.uint16) for e in found])
        first = np.flatnonzero(self.begins[flat])
        if len(first) != len(words) or first[0]:
            return self._singly(words)  # another kind of vocabulary
        length = np.diff(first, append=len(flat))
        return (length, flat) if self.spaced else (length - 1, np.delete(flat, first))

    def _asked(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, all ids) from the library."""
        data, offsets, _ = utf8(words)
        some = np.diff(offsets) > 0
        edge = np.zeros((len(words), 2), dtype=np.uint8)
        edge[some, 0], edge[some, 1] = data[offsets[:-1][some]], data[offsets[1:][some] - 1]
        plain = ((edge > 32) & (edge < 127)).all(axis=1) & self.fits
        odd = np.flatnonzero(~plain & self.fits)  # other letters and other white space
        if len(odd):
            plain[odd] = ~pc.match_substring_regex(words.take(pa.array(odd)), _EDGE_SPACE).to_numpy(zero_copy_only=False)
        if not self.spaced:
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            plain &= lines[offsets[1:]] == lines[offsets[:-1]]
        if plain.all():
            return self._together(words) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.uint16))
        length = np.zeros(len(words), dtype=np.int64)
        length[~plain], other = self._singly(words.filter(pa.array(~plain)))
        ids = np.zeros(0, np.uint16)
        if plain.any():
            length[plain], ids = self._together(words.filter(pa.array(plain)))
        out = np.empty(int(length.sum()), dtype=np.uint16)
        mine = np.repeat(plain, length)
        out[mine], out[~mine] = ids, other
        return length, out

    def table(self, words: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each word, ids of each code, all their ids); times: how often each stands in the texts."""
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        known = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(known < 0)
        kept = len(self.words)
        known[new] = kept + np.arange(len(new))
        fresh = coded.dictionary.take(pa.array(new))
        length, ids = self._asked(fresh)
        all_length, all_ids = np.concatenate((self.length, length)), np.concatenate((self.kept, ids))
        often = np.bincount(code, weights=times, minlength=len(known))[new] > 1
        if often.any():
            words, length, ids = fresh.filter(pa.array(often)), length[often], ids[np.repeat(often, length)]
            if kept + len(words) > CACHE_WORDS:
                self._keep(words, length, ids)
            else:
                self._keep(pa.concat_arrays([self.words, words]), np.concatenate((self.length, length)), np.concatenate((self.kept, ids)))
        return known[code], all_length, all_ids


#: Letters, digits, other printable ASCII (the apostrophe may belong to letters behind it), line feeds; nothing is cut beside the rest.
_KIND = np.full(256, 9, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1
_KIND[39] = 9
_KIND[10] = 3


def _cut(words: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(parts of words, which of them begin a word): cut where a piece surely ends; words of `whole` are not."""
    data, offsets, _ = utf8(words)
    kind = _KIND[data]
    if whole.any():
        kind[np.repeat(whole, np.diff(offsets))] = 9
    empty = offsets[1:] == offsets[:-1]
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[offsets[:-1][~empty]] = True
    begin[-1] = True
    lines = np.flatnonzero(kind == 3)  # one alone is a piece of its own, several are not
    inside = lines[~begin[lines] & ~begin[lines + 1]]
    alone = inside[(kind[inside - 1] < 3) & (kind[inside + 1] < 3)]
    kind[lines] = 9
    kind[alone] = 3
    begin[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] < 9) & (kind[:-1] < 9)
    at = np.concatenate(([0], np.cumsum(begin[:-1])))
    n = np.where(empty, 1, at[offsets[1:]] - at[offsets[:-1]])
    first = np.cumsum(n) - n
    cuts = np.full(int(n.sum()) + 1, len(data), dtype=np.int32)
    full = np.ones(len(cuts) - 1, dtype=bool)
    full[first[empty]] = False
    cuts[:-1][full] = np.flatnonzero(begin[:-1])
    cuts[first[empty]] = offsets[:-1][empty]
    leads = np.zeros(len(cuts) - 1, dtype=bool)
    leads[first] = True
    return pa.Array.from_buffers(pa.string(), len(leads), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]), leads


class _Merges:
    """Counts of ids of many ASCII parts at once, by the merge table."""

    LONGEST = 40
    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, cut = whole["model"], whole["pre_tokenizer"] or {}
        #: Only then are words cut as `counts` does; otherwise the library counts all of them.
        self.fits = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not whole["normalizer"] and not model.get("ignore_merges") and not model.get("dropout")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)  # by rank
        # printable ASCII stands for itself in such vocabularies, the space for U+0120
        self.byte = np.zeros(128, dtype=np.uint32)
        for b in range(33, 127):
            self.byte[b] = vocab[chr(b)]
        self.byte[32] = vocab["\u0120"]
        self.start = np.full((128, 128), self.NONE, dtype=np.int32)  # ranks of pairs of bytes
        for a in range(32, 127):
            for b in range(32, 127):
                self.start[a, b] = self.rank(self.byte[[a]], self.byte[[b]])[0]
        kind = np.full(128, 2, dtype=np.uint8)  # other marks
        kind[[*range(65, 91), *range(97, 123)]] = 0
        kind[48:58] = 1
        self.kind = kind

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.uint32(16) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def _merged(self, chars: np.ndarray) -> np.ndarray:
        """How many ids each row of bytes ends as: every round merges the best pair of each row that has one."""
        out = np.empty(len(chars), dtype=np.int64)
        rows, ids = np.arange(len(chars)), self.byte[chars]
        rank = self.start[chars[:, :-1], chars[:, 1:]]
        while len(rows) and rank.shape[1]:
            line = np.arange(len(rows))
            best = rank.argmin(axis=1)
            low = rank[line, best]
            some = low != self.NONE
            if not some.all():
                out[rows[~some]] = ids.shape[1]
                rows, ids, rank, best, low = rows[some], ids[some], rank[some], best[some], low[some]
                line = line[: len(rows)]
                if not len(rows):
                    return out
            n, width = ids.shape
            ids[line, best] = self.made[low]
            keep = np.ones((n, width), dtype=bool)
            keep[line, best + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            rank = rank[np.delete(keep, 0, axis=1)].reshape(n, width - 2)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.rank(ids[left, best[left] - 1], ids[left, best[left]])
            right = np.flatnonzero(best < width - 2)
            rank[right, best[right]] = self.rank(ids[right, best[right]], ids[right, best[right] + 1])
        out[rows] = ids.shape[1]
        return out

    def counts(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, with a space before it if spaced; whether the library has to say)."""
        data, offsets, _ = utf8(words)
        n = len(words)
        size = np.diff(offsets)
        plain = (data > 32) & (data < 127) & (data != 39)
        plain[:-1] &= ~((data[:-1] == 60) & (data[1:] == 124))  # may begin a special id
        bad = np.concatenate(([0], np.cumsum(~plain)))
        other = (bad[offsets[1:]] > bad[offsets[:-1]]) | (size == 0) | (size > self.LONGEST)
        out = np.zeros(n, dtype=np.int64)
        mine = np.flatnonzero(~other)
        if not self.fits or not len(mine):
            other[:] = True
            return out, other
        # pieces: runs of letters, of digits or of other marks; the space belongs to the first
        inside = np.repeat(~other, size)
        chars = data[inside]
        word = np.repeat(np.arange(len(mine)), size[mine])
        kind = self.kind[chars]
        first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]))))
        length = np.diff(np.append(first, len(chars)))
        owner = word[first]
        lead = np.concatenate(([True], owner[1:] != owner[:-1])) & spaced
        total = length + lead
        found = np.empty(len(first), dtype=np.int64)
        for size_ in np.unique(total).tolist():
            for has_space in (False, True):
                own = np.flatnonzero((total == size_) & (lead == has_space))
                for s in range(0, len(own), 50_000):
                    some = own[s : s + 50_000]
                    block = np.full((len(some), size_), 32, dtype=np.uint8)
                    shift = int(has_space)
                    block[:, shift:] = chars[first[some][:, None] + np.arange(size_ - shift)]
                    found[some] = self._merged(block)
        out[mine] = np.bincount(owner, weights=found, minlength=len(mine)).astype(np.int64)
        return out, other


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.merges = _Merges(path)
        self.first = _Words(self.tokenizer, "")  # as a text starts
        self.later = _Words(self.tokenizer, " ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @cached_property
    def spaced(self) -> _Joined:
        return _Joined(self.tokenizer, self.later, self.merges.fits)

    @cached_property
    def inner(self) -> _Joined:
        return _Joined(self.tokenizer, self.first, self.merges.fits)

    def _table(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each word, ids of each distinct word, all their ids)."""
        coded = words.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.string())
        whole = np.full(len(distinct), not self.merges.fits)
        for x in self.special:
            whole |= pc.match_substring(distinct, x).to_numpy(zero_copy_only=False)
        parts, leads = _cut(distinct, whole)
        times = np.bincount(code, minlength=len(distinct))[np.cumsum(leads) - 1]
        after_space = leads & spaced
        a, a_len, a_ids = self.spaced.table(parts.filter(pa.array(after_space)), times[after_space])
        b, b_len, b_ids = self.inner.table(parts.filter(pa.array(~after_space)), times[~after_space])
        of_part = np.empty(len(leads), dtype=np.int64)
        of_part[after_space], of_part[~after_space] = a, b + len(a_len)
        length = np.concatenate((a_len, b_len))
        first = np.flatnonzero(leads)
        n = np.add.reduceat(length[of_part], first) if len(first) else np.zeros(0, np.int64)
        return code, n, _gathered(of_part, length, np.concatenate((a_ids, b_ids)))

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Texts without inner spaces: (code of each part, parts of each text, ids of each code, all ids)."""
        lists = pc.split_pattern(texts, " ")
        values, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        count = np.diff(ends, prepend=0)
        begin = ends - count
        is_first = np.zeros(len(values), dtype=bool)
        is_first[begin[count > 0]] = True
        a, a_len, a_ids = self._table(values.filter(pa.array(is_first)), False)
        b, b_len, b_ids = self._table(values.filter(pa.array(~is_first)), True)
        code = np.empty(len(values), dtype=np.int64)
        code[is_first], code[~is_first] = a, b + len(a_len)
        return code, count, np.concatenate((a_len, b_len)), np.concatenate((a_ids, b_ids))

    def _odd(self, text: str) -> bytes:
        parts = _CUT.split(text)
        return self.first.ids(parts[:1])[0] + b"".join(self.later.ids([p[1:] for p in parts[1:]]))

    def encode(self, texts: pa.Array, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as unsigned 16-bit integers, where each text's end); null is empty."""
        flat, sizes = [], []
        for s in range(0, len(texts), rows):
            part = texts.slice(s, rows).fill_null("")
            odd = pc.match_substring_regex(part, _INNER_SPACE).to_numpy(zero_copy_only=False)
            strange = {int(i): np.frombuffer(self._odd(part[int(i)].as_py()), "<u2") for i in np.flatnonzero(odd)}
            code, count, length, ids = self._parts(pc.if_else(pa.array(odd), "", part) if odd.any() else part)
            own = _gathered(code, length, ids)
            total = np.concatenate(([0], np.cumsum(length[code])))
            ends = total[np.cumsum(count)]
            if strange:
                pieces = np.split(own, ends[:-1])
                for i, x in strange.items():
                    pieces[i] = x
                own, ends = np.concatenate(pieces), np.cumsum([len(x) for x in pieces])
            flat.append(own)
            sizes.append(np.diff(ends, prepend=0))
        if not flat:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def _sizes(self, words: pa.Array, cache: _Words, spaced: bool) -> np.ndarray:
        """How many ids each word has."""
        coded = words.dictionary_encode()
        n, other = self.merges.counts(coded.dictionary, spaced)
        ask = np.flatnonzero(other)
        if len(ask):
            n[ask] = [len(x) // 2 for x in cache.ids(coded.dictionary.take(pa.array(ask)).to_pylist())]
        return n[coded.indices.to_numpy(zero_copy_only=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        out = []
        for s in range(0, len(texts), ROWS):
            part = texts.slice(s, ROWS).fill_null("")
            odd = pc.match_substring_regex(part, _INNER_SPACE).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(pc.if_else(pa.array(odd), "", part) if odd.any() else part, " ")
            values, count = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(count)
            is_first = np.zeros(len(values), dtype=bool)
            is_first[(ends - count)[count > 0]] = True
            sizes = np.empty(len(values), dtype=np.int64)
            sizes[is_first] = self._sizes(values.filter(pa.array(is_first)), self.first, False)
            sizes[~is_first] = self._sizes(values.filter(pa.array(~is_first)), self.later, True)
            n = np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends], prepend=0)
            for i in np.flatnonzero(odd):
                n[i] = len(self._odd(part[int(i)].as_py())) // 2
            out.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_loaded: dict[str, ByteBpe] = {}
MODELS.append(_loaded)


def byte_bpe(path: str) -> ByteBpe:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
