"""Suffix-array deduplication: repeated substrings of `length` bytes by distributed prefix doubling.

Ranks are given to byte strings that start at text positions; each round sorts
pairs of ranks at a growing offset and only positions whose rank is not unique
go on, until the rank stands for `length` bytes.

* *Rank of h bytes*, h at most half the length. Sorting a rank for every position would move a
  multiple of the text each round. Every window of `length` bytes owns one string of h bytes, its
  smallest by hash, so windows that are equal own equal strings at equal places,
  and neighbouring windows mostly own the same: a *run*. One row a run, not one a
  position, is sorted by (rank of the owned string, rank of all the run's bytes).
  Owned strings that are unique leave. A run equal to an earlier one is a
  repeat as a whole. Equal runs of one task meet before the sort.
* *Pairs of ranks.* What is left are different runs around an equal string. All their
  positions are sorted by the pair (rank of the first h bytes, rank of the bytes at offset h),
  equal pairs get one new rank of 2h bytes, and positions whose pair is unique leave; so on
  at offset 2h (or the smaller one that ends at `length`), until the rank
  stands for `length` bytes. Of positions that are then equal all but the earliest are
  repeats. Ranks of up to h bytes are hashes of the bytes, so that no sort is needed to make them;
  later ones are numbers that the sort gives. Equal positions of one task meet before the first sort.

A byte goes if a repeat covers it; repeats are judged on the input. Earlier means
smaller id, or the same document and smaller start.

Null and empty text: nothing to remove. Repeated rows (same id and text) are one
document and each get its result; rows with a null id take no part and keep all
bytes; an empty table gives an empty result; other columns are ignored. Removal
may split a character when bytes of different characters repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import written

#: Bytes of the first rank at most.
SEED = 50
#: The shortest length: shorter first ranks occur by chance.
SHORTEST = 64
#: Positions that a task holds before equal ones among them are settled.
HELD_POSITIONS = 400_000
#: Runs that a task holds before equal ones among them are merged.
HELD_RUNS = 300_000


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    span, out = 1, keys
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def steps(length: int) -> list[int]:
    """Offsets at which ranks of h = min(SEED, length // 2) bytes cover `length` bytes; the last one overlaps if need be."""
    h = min(SEED, length // 2)
    return [*range(0, length - h, h), length - h]


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, owned string, all bytes): the runs of windows that own the same string."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = min(SEED, length // 2)
    grams = tk.grams(data, h)
    bits = np.uint64((1 << len(data).bit_length()) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min((grams & ~bits) | place, length - h + 1) & bits).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[: len(owner)] == text[length - 1 :]
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none, none
    own, who = owner[start], text[start]
    fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (who[1:] != who[:-1])))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    whole = tk.Prefix(data).of(begin, begin + count + length - 1)
    return who[first], begin - offsets[who[first]], count, tk.signed(grams[own[first]]), tk.signed(whole)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, those that touch joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.zeros(len(doc), dtype=np.int64)
    new_doc = np.concatenate(([False], doc[1:] != doc[:-1]))
    shift[new_doc] = int(end.max()) + 1
    shift = np.cumsum(shift)  # documents one behind the other, so that one running maximum serves all
    s, e = start + shift, np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], e[last] - shift[last]


SORTED = ["gram", "run", "doc", "start", "windows"]


def _found(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of the texts; windows < 0: bytes from start that are known to be repeats."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, start, count, gram, whole = (np.concatenate([h[i] for h in held]) for i in range(5))
            order = np.lexsort((start, doc, whole))
            doc, start, count, gram, whole = (x[order] for x in (doc, start, count, gram, whole))
            first = np.concatenate(([True], whole[1:] != whole[:-1]))
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = ~first & ((doc != doc[lead]) | (start != start[lead]))
            d, s, e = merged(doc[later], start[later], start[later] + count[later] + length - 1)
            cols = [
                np.concatenate((gram[first], tk.signed(tk.mix(d.view(np.uint64))))), np.concatenate((whole[first], np.zeros(len(d), np.int64))),
                np.concatenate((doc[first], d)), np.concatenate((start[first], s)), np.concatenate((count[first], s - e)),
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], SORTED)

        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in tk.chunks(offsets):
                who, *rest = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                held.append((ids[i:j][who].astype(np.int64), *rest))
                size += len(who)
                if size > HELD_RUNS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted batches as tables that end with a group of the first column, or, if that is very long, are marked as cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1], "left"))
            if end:
                yield table.slice(0, end), False
                held = table.slice(end).to_batches()
                size = table.num_rows - end
            elif size >= 4 * rows:
                yield table, True
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held), False


def _ranked(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs to repeats (gram null) and to the runs whose string has other runs too."""
        before = None  # (gram, run, doc, start) of the group that a cut left open
        for table, cut in sorted_groups(batches, 100_000):
            gram, whole, doc, start, count = (table.column(i).to_numpy() for i in range(5))
            known = count < 0
            d, s, e = [doc[known]], [start[known]], [start[known] - count[known]]
            gram, whole, doc, start, count = (x[~known] for x in (gram, whole, doc, start, count))
            out = [np.zeros(0, np.int64)] * 4
            if len(gram):
                new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
                new_run = new_gram | np.concatenate(([True], whole[1:] != whole[:-1]))
                lead = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                lead_doc, lead_start = doc[lead].copy(), start[lead].copy()
                opened = before is not None and gram[0] == before[0]
                if opened and whole[0] == before[1]:
                    same = lead == 0
                    lead_doc[same], lead_start[same] = before[2], before[3]
                    new_run[0] = False
                later = (doc != lead_doc) | (start != lead_start)
                d.append(doc[later]), s.append(start[later]), e.append(start[later] + count[later] + length - 1)
                group = np.cumsum(new_gram) - 1
                kinds = np.bincount(group, weights=new_run).astype(int)
                many = kinds > 1
                if opened:
                    many[0] = True
                if cut:
                    many[-1] = True  # one more row at worst
                go = new_run & many[group]
                out = [x[go] for x in (gram, doc, start, count)]
                before = (gram[-1], whole[-1], lead_doc[-1], lead_start[-1]) if cut else None
            d, s, e = merged(*(np.concatenate(x) for x in (d, s, e)))
            cols = [pa.array(np.concatenate(x), pa.int64()) for x in ((out[1], d), (out[2], s), (out[3], e - s))]
            grams = pa.concat_arrays([pa.array(out[0], pa.int64()), pa.nulls(len(d), pa.int64())])
            yield pa.RecordBatch.from_arrays([grams, *cols], ["gram", "doc", "start", "size"])

    return run


def _positions(length: int):
    at_steps = steps(length)
    names = ["rank", "next", "doc", "start", "size", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text, open runs) to the positions of the runs with their first ranks; size > 0: bytes known to be repeats.

        rank, next: of the bytes at the first two steps; rest: at the others.
        """
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            doc, start, *ranks = (np.concatenate([h[i] for h in held]) for i in range(2 + len(at_steps)))
            whole = ranks[0]
            for i, r in enumerate(ranks[1:]):
                whole = tk.mix(whole * tk.odd(30 + i) + r)
            order = np.lexsort((start, doc, whole))
            doc, start, whole, *ranks = (x[order] for x in (doc, start, whole, *ranks))
            first = np.ones(len(whole), dtype=bool)
            first[1:] = whole[1:] != whole[:-1]
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = ~first & ((doc != doc[lead]) | (start != start[lead]))
            d, s, e = merged(doc[later], start[later], start[later] + length)
            n, m = int(first.sum()), len(d)
            key = tk.mix(d.view(np.uint64) + tk.odd(33))
            columns = [pa.array(tk.signed(np.concatenate((ranks[0][first], key)))), pa.array(tk.signed(np.concatenate((ranks[1][first], key))))]
            columns += [pa.array(np.concatenate(x)) for x in ((doc[first], d), (start[first], s), (np.zeros(n, np.int64), e - s))]
            more = np.stack(ranks[2:], axis=1)[first].ravel() if len(ranks) > 2 else np.zeros(0, np.uint64)
            sizes = np.concatenate((np.full(n, len(ranks) - 2), np.zeros(m, np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(tk.signed(more)))
            return pa.RecordBatch.from_arrays([*columns, lists], names)

        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            start, size = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = lists.offsets.to_numpy()
            for i, j in tk.chunks(offsets):
                own = data[offsets[i] : offsets[j]]
                grams = tk.grams(own, min(SEED, length // 2))
                s, n = start[cuts[i] : cuts[j]], size[cuts[i] : cuts[j]]
                text = np.repeat(np.arange(i, j), np.diff(cuts[i : j + 1]))
                # another row with the same id may be shorter than this one, whose runs these are
                n = np.minimum(n, offsets[text + 1] - offsets[text] - s - length + 1)
                n = np.maximum(n, 0)
                row = np.repeat(np.arange(len(s)), n)
                at = s[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                place = offsets[text[row]] - offsets[i] + at
                for a in range(0, len(row), HELD_POSITIONS):
                    some = slice(a, a + HELD_POSITIONS)
                    held.append((ids[text[row[some]]].astype(np.int64), at[some], *(grams[place[some] + step] for step in at_steps)))
                    count += len(held[-1][0])
                    if count >= HELD_POSITIONS:
                        yield flush()
                        held, count = [], 0
        if count:
            yield flush()

    return run


def _reranked(length: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions sorted by (rank, next, doc, start): equal pairs get one new rank, unique ones leave.

        In the last round to (doc, start, size): all but the first of equal ones are repeats.
        """
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        classes = 0
        held = before = None  # a class that may go on: its last row, and (rank, next, new rank) of one that has begun

        def emit(table: pa.Table, ends: bool) -> pa.RecordBatch:
            """The classes of a table of sorted rows; ends: the last class is known to end with it."""
            nonlocal classes, before
            rank, nxt, doc, start, size = (table.column(i).to_numpy() for i in range(5))
            known = size > 0
            out = [(doc[known], start[known], size[known])]
            live = np.flatnonzero(~known)
            rank, nxt, doc, start = (x[live] for x in (rank, nxt, doc, start))
            new = np.ones(len(live), dtype=bool)
            new[1:] = (rank[1:] != rank[:-1]) | (nxt[1:] != nxt[:-1])
            goes_on = bool(len(live)) and before is not None and (rank[0], nxt[0]) == before[:2]
            number = np.cumsum(new) - 1
            many = np.bincount(number) > 1
            fresh = base + classes + 1 + number
            if goes_on:
                many[0] = True
                fresh[number == 0] = before[2]
            if len(live):
                if not ends:
                    many[-1] = True  # at worst one row too many
                before = (rank[-1], nxt[-1], int(fresh[-1]))
                classes += int(number[-1]) + 1
            if last:
                repeat = ~new
                if goes_on:
                    repeat[0] = True
                d, s, e = merged(doc[repeat], start[repeat], start[repeat] + length)
                out.append((d, s, e - s))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["doc", "start", "size"])
            go = live[many[number]] if len(live) else live
            lists = table.column(5).combine_chunks()
            starts = lists.offsets.to_numpy()
            rest = lists.values.to_numpy(zero_copy_only=False)
            k = np.concatenate((go, np.flatnonzero(known)))
            width = np.maximum(np.diff(starts)[k] - 1, 0)
            index = np.repeat(starts[k] + 1 - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            ranks = np.concatenate((fresh[many[number]] if len(live) else live, table.column(0).to_numpy()[known]))
            nexts = np.concatenate((rest[starts[go]], table.column(1).to_numpy()[known]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32()), pa.array(rest[index]))
            columns = [pa.array(x, pa.int64()) for x in (ranks, nexts, *(table.column(i).to_numpy()[k] for i in (2, 3, 4)))]
            return pa.RecordBatch.from_arrays([*columns, lists], ["rank", "next", "doc", "start", "size", "rest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch] if held is None else [held, batch]
            table = pa.Table.from_batches(parts).combine_chunks()
            held = table.slice(table.num_rows - 1).to_batches()[0]  # its class may go on in the next batch
            if table.num_rows > 1:
                pair = [table.column(i).to_numpy()[-2:] for i in range(2)]
                yield emit(table.slice(0, table.num_rows - 1), any(x[0] != x[1] for x in pair))
        if held is not None:
            yield emit(pa.Table.from_batches([held]), True)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, repeats) to what is removed and what stays."""
    for batch in batches:
        data, offsets, valid = tk.utf8(batch.column(1))
        lists = batch.column(2)
        filled = np.asarray(lists.is_valid())
        inner = lists.values
        start, size = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = lists.offsets.to_numpy()
        total, removed, spans, kept = [], [], [], []
        for r in range(batch.num_rows):
            own = data[offsets[r] : offsets[r + 1]]
            n = len(own)
            gone = count = 0
            if filled[r] and cuts[r + 1] > cuts[r]:
                s, z = start[cuts[r] : cuts[r + 1]], size[cuts[r] : cuts[r + 1]]
                _, s, e = merged(np.zeros(len(s), np.int64), s, np.minimum(s + z, n))
                step = np.zeros(n + 1, dtype=np.int64)
                np.add.at(step, s, 1)
                np.add.at(step, e, -1)
                stay = np.cumsum(step[:-1]) == 0
                own, gone, count = own[stay], int(n - stay.sum()), len(s)
            total.append(n), removed.append(gone), spans.append(count)
            kept.append(own.tobytes() if valid[r] else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digests = [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(digests, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


POSITIONS = "rank long, next long, doc long, start long, size long, rest array<long>"


def repeats(texts: DataFrame, length: int) -> DataFrame:
    """(doc, start, size): byte ranges of texts (id, text) that `length`-byte repeats cover; ranges may overlap."""
    sorted_runs = texts.mapInArrow(tk.lean(_found(length)), ", ".join(f"{c} long" for c in SORTED)).repartition("gram").sortWithinPartitions(*SORTED[:4])
    ranked = written(sorted_runs.mapInArrow(tk.lean(_ranked(length)), "gram long, doc long, start long, size long"), "runs")
    of_doc = ranked.where("gram is not null").groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("open"))
    opened = texts.join(of_doc.hint("shuffle_hash"), texts["id"] == of_doc["doc"], "left").where("open is not null").select("id", "text", "open")
    positions = opened.mapInArrow(tk.lean(_positions(length)), POSITIONS)
    rounds = len(steps(length)) - 1
    for k in range(rounds):
        ordered = positions.repartition("rank", "next").sortWithinPartitions("rank", "next", "doc", "start")
        last = k == rounds - 1
        positions = ordered.mapInArrow(tk.lean(_reranked(length, last)), "doc long, start long, size long" if last else POSITIONS)
        if not last:
            positions = written(positions, "ranks")
    return ranked.where("gram is null").select("doc", "start", "size").union(positions)


def _with_repeats(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    if length < SHORTEST:
        raise ValueError(f"length must be {SHORTEST} or more")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = source.where("id is not null").repartition("id")
    found = repeats(source.where("id is not null"), length)
    ranges = written(found.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("ranges")), "ranges")  # shuffles end here
    joined = texts.join(ranges.hint("shuffle_hash"), texts["id"] == ranges["doc"], "left").select("id", "text", "ranges")
    return joined, source.where("id is null").withColumn("ranges", F.lit(None).cast("array<struct<start:long,size:long>>"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes (null for null text)."""
    joined, rest = _with_repeats(docs, id_col, text_col, length)
    return joined.union(rest).mapInArrow(tk.lean(_cut), "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .store import documents

    joined, rest = _with_repeats(documents(spark, sf_dir), "doc_id", "text", 100)
    return joined.union(rest).mapInArrow(tk.lean(_digested), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", "doc_id")


def rewritten(docs: DataFrame, ranges: DataFrame, cut) -> DataFrame:
    """docs with the (doc, ranges) cut out of their texts and n_chars to match; one join, and every column stays.

    cut: batches (id, text, ranges) to batches that end with the remaining text or bytes.
    """
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            text, found = batch.column(text_at), batch.column(len(names))
            columns = [batch.column(i) for i in range(len(names))]
            hit = np.flatnonzero(np.asarray(found.is_valid()) & np.asarray(text.is_valid()))
            if len(hit):
                pair = pa.RecordBatch.from_arrays([ids, text, found], ["id", "text", "ranges"]).take(pa.array(hit))
                texts = text.to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at >= 0 else []
                for got in cut([pair]):
                    for r, kept in zip(got.column(0).to_pylist(), got.column(got.num_columns - 1).to_pylist(), strict=True):
                        texts[r] = kept.decode(errors="ignore") if isinstance(kept, bytes) else kept
                        if chars_at >= 0:
                            chars[r] = len(texts[r])
                columns[text_at] = pa.array(texts, text.type)
                if chars_at >= 0:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    ranges = ranges.select(F.col("doc").alias("_ranges_of"), F.col("ranges").alias("_ranges"))
    joined = docs.join(ranges.hint("shuffle_hash"), docs["doc_id"] == ranges["_ranges_of"], "left").select(*(docs[c] for c in names), "_ranges")
    return joined.mapInArrow(tk.lean(run), docs.schema)


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: 100-byte repeats leave the texts; characters that removal splits go as well."""
    found = repeats(docs.select(F.col("doc_id").alias("id"), "text").where("id is not null"), 100)
    ranges = written(found.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("ranges")), "ranges")
    return rewritten(docs, ranges, _cut)
