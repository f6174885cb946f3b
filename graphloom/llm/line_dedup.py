"""Line deduplication by winnowing over line hashes.

Lines (split at \\n, those with a word) are hashed. Of every `window` consecutive
lines the one with the smallest hash is selected, the first of equal ones; the
selected lines are the fingerprints, about 2 of every `window` + 1 lines. Equal windows
select the same line at the same place, so two texts that share a run of
`window` lines share a fingerprint in it: any such run is found.

1. A row for each selected line, with the hashes of the windows that it was selected
   for, goes to the place of its fingerprint; those that occur once leave.
2. Matches are extended both ways from a fingerprint that occurs again: before it and behind
   it as far as its windows reach, where the next fingerprint of the run goes on. For each
   window the earliest occurrence is found; the others are matched with it.
   Overlapping and touching matches are one run.

A line is deleted if it lies in a run of `window` or more lines that also occurs
earlier, in a document with a smaller id or further up in the same; runs are judged on the
input. With `long_words`, a single line of so many words counts as a run as well.

Within a task, all occurrences of a fingerprint or of a window but the first are
settled before the shuffle, so a line or a run that a third of all texts hold sends
one row a block of lines. No pairs are made.

Null text stays null; empty texts and texts of fewer lines stay as they are; a text
all of whose lines repeat becomes empty. Lines without a word never match and
always stay. Repeated rows (same id and text) are one document and each get its
result; rows with a null id keep all lines; an empty table gives an empty result;
other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .suffix_dedup import merged, rewritten, sliding_min, sorted_groups

WINDOW = 3
#: A line of so many words is deleted on its own in the pipeline.
LONG_WORDS = 50
HELD_WINDOWS = 300_000


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, text, has a word) of every line of a buffer of texts."""
    texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((offsets[1:], breaks)))
    text = np.sort(np.concatenate((np.arange(texts), np.searchsorted(offsets, breaks, "right") - 1)))
    solid = np.concatenate(([0], np.cumsum(~tk.IS_SPACE[data], dtype=np.int64)))
    return start, end, text, solid[end] > solid[start]


def fingerprints(data: np.ndarray, offsets: np.ndarray, window: int, long_words: int | None = None) -> tuple[np.ndarray, ...]:
    """The windows of the texts with the line selected for each: (fingerprint, text, selected line, first line, lines, content).

    Equal windows have equal fingerprints and contents.
    """
    start, end, text, full = lines(data, offsets)
    start, end, text = start[full], end[full], text[full]
    hashes = tk.Prefix(data).of(start, end)
    number = np.arange(len(text)) - np.searchsorted(text, text, "left")
    out = [(hashes[:0], text[:0], number[:0], number[:0], number[:0], hashes[:0])]
    if len(hashes) >= window:
        content, first = tk.windows(hashes, text, window)
        bits = np.uint64((1 << len(hashes).bit_length()) - 1)
        least = sliding_min((hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64), window)
        selected = (least[first] & bits).astype(np.int64)
        out.append((tk.mix(hashes[selected] + tk.odd(40)), text[first], number[selected], number[first], np.full(len(first), window), content))
    if long_words:
        solid = ~tk.IS_SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[start] = solid[start]  # also where the text before ends in a word
        words = np.concatenate(([0], np.cumsum(begins)))
        long = np.flatnonzero(words[end] - words[start] >= long_words)
        out.append((tk.mix(hashes[long] + tk.odd(41)), text[long], number[long], number[long], np.ones(len(long), np.int64), tk.mix(hashes[long] + tk.odd(42))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Rows on their way to the place of a fingerprint (key): windows of a selected line from `line` on; or, with
#: size > 0, a run of lines that is known to be a later occurrence; `known`: the fingerprint occurs elsewhere for sure.
MARKED = "key long, doc long, line long, size long, span long, known boolean, windows array<long>"
#: Rows on their way to the place of a window's content.
COLUMNS = ["key", "doc", "line", "size", "span"]


def _settled(content: np.ndarray, doc: np.ndarray, line: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, doc, line, size, span): the first occurrence of each window, and the others as runs (size > 0)."""
    order = np.lexsort((line, doc, content))
    content, doc, line, span = (x[order] for x in (content, doc, line, span))
    first = np.ones(len(content), dtype=bool)
    first[1:] = content[1:] != content[:-1]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = ~first & ((doc != doc[lead]) | (line != line[lead]))
    d, s, e = merged(doc[later], line[later], line[later] + span[later])
    none = np.zeros(int(first.sum()), np.int64)
    pairs = ((content[first], tk.signed(tk.mix(d.view(np.uint64)))), (doc[first], d), (line[first], s), (none, e - s), (span[first], np.zeros(len(d), np.int64)))
    return tuple(np.concatenate(x) for x in pairs)


def _selected(window: int, long_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            found = [np.concatenate([h[i] for h in held]) for i in range(6)]
            order = np.lexsort((found[5], found[3], found[2], found[1], found[0]))
            found = [x[order] for x in found]
            once = np.ones(len(order), dtype=bool)  # repeated rows of the input are one document
            once[1:] = np.any([x[1:] != x[:-1] for x in found], axis=0)
            key, doc, at, line, span, content = (x[once] for x in found)
            other = np.ones(len(key), dtype=bool)  # another selected line than the row before
            other[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (line[1:] != line[:-1] + 1)
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            again = (np.bincount(group, weights=other) > 1)[group]
            # fingerprints that occur here more than once are settled here; of each a row without windows goes on
            mark = new & again
            settled = _settled(content[again], doc[again], line[again], span[again])
            alone = np.flatnonzero(other & ~again)
            many = np.bincount((np.cumsum(other & ~again) - 1)[~again], minlength=len(alone))
            n, m, k = len(alone), int(mark.sum()), len(settled[0])
            is_window = settled[3] == 0
            sizes = np.concatenate((many, np.zeros(m, np.int64), is_window.astype(np.int64)))
            flat = np.concatenate((content[~again], settled[0][is_window]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
            zero = np.zeros(n + m, np.int64)
            columns = [
                np.concatenate((key[alone], key[mark], tk.signed(tk.mix(settled[0].view(np.uint64) + tk.odd(43))))), np.concatenate((doc[alone], doc[mark], settled[1])),
                np.concatenate((line[alone], line[mark], settled[2])), np.concatenate((zero, settled[3])), np.concatenate((span[alone], span[mark], settled[4])),
            ]
            known = np.concatenate((np.zeros(n, bool), np.ones(m + k, bool)))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(known), lists], [c.split(" ")[0] for c in MARKED.split(", ")])

        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in tk.chunks(offsets):
                key, text, at, line, span, content = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, long_words)
                held.append((tk.signed(key), ids[i:j][text].astype(np.int64), at, line, span, tk.signed(content)))
                count += len(text)
                if count > HELD_WINDOWS:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MARKED rows sorted by key to the windows around fingerprints that occur more than once, and to known runs."""
    open_key = None  # of a group that a cut left open
    for table, cut in sorted_groups(batches, HELD_WINDOWS // 3):
        key, doc, line, size, span, known = (table.column(i).to_numpy() for i in range(6))
        lists = table.column(6).combine_chunks()
        starts = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        many = np.bincount(np.cumsum(new) - 1) > 1
        many[0] |= key[0] == open_key
        many[-1] |= cut
        open_key = key[-1] if cut else None
        go = np.flatnonzero((many[np.cumsum(new) - 1] | known) & (size == 0))
        count = np.diff(starts)[go]
        row = np.repeat(go, count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        settled = _settled(flat[starts[row] + step], doc[row], line[row] + step, span[row])
        runs = size > 0
        rest = (key[runs], doc[runs], line[runs], size[runs], np.zeros(int(runs.sum()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(settled, rest, strict=True)], COLUMNS)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by content, document and line to the runs of lines that are later occurrences."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, line, size, span = (batch.column(i).to_numpy() for i in range(5))
        known = size > 0
        out = [(doc[known], line[known], size[known])]
        key, doc, line, span = key[~known], doc[~known], line[~known], span[~known]
        if len(key):
            first = np.concatenate(([True], key[1:] != key[:-1]))
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            lead_doc, lead_line = doc[lead].copy(), line[lead].copy()
            if before is not None and before[0] == key[0]:
                lead_doc[lead == 0], lead_line[lead == 0] = before[1:]
            later = (doc != lead_doc) | (line != lead_line)
            out.append((doc[later], line[later], span[later]))
            before = (key[-1], lead_doc[-1], lead_line[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["doc", "line", "size"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, valid = tk.utf8(batch.column(1))
        lists = batch.column(2)
        inner = lists.values
        first, size = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = lists.offsets.to_numpy()
        filled = np.asarray(lists.is_valid())
        start, end, text, full = lines(data, offsets)
        of = np.searchsorted(text, np.arange(batch.num_rows + 1))
        counts, removed, runs, kept = [], [], [], []
        for r in range(batch.num_rows):
            own = data[offsets[r] : offsets[r + 1]].tobytes()
            a, b = of[r], of[r + 1]
            worded = np.flatnonzero(full[a:b])
            counts.append(len(worded))
            gone = n_runs = 0
            if filled[r] and cuts[r + 1] > cuts[r]:
                s, z = first[cuts[r] : cuts[r + 1]], size[cuts[r] : cuts[r + 1]]
                _, s, e = merged(np.zeros(len(s), np.int64), s, np.minimum(s + z, len(worded)))
                stay = np.ones(b - a, dtype=bool)
                for x, y in zip(s, e, strict=True):
                    stay[worded[x:y]] = False
                gone, n_runs = int((~stay).sum()), len(s)
                own = b"\n".join([data[start[a + k] : end[a + k]].tobytes() for k in np.flatnonzero(stay)])
            removed.append(gone), runs.append(n_runs)
            kept.append(own.decode() if valid[r] else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, removed, runs)), pa.array(kept, pa.string())], ["id", "n_lines", "n_removed", "n_runs", "kept_text"])


def line_ranges(texts: DataFrame, window: int, long_words: int | None = None) -> DataFrame:
    """(doc, ranges): the lines of texts (id, text), counted over lines with a word, that are later occurrences."""
    marked = texts.mapInArrow(tk.lean(_selected(window, long_words)), MARKED).repartition("key").sortWithinPartitions("key")
    found = marked.mapInArrow(tk.lean(_extended), ", ".join(f"{c} long" for c in COLUMNS)).repartition("key").sortWithinPartitions("key", "doc", "line")
    return found.mapInArrow(tk.lean(_later), "doc long, line long, size long").groupBy("doc").agg(F.collect_list(F.struct("line", "size")).alias("ranges"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """(id_col, n_lines, n_removed, n_runs, kept_text): lines with a word, those deleted, in how many runs, and the rest."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = source.where("id is not null")
    ranges = line_ranges(texts, window, long_words)
    joined = texts.join(ranges.hint("shuffle_hash"), texts["id"] == ranges["doc"], "left").select("id", "text", "ranges")
    rest = source.where("id is null").withColumn("ranges", F.lit(None).cast("array<struct<line:long,size:long>>"))
    return joined.union(rest).mapInArrow(tk.lean(_cut), "id long, n_lines long, n_removed long, n_runs long, kept_text string").withColumnRenamed("id", id_col)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .store import documents

    return line_dedup(documents(spark, sf_dir))


def without_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later occurrences of runs of lines, or of one line of LONG_WORDS words, leave the texts.

    Documents stay, if need be with an empty text.
    """
    ranges = line_ranges(docs.select(F.col("doc_id").alias("id"), "text").where("id is not null"), WINDOW, LONG_WORDS)
    return rewritten(docs, ranges, _cut)


OP9_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents where text is not null),
w as (select doc_id, line, pos, row_number() over (partition by doc_id order by pos) - 1 k from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
t as (select *, count(*) over (partition by doc_id) n, lead(line) over p l2, lead(line, 2) over p l3, lead(k, 2) over p k3 from w window p as (partition by doc_id order by k)),
s as (select doc_id, k, row_number() over (partition by line, l2, l3 order by doc_id, k) occ from t where k3 is not null),
g as (select distinct doc_id, k + d k from s, (select unnest([0, 1, 2]) d) where occ > 1),
r as (select doc_id, k, k - row_number() over (partition by doc_id order by k) island from g),
c as (select doc_id, count(*) n_removed, count(distinct island) n_runs from r group by 1),
gone as (select w.doc_id, w.pos from w join g using (doc_id, k)),
kept as (select doc_id, string_agg(line, chr(10) order by pos) kept_text from l anti join gone using (doc_id, pos) group by 1),
cnt as (select doc_id, count(*) n_lines from w group by 1)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_runs, 0)::bigint n_runs,
  case when d.text is null then null else coalesce(kept_text, '') end kept_text
from documents d left join cnt using (doc_id) left join c using (doc_id) left join kept using (doc_id)
"""
