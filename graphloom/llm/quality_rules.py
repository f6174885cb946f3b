"""Quality rules as a bitmask ledger.

Every text is measured once; each rule's failure is one bit of a long. Policies
are versions of a mask: a document is kept if no bit of the mask is set, so a
new policy, or the effect of leaving any rule out, needs only the ledger and
bitwise arithmetic on it, never the text.

Null text and text without words have zero measurements (and fail the rule on
few words); repeated rows are repeated; null ids stay null; an empty table
gives an empty result; other columns are ignored. Texts of any length are
measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Rule name -> failure as SQL over the measurements. A rule's bit is its place in this list; only ever append.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "2 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines and n_dup_lines > 3"),
]

#: Policy version -> names of the rules that it enforces.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": [name for name, _ in RULES],
}


def bits(names: list[str]) -> int:
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[n] for n in set(names))


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> list[np.ndarray]:
    """MEASURES of each text of a buffer."""
    texts = len(offsets) - 1
    words = tk.Words(data, offsets)
    prefix = tk.Prefix(data)
    chars = _per_text(words.solid & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_text(_SYMBOL[data], offsets)
    # words covered by windows that occur again in their text
    hashes, at = tk.windows(prefix.of(words.start, words.end), words.text, window)
    keyed = tk.mix(hashes + words.text[at].astype(np.uint64) * tk.odd(20))
    _, inverse, counts = np.unique(keyed, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    step = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    repeated = np.bincount(words.text[np.cumsum(step[:-1]) > 0], minlength=texts)
    # lines with a word that equal an earlier one
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    owner_of_break = np.searchsorted(offsets, breaks, "right") - 1
    line_text = np.sort(np.concatenate((np.arange(texts), owner_of_break)))
    line_end = np.sort(np.concatenate((offsets[1:], breaks)))
    full = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end, line_text = line_start[full], line_end[full], line_text[full]
    keyed = tk.mix(prefix.of(line_start, line_end) + line_text.astype(np.uint64) * tk.odd(21))
    _, first = np.unique(keyed, return_index=True)
    lines = np.bincount(line_text, minlength=texts)
    dup = lines - np.bincount(line_text[first], minlength=texts)
    return [words.count, chars, symbols, dup, repeated, lines]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = tk.utf8(batch.column(1))
        for i, j in tk.chunks(offsets):
            got = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in got)], ["id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, measurements, failures): bit i of failures is set if rule i fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(tk.lean(_measured), "id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failures: Column = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        failures = failures.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failures", failures).withColumnRenamed("id", id_col)


def passes(policy: str) -> Column:
    """Does a ledger row pass a policy?"""
    return F.col("failures").bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, only_rule): documents of a ledger that fail each rule of a policy, and those that leaving it out would keep.

    One aggregation to at most 2**rules masks, then arithmetic on those.
    """
    mask = bits(POLICIES[policy])
    masks = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bits([name])).cast("long").alias("bit")) for name in POLICIES[policy]))
    each = masks.select("m", "n", F.explode(rules).alias("r")).select("n", "m", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_rule"))


def failing_rules(book: DataFrame) -> DataFrame:
    """(any_failed, all_failed): the rules that some document and that every document fails, as masks."""
    return book.agg(F.bit_or("failures").alias("any_failed"), F.bit_and("failures").alias("all_failed"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .store import documents

    book = ledger(documents(spark, sf_dir))
    return book.select("doc_id", *MEASURES[:5], (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failures")


OP10_SQL = r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
win as (select rid, i, list_slice(ws, i, i + 7) g from w, unnest(range(1, greatest(len(ws) - 6, 1))) u(i) where len(ws) >= 8),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from win) where c > 1),
rep as (select rid, count(distinct i + k) n from again, unnest(range(8)) u(k) group by 1),
l as (select rid, unnest(string_split(t, chr(10))) line from d),
ln as (select rid, count(*) n, count(*) - count(distinct line) dup from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(ln.dup, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(ln.n, 0) n_lines
  from d join w using (rid) left join rep using (rid) left join ln using (rid)),
f as (select *, ((n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (2 * n_symbols > n_words)::int + 8 * (word_chars < 2 * n_words)::int
    + 16 * (word_chars > 20 * n_words)::int + 32 * (2 * n_dup_lines > n_lines and n_dup_lines > 3)::int)::bigint failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 base_failed, failures = 0 kept, failures from f
"""
