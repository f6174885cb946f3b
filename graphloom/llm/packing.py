"""Best-fit packing of documents into sequences of several permitted lengths, chosen jointly.

Lengths are token counts of whole texts. A document longer than the largest
sequence is cut into pieces of that length and a rest. A sequence of length c costs
c * (1 + c / attention) + overhead: work that grows with its length, attention that
grows with the square, and a fixed part. Pieces, longest first, go to the open bin
with the least room that suffices. If there is none, a bin opens: for each permitted
length the pieces still unclaimed that would fill it, longest first, are laid
out, and the length with the least cost for each token so placed is taken; it claims those
pieces, so that bins opened later do not count on them. Finally every bin
shrinks to the smallest permitted length that holds its contents.

Shards of about `SHARD_PIECES` pieces, by hash of id, piece and copy, are packed on
their own, so the work is spread whatever the number of documents and however often
one id repeats, and no bin depends on how the input was split into files.

Null and empty texts have no tokens: one row with a null bin. Repeated rows are
packed as pieces of their own. Rows with a null id are left out. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .store import written
from .textkit import lean

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
#: Tokens at which attention costs as much as all work that grows with the length.
ATTENTION = 8192
SHARD_PIECES = 200_000
PACKED = "doc_id long, piece long, token_start long, n_tokens long, bin string, bin_start long, capacity long"


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return capacity * (1 + capacity / attention) + overhead


def pack(items: list[tuple[int, ...]], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> list[tuple[int, int, int, int]]:
    """(bin, start in bin, capacity of the bin, item) of items (length, *tie breakers); lengths are 1 to the largest capacity."""
    sizes = sorted(capacities)
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], *items[i][1:]))
    costs = {c: cost(c, overhead, attention) for c in sizes}
    left = [0] * (sizes[-1] + 1)  # pieces of each length to come
    for x in items:
        left[x[0]] += 1
    free = left[:]  # those that no open bin claims
    some_free = sum(1 << n for n, k in enumerate(free) if k)
    rooms: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # bins by room, the oldest last
    some = 0  # bit r: a bin has room r
    filled: list[int] = []
    out = []

    def laid(room: int) -> tuple[int, list[tuple[int, int]]]:
        """(tokens, (length, pieces) claimed) of unclaimed pieces, longest first, in a room."""
        total, claims = 0, []
        limit = room
        while fits := some_free & ((1 << (min(room, limit) + 1)) - 1):
            n = fits.bit_length() - 1
            k = min(free[n], room // n)
            claims.append((n, k))
            total += n * k
            room -= n * k
            limit = n - 1
        return total, claims

    for i in order:
        n = items[i][0]
        left[n] -= 1
        if free[n] > left[n]:
            free[n] -= 1
            if not free[n]:
                some_free ^= 1 << n
        fit = some >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            best = None
            for c in sizes:
                if c >= n:
                    total, claims = laid(c - n)
                    price = costs[next(s for s in sizes if s >= n + total)] / (n + total)
                    if best is None or price < best[0]:
                        best = price, c, claims
            _, room, claims = best
            for m, k in claims:
                free[m] -= k
                if not free[m]:
                    some_free ^= 1 << m
            b = len(filled)
            filled.append(0)
        out.append((b, filled[b], i))
        filled[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            some |= 1 << room
    final = [next(c for c in sizes if c >= f) for f in filled]
    return [(b, s, final[b], i) for b, s, i in out]


def _lengths(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = byte_bpe(tokenizer).counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n"])

    return run


def _packed(capacities: tuple[int, ...], overhead: int, attention: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, size, id, n, piece, copy, token_start), sorted by shard."""
        shard, held = None, []

        def flush() -> pa.RecordBatch:
            size, doc, total, piece, copy, start = (np.concatenate([h[i] for h in held]) for i in range(6))
            placed = pack(list(zip(*(x.tolist() for x in (size, doc, total, piece, copy)), strict=True)), capacities, overhead, attention)
            b, at, capacity, item = (np.array(x, dtype=np.int64) for x in zip(*placed, strict=True))
            first = item[at == 0]  # bins in order; each is named after its first piece
            names = np.array([f"{d}-{p}-{n}-{c}" for d, p, n, c in zip(doc[first].tolist(), piece[first].tolist(), total[first].tolist(), copy[first].tolist(), strict=True)], dtype=object)
            columns = [doc[item], piece[item], start[item], size[item], names[b], at, capacity]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split(" ")[0] for c in PACKED.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(7)]
            cuts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1]))).tolist() + [batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if columns[0][a] != shard and held:
                    yield flush()
                    held = []
                shard = columns[0][a]
                held.append([x[a:b].copy() for x in columns[1:]])
        if held:
            yield flush()

    return run


def best_fit(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """PACKED rows, one a piece: the bin, where in the bin it starts and the bin's final capacity."""
    top = max(capacities)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    lengths = written(rows.mapInArrow(lean(_lengths(tokenizer), models=True), "id long, n long"), "lengths")
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0))
    shards = max(1, -(-(lengths.agg(F.sum(last + 1)).first()[0] or 0) // SHARD_PIECES))
    pieces = lengths.groupBy("id", "n").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("token_start", F.col("piece") * top)
    pieces = pieces.withColumn("size", F.least(F.lit(top).cast("long"), F.col("n") - F.col("token_start")))
    shard = F.pmod(F.xxhash64("id", "n", "piece", "copy"), F.lit(shards)).alias("shard")
    full = pieces.where("n > 0").select(shard, "size", "id", "n", "piece", "copy", "token_start").repartition("shard").sortWithinPartitions("shard", "id", "n", "piece", "copy")
    nothing = lengths.where("n = 0").selectExpr("id as doc_id", "0L as piece", "0L as token_start", "0L as n_tokens", "cast(null as string) as bin", "cast(null as long) as bin_start", "cast(null as long) as capacity")
    return full.mapInArrow(lean(_packed(capacities, overhead, attention)), PACKED).union(nothing)


def op7_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .store import documents

    return best_fit(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing of the documents that are left."""
    import public_tokenizers

    return best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))
