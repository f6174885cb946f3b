"""N-gram Jaccard join by T-occurrence search with DivideSkip.

The rows of a document are the hashes of its distinct word shingles. Documents
with equal sets fall into one class and only classes are compared.

1. *Routing.* Classes that can link must meet in a task without pairs being
   emitted. With J >= p/100 the sets of sizes a <= b differ in at most
   (a+b)(100-p)/(100+p) shingles. Hash space is cut into more parts than that,
   so linked sets agree exactly in some non-empty part: the hash of a part's
   content is a routing key (about one per six shingles, for two size bands). A
   set with more empty parts than were allowed for also gives its p-prefix as
   keys, so no link is lost. The members of a key are compared by odd sketches
   (bit h mod m flips for each shingle: two sketches differ in no more bits than
   the sets in shingles, so this too loses no link) and a forest of those that may
   link is kept, never pairs; a key with more than `COMPARED_KEY` members is compared
   in pairs of blocks, one with more than `LARGE_KEY` keeps a star.
   Classes that are connected by these edges form a *neighbourhood*.
2. *Search.* Neighbourhoods go to tasks with their whole sets, large ones as
   pairs of blocks. A task builds inverted lists (shingle -> sets). For each set,
   as the larger of a pair, T = ceil(p/100 * size) lists must hold a partner.
   DivideSkip sets the L longest lists aside, merges the short ones, keeps sets
   found T-L times, then probes the long lists by binary search and keeps those
   whose exact overlap fits the pair's own bound. Sets around one centre are
   linked to it first, and a list holds one posting for each component so far, so
   a large group of near copies costs one posting a list, not one a member.
3. *Components* of the links, by star contraction.

Results for odd input: null text, empty text and text without words give 0
shingles and a component of the document alone; repeated rows each give a row.
Where an id repeats with other texts, each row is a set of its own and has its
size; the id is one document, linked through any of its rows, and all its rows
with words share one component. Rows with a null id keep their set size and have
a null component; an empty table gives an empty result. Other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components, forest
from .store import written
from .suffix_dedup import sorted_groups

#: Shingles that a search holds at once; larger neighbourhoods are searched as pairs of blocks of this many.
BLOCK_SHINGLES = 500_000


def bands(limit: int, percent: int) -> list[int]:
    """Lower ends of size bands so wide that a partner of a set is in its own or the next."""
    out = [1]
    while out[-1] <= limit:
        out.append(out[-1] * 100 // percent + 1)
    return out


def set_digest(own: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    if not len(own):
        return 0
    total = tk.mix(own + tk.odd(5)).sum(keepdims=True, dtype=np.uint64)
    return int(tk.signed(tk.mix(total + tk.odd(6, len(own))))[0])


def routing_keys(own: np.ndarray, percent: int, edges: np.ndarray) -> np.ndarray:
    """Keys of one sorted set; sets with Jaccard of percent/100 or more that differ share at least one."""
    n = len(own)
    at = int(np.searchsorted(edges, n, "right")) - 1
    keys = []
    for band in (at, at + 1):
        low, high = int(edges[band]), int(edges[band + 1]) - 1
        if band > at and n * 100 < percent * low:
            continue
        differ = 2 * high * (100 - percent) // (100 + percent)
        if differ == 0:
            continue  # only equal sets could link
        spare = 2 + differ // 24
        parts = differ + 1 + spare
        part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        content = np.add.reduceat(tk.mix(own ^ tk.odd(7)), first)
        keys.append(tk.mix(content + part[first] * tk.odd(8) + tk.odd(9, band)))
        if parts - len(first) > spare:
            keys.append(tk.mix(own[: n - -(-percent * n // 100) + 1] + tk.odd(10, band)))
    return np.concatenate(keys) if keys else own[:0]


def odd_sketch(own: np.ndarray) -> bytes:
    """Parity of the shingles on each of m bits, m a power of two of about the set's size."""
    m = min(max(64, 1 << (len(own) - 1).bit_length()), 1 << 14)
    bits = np.bincount((tk.mix(own + tk.odd(12)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _profile(k: int, percent: int, want_keys: bool):
    """Rows (id, text, row) to (id, row, size, digest, sketch) of their sets, or to (key, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bands(1 << 34, percent), dtype=np.int64)
        seen: set[int] = set()
        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(1))
            data = tk.lower_ascii(data)
            ids = batch.column(0)
            for i, j in tk.chunks(offsets):
                sets = tk.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                digests = [set_digest(x) for x in sets]
                if not want_keys:
                    sketches = pa.array([odd_sketch(x) if len(x) else None for x in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.int64()), sketches], ["id", "row", "n", "digest", "sketch"])
                    continue
                keys, owner = [], []
                for x, d in zip(sets, digests, strict=True):
                    if len(x) and d not in seen:  # copies within the task add nothing
                        seen.add(d)
                        keys.append(routing_keys(x, percent, edges))
                        owner.append(np.full(len(keys[-1]), d, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(tk.signed(np.concatenate(keys))), pa.array(np.concatenate(owner))], ["key", "digest"])
                if len(seen) > 1_000_000:
                    seen.clear()

    return run


#: Members of a key that are compared in one task; more are dealt to blocks of half as many, and each pair of blocks is compared.
COMPARED_KEY = 50_000
#: Members of a key beyond which they are connected without being compared.
LARGE_KEY = 200_000


def block_pairs(size: int) -> list[tuple[int, int, int]]:
    """(blocks, i, j): the pairs of blocks in which all pairs of so many members meet."""
    if size <= COMPARED_KEY:
        return [(1, 0, 0)]
    blocks = -(-size // (COMPARED_KEY // 2))
    return [(blocks, i, j) for j in range(blocks) for i in range(j)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, digest) to (group, member, star): the members of each key that has several.

    Keys with the same members give one group. star: member is connected to the class that group names.
    """
    seen: set[int] = set()
    head = None  # (key, digest) of a key that a cut left open
    for table, cut in sorted_groups(batches, max(100_000, LARGE_KEY)):
        key, digest = (table.column(i).to_numpy() for i in range(2))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
        key, digest = key[new], digest[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        name = tk.signed(tk.mix(np.add.reduceat(tk.mix(digest.view(np.uint64) + tk.odd(13)), first) + size.astype(np.uint64)))
        lead = digest[first].copy()
        star = size > LARGE_KEY
        if head is not None and key[0] == head[0]:
            star[0], lead[0] = True, head[1]
        if cut:
            star[-1] = True
        head = (key[-1], lead[-1]) if cut else None
        keep = (size > 1) | star
        _, where = np.unique(name, return_index=True)
        once = np.zeros(len(name), dtype=bool)
        once[where] = True
        keep &= once | star
        for i in np.flatnonzero(keep & ~star):
            if int(name[i]) in seen:
                keep[i] = False
            else:
                seen.add(int(name[i]))
        if len(seen) > 1_000_000:
            seen.clear()
        several = keep & ~star & (size > COMPARED_KEY)
        rows = np.repeat(keep & ~several, size)
        group = np.repeat(np.where(star, lead, name), size)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(digest[rows]), pa.array(np.repeat(star, size)[rows])], ["group", "member", "star"])
        for g in np.flatnonzero(several):
            own = digest[first[g] : first[g] + size[g]]
            for blocks, i, j in block_pairs(len(own)):
                both = np.concatenate((own[i::blocks], own[j::blocks]))
                pair = tk.signed(tk.mix(name[g : g + 1].view(np.uint64) + tk.odd(14, i * blocks + j + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pair, len(both))), pa.array(both), pa.array(np.zeros(len(both), dtype=bool))], ["group", "member", "star"])


def may_link(bits: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the rows whose sketches do not rule out a link: each row looks only for those that no other has found yet."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rest, bits_left, n_left = np.arange(len(n)), bits, n
    todo: list[int] = []
    while len(rest):
        if not todo:
            todo.append(int(rest[-1]))
            rest, bits_left, n_left = rest[:-1], bits_left[:-1], n_left[:-1]
            continue
        r = todo.pop()
        apart = np.bitwise_count(bits_left ^ bits[r]).sum(axis=1, dtype=np.int64)
        near = apart <= (n[r] + n_left) * (100 - percent) // (100 + percent)
        if near.any():
            new = rest[near]
            left.append(np.full(len(new), r))
            right.append(new)
            todo += new.tolist()
            rest, bits_left, n_left = rest[~near], bits_left[~near], n_left[~near]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, member, n, sketch) sorted by group to a forest of the members that may link."""
        for table, _ in sorted_groups(batches, max(20_000, COMPARED_KEY // 2)):
            group, member, n = (table.column(i).to_numpy() for i in range(3))
            sketches = [np.frombuffer(x, np.uint64) for x in table.column(3).to_pylist()]
            width = np.array([len(x) for x in sketches])
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.append(first[1:], len(group))
            found: list[np.ndarray] = []
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                if b - a < 2:
                    continue
                w = int(width[a:b].min())
                bits = np.stack([x if len(x) == w else np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) for x in sketches[a:b]])
                x, y = may_link(bits, n[a:b], percent)
                if len(x):
                    found.append(np.stack((member[a + x], member[a + y])))
            if found:
                x, y = forest(*np.concatenate(found, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


#: A group with so many links to one set is linked by comparing every set with that one, before lists are merged.
PIVOT_LINKS = 8
MOST_PIVOTS = 64
#: Postings that are merged for a set before lists are set aside.
MERGE_POSTINGS = 30_000


def search(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """T-occurrence search: pairs of positions that connect all linked sets (a spanning forest of the links).

    side: if given, links inside one side need not be found.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    side = side[order] if side is not None else None
    if not len(sets):
        return []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    values, lists = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    length = np.bincount(lists, minlength=len(values))
    root = np.arange(len(sets))
    found: list[tuple[int, int]] = []
    mark = np.zeros(len(values), dtype=bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def link(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((int(order[x]), int(order[y])))

    def bound(n: int, others: np.ndarray) -> np.ndarray:
        return -(-percent * (n + others) // (100 + percent))

    # groups around one set: every overlap with it in one pass
    share = np.add.reduceat(length[lists] - 1, starts[:-1]) / sizes
    share[share < PIVOT_LINKS / 2] = 0
    for _ in range(MOST_PIVOTS):
        p = int(share.argmax())
        if share[p] == 0:
            break
        share[p] = 0
        mark[lists[starts[p] : starts[p + 1]]] = True
        overlap = np.add.reduceat(mark[lists], starts[:-1], dtype=np.int64)
        mark[lists[starts[p] : starts[p + 1]]] = False
        near = np.flatnonzero(overlap >= bound(int(sizes[p]), sizes))
        for x in near:
            link(p, int(x))
        share[near] = 0
        if len(near) < PIVOT_LINKS:
            share[share <= share.max() / 2] = 0  # few such groups are left

    # lists of components: one posting stands for all members of a component
    top = np.array([find(x) for x in range(len(sets))])
    members = np.argsort(top, kind="stable")
    first_member = np.searchsorted(top[members], np.arange(len(sets) + 1))
    pairs = np.unique(lists.astype(np.int64) * len(sets) + top[owner])
    in_list, posting = pairs // len(sets), pairs % len(sets)
    length = np.bincount(in_list, minlength=len(values))
    first = np.concatenate(([0], np.cumsum(length)))

    for q in range(len(sets)):
        n = int(sizes[q])
        need = -(-percent * n // 100)
        own = lists[starts[q] : starts[q + 1]]
        shared = own[length[own] > 1]
        alone = len(own) - len(shared)  # lists of this component only
        if n - alone < need:
            continue
        shared = shared[np.argsort(length[shared], kind="stable")]
        # DivideSkip: lists are set aside, longest first, until merging the others is cheap
        aside = min(need - 1, len(shared), int((np.cumsum(length[shared]) > MERGE_POSTINGS).sum()))
        short, long = shared[: len(shared) - aside], shared[len(shared) - aside :]
        span = length[short]
        index = np.repeat(first[short] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        counts = np.bincount(posting[index], minlength=len(sets))
        counts[top[q]] = 0
        some = np.flatnonzero(counts >= max(1, need - aside))
        counts = counts[some]
        for at in range(0, len(long), 8):  # probe the lists set aside, all candidates at once
            if not len(some):
                break
            keys = long[at : at + 8, None] * len(sets) + some
            place = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
            counts = counts + (pairs[place] == keys).sum(axis=0)
            open_ = counts + max(0, len(long) - at - 8) >= need
            some, counts = some[open_], counts[open_]
        # of a component of one set the count is the overlap itself
        single = first_member[some + 1] - first_member[some] == 1
        one, got = some[single], counts[single]
        linked = (one < q) & (got >= bound(n, sizes[one]))
        if side is not None:
            linked &= side[one] != side[q]
        for x in one[linked].tolist():
            link(q, x)
        for c in some[~single].tolist():
            if find(c) == find(q):
                continue
            those = members[first_member[c] : first_member[c + 1]]
            those = those[(those < q) & (sizes[those] >= need)]
            if side is not None:
                those = those[side[those] != side[q]]
            if len(those) == 0:
                continue
            mark[own] = True
            for x in those[::-1].tolist():
                if int(mark[lists[starts[x] : starts[x + 1]]].sum()) >= -(-percent * (n + int(sizes[x])) // (100 + percent)):
                    link(q, x)
                    break
            mark[own] = False
    return found


def _searcher(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (place, crossed, side, node, digest, text) sorted by place and digest; places never span a search."""
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        last = None
        sides: list[int] = []
        place, crossed, size = None, False, 0

        def flush():
            side = np.array(sides) if crossed else None
            pairs = search(sets, percent, side)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in pairs], pa.int64()), pa.array([nodes[y] for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            data, offsets, _ = tk.utf8(batch.column(5))
            data = tk.lower_ascii(data)
            places, cross, side, node, digest = (batch.column(i).to_pylist() for i in range(5))
            for i, j in tk.chunks(offsets):
                got = tk.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                for r, own in zip(range(i, j), got, strict=True):
                    if place is not None and places[r] != place and (crossed or cross[r] or size >= BLOCK_SHINGLES):
                        yield flush()
                        sets, nodes, sides, size = [], [], [], 0
                    place, crossed = places[r], cross[r]
                    if (places[r], digest[r]) == last or set_digest(own) != digest[r]:
                        continue  # a copy of the row
                    last = places[r], digest[r]
                    sets.append(own)
                    nodes.append(node[r])
                    sides.append(side[r])
                    size += len(own)
        if sets:
            yield flush()

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, set_digest): components under Jaccard >= percent/100 of word shingles."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    profile = written(source.mapInArrow(tk.lean(_profile(words, percent, False)), "id long, row long, n long, digest long, sketch binary"), "profile")
    keys = source.where("id is not null").mapInArrow(tk.lean(_profile(words, percent, True)), "key long, digest long")
    groups = written(keys.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(tk.lean(_groups), "group long, member long, star boolean"), "groups")
    # a class is read again from the row with its smallest id: row tells it from others of that id
    classes = profile.where("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = classes.select("digest", F.col("first.id").alias("node"), F.col("first.row").alias("row"), "n", "sketch")
    # joins that move texts or grow with the input are never broadcast
    compared = groups.where("not star").select("group", "member").distinct().join(classes.hint("merge"), F.col("member") == F.col("digest")).select("group", "member", "n", "sketch")
    alike = compared.repartition("group").sortWithinPartitions("group", "member").mapInArrow(tk.lean(_alike(percent)), "a long, b long")
    near = components(alike.union(groups.where("star").select("group", "member")), shrink=False)
    classes = classes.drop("sketch")
    members = written(classes.join(near.withColumnRenamed("node", "digest").hint("merge"), "digest").select("digest", "node", "row", "n", F.col("component").alias("area")), "areas")
    sizes = members.groupBy("area").agg(F.sum("n").alias("total"))
    blocked = members.join(sizes.hint("merge"), "area").withColumn("blocks", F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)).cast("int"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    # a block meets itself and every other block of its area once; small areas are one block
    placed = blocked.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    placed = placed.select(
        F.col("node").alias("id"), "row", "node", "digest",
        F.xxhash64("area", F.least("own", "other"), F.greatest("own", "other")).alias("place"),
        (F.col("own") != F.col("other")).alias("crossed"), F.col("own").alias("side"),
    )
    rows = source.join(placed.hint("merge"), ["id", "row"]).select("place", "crossed", "side", "node", "digest", "text")
    links = rows.repartition("place").sortWithinPartitions("place", "digest").mapInArrow(tk.lean(_searcher(words, percent)), "a long, b long")
    # an id with several sets links the classes of all of them
    several = profile.where("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most").select("id")
    own_sets = profile.where("n > 0").select("id", "digest").join(several.hint("merge"), "id").distinct().join(classes.select("digest", "node").hint("merge"), "digest").select(F.col("id").alias("a"), F.col("node").alias("b"))
    linked = components(links.union(own_sets), shrink=False)
    label = classes.join(linked.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = profile.join(label.withColumnRenamed("digest", "d").hint("merge"), (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("digest").alias("set_digest"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .store import documents

    return jaccard_components(documents(spark, sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
with recursive d as (select row_number() over () r, doc_id, text from documents),
w as (select r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from d where text is not null),
s as (select distinct r, case when len(ws) < 4 then ws else list_slice(ws, i, i + 3) end g from w, unnest(range(1, greatest(len(ws) - 2, 2))) u(i) where len(ws) > 0),
n as (select r, count(*) n from s group by 1),
c as (select a.r x, b.r y, count(*) both_ from s a join s b on a.g = b.g and a.r < b.r group by 1, 2),
k as (select distinct dx.doc_id x, dy.doc_id y from c join n p on p.r = x join n q on q.r = y join d dx on dx.r = x join d dy on dy.r = y where 100 * both_ >= 85 * (p.n + q.n - both_) and dx.doc_id <> dy.doc_id),
e as (select x, y from k union select y, x from k),
t(doc_id, root) as (select distinct doc_id, doc_id from n join d using (r) union select e.y, t.root from t join e on e.x = t.doc_id),
m as (select doc_id, min(root) root from t group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, case when n.n is null then d.doc_id else m.root end component_id
from d left join n using (r) left join m on m.doc_id = d.doc_id
"""


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest id stays; the rows of an id stay or go together."""
    parts = jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    gone = parts.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
