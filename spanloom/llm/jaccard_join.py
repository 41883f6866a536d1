"""Near-duplicate classes by an exact Jaccard join on word shingles (operator 4).

Method: universe-partition pigeonhole.  The 64-bit hash of a shingle assigns it to one of m segments, m fixed
for each band of set sizes [2^k, 2^(k+1)).  Two sets that link differ in at most U = (|r| + |s|) / 9 shingles
(for a threshold of 0.8).  A segment with threshold v covers v + 1 of these: if the thresholds' v + 1 add up to
U + 1, then in at least one segment the two sets differ in at most v shingles.  A set is indexed in its own band
and, where a partner may be smaller, in the band below.  Allocation by counted cost:

* shingles are counted first, over all sets, in a table of fixed size.  The least count among a segment's shingles
  bounds how many sets can have the same segment: its cost, which is the same in every set that has it;
* each set gives its U + 1 cheapest filled segments threshold 0 (one signature each) and all others -1.  That loses
  no link: of two sets let r be the one whose dearest chosen segment is cheaper; one of its U + 1 chosen segments is
  equal in the other set, costs the same there and is chosen there too;
* a set with too few filled segments is indexed under all of them and goes on to a second, third and fourth
  partition of its own; only sets that have too few in all of them share a common mark;
* threshold 1, a segment with its one-deletion neighbourhood, has 1 + k signatures for k shingles and covers two, so
  it pays where one segment is enough: sets of 4 to 8 shingles (U = 1).  Above that two cheap segments cost less.

So what many sets share is passed over unless a set has nothing else.  No group of a signature is ever gathered: of the sets
under one signature the one with the most shared signatures is, by an aggregate, the pivot.  Every set is first held against one pivot, the one it shares most
signatures with; sets whose component still differs then against their other pivots; and in groups that still
hold several components the pairs across them are filtered and verified too, so no link that joins components is
lost while a group of thousands of copies costs thousands of comparisons.  Lossless filters on bucket counts
(their sum of differences never exceeds the real difference) come before any text is moved; a text moves once for
its pair with a pivot, a pivot's text once per task.

Links are verified on whole sets of 64-bit shingle hashes: the odds that two shingles of a pair have one hash are
about n^2 / 2^64.  Sets are named by 64 bits of a 128-bit digest: among n different sets about n^2 / 2^65 pairs would be
taken for one.

Defined results: a null or wordless text has no shingles, links with nothing and is its own component.  Rows
with equal sets, repeated rows among them, form one class.  A null doc_id never names a component unless the
component has no other id.  Other columns, whatever their names, do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import PLACE, U, blocks, mix, windows
from .memory import giving_back
from .workspace import added_up, dropped, small, written

WORDS = 5
BUCKETS = 64
#: Bytes of the finer counts: 1024 of two bits, or 512 of four bits for sets of LARGE and more shingles.
FINE = 256
LARGE = 1500
#: Counters of the shingle table, in SLICES parts that are added up apart; its size does not grow with the corpus.
TABLE, SLICES = 1 << 18, 16
#: Sets of a signature whose pairs are looked at together; larger groups meet in pairs of such blocks.
GROUP = 1024
#: Partitions tried for a set with too few filled segments.
TURNS = 4
#: Segments of a band are this share of its largest set size.
SEGMENT_SHARE = 0.375
#: Broadcast at most so many (hash, hash) rows; more are shuffled.
BROADCAST_ROWS = 200_000


def sets_of(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for block in blocks(column):
        shingles, at = windows(*block.words(), words)
        for i in range(block.n):
            if at[i] == at[i + 1]:
                yield shingles[:0]
                continue
            part = np.sort(shingles[at[i] : at[i + 1]])
            yield part[np.concatenate([[True], part[1:] != part[:-1]])]


def reach(size: int, other: int, percent: int) -> int:
    """Most shingles in which linked sets of these sizes differ."""
    return (size + other) * (100 - percent) // (100 + percent)


def _segments(hashes: np.ndarray, cost: np.ndarray, band: int, differ: int) -> list[np.ndarray]:
    """Signatures of the differ + 1 cheapest filled segments; the cost is the first byte of a signature."""
    count, out = U(max(2, int(np.ceil(SEGMENT_SHARE * (2 ** (band + 1) - 1))))), []
    for turn in range(TURNS):
        if turn:
            place = mix(hashes + U(turn) * PLACE[7])
            order = np.argsort(place)
            place, own, price = place[order], hashes[order], cost[order]
        else:
            place, own, price = hashes, hashes, cost
        segment = ((place >> U(32)) * count) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums = np.add.reduceat(mix(own * PLACE[1]), first)
        content = mix(sums + segment[first] * PLACE[2] + np.array([band * TURNS + turn], dtype=U) * PLACE[3])
        content = (np.minimum.reduceat(price, first).astype(U) << U(56)) | (content >> U(8))
        if len(first) > differ:
            out.append(np.partition(content, differ)[: differ + 1])
            return out
        out.append(content)
    out.append(mix(np.array([band], dtype=U) * PLACE[3] + PLACE[4]))
    return out


def signatures(hashes: np.ndarray, costs: np.ndarray, percent: int = 80) -> np.ndarray:
    """The signatures under which a set is indexed, given the TABLE of costs; linked different sets share one."""
    size, out = len(hashes), []
    most = size * 100 // percent
    tiny = next(n for n in range(1, 10_000) if reach(n, n * 100 // percent, percent) > 1)  # from here on U is over 1
    if size < tiny or -(-size * percent // 100) < tiny:
        each = mix(hashes * PLACE[5])
        whole = each.sum(dtype=U, keepdims=True)
        out.append(mix(np.concatenate([whole, whole - each]) + PLACE[6]))
    cost = costs[_counters(hashes)]
    band = size.bit_length() - 1
    if size >= tiny:
        out += _segments(hashes, cost, band, reach(size, most, percent))
    low = 2**band - 1
    while low >= -(-size * percent // 100) and low >= tiny:
        out += _segments(hashes, cost, low.bit_length() - 1, reach(size, low, percent))
        low = (low - 1) // 2
    return np.concatenate(out)


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + PLACE[8]) % U(TABLE)).astype(np.int64)


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, on a logarithmic scale."""
    return np.minimum(np.round(4 * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _fine(hashes: np.ndarray) -> bytes:
    if len(hashes) < LARGE:
        c = np.minimum(np.bincount((hashes >> U(54)).astype(np.int64), minlength=1024), 3).astype(np.uint8).reshape(4, FINE)
        return (c[0] | c[1] << 2 | c[2] << 4 | c[3] << 6).tobytes()
    c = np.minimum(np.bincount((hashes >> U(55)).astype(np.int64), minlength=512), 15).astype(np.uint8).reshape(2, FINE)
    return (c[0] | c[1] << 4).tobytes()


class _FineCounts:
    """The finer counts of some sets; saturated counts still never differ by more than the sets do."""

    def __init__(self, packed: list[bytes], size: np.ndarray):
        data = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, FINE)
        self.large = size >= LARGE
        self.two = np.concatenate([data >> k & 3 for k in (0, 2, 4, 6)], axis=1).astype(np.int8)
        self.four = np.concatenate([data & 15, data >> 4], axis=1).astype(np.int8)

    def allow(self, both: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        ok = np.ones(len(i), dtype=bool)
        for table, kind in ((self.two, False), (self.four, True)):
            mine = np.flatnonzero((self.large[i] == kind) & (self.large[j] == kind))
            ok[mine] = _near(table, both[mine], i[mine], j[mine], percent)
        return ok


def _near(counts: np.ndarray, both: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    gap = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 12):
        part = slice(at, at + (1 << 12))
        gap[part] = np.abs(counts[i[part]] - counts[j[part]]).sum(1, dtype=np.int64)
    return gap * (100 + percent) <= both * (100 - percent)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every document, and at the end the task's counts of shingles in slices."""
    table, kind = np.zeros(TABLE, dtype=np.int64), None
    names = ["doc_id", "text_key", "node", "n_shingles", "counts", "fine", "slice", "table"]
    for batch in batches:
        node, size, counts, fine, seen = [], [], [], [], []
        kind = batch.column("doc_id").type
        for hashes in sets_of(batch.column("text")):
            size.append(len(hashes))
            node.append(_node(_key(hashes)) if len(hashes) else None)
            counts.append(np.minimum(np.bincount((hashes >> U(58)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
            fine.append(_fine(hashes))
            seen.append(hashes)
            if len(seen) == 1000:
                table += np.bincount(_counters(np.concatenate(seen)), minlength=TABLE)
                seen = []
        if seen:
            table += np.bincount(_counters(np.concatenate(seen)), minlength=TABLE)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    if kind is not None:
        parts = [_narrow(x) for x in table.reshape(SLICES, -1)]
        none = [pa.nulls(SLICES, t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)


def _narrow(counts: np.ndarray) -> bytes:
    """The counts in as few bytes as the largest needs, that number first."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(TABLE // SLICES, dtype=np.int64)
    for x in table.column("table"):
        data = x.as_py()
        total += np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "table": pa.array([_narrow(total)], pa.binary())})


def _costs(described: DataFrame) -> np.ndarray:
    """The cost of every counter; SLICES rows of fixed size go to the driver."""
    parts = added_up(described.where("slice is not null").select("slice", "table"), _added, "slice int, table binary").collect()
    if not parts:
        return np.zeros(TABLE, dtype=np.uint8)
    return costs_of(np.concatenate([np.frombuffer(r["table"], dtype=f"<u{r['table'][0]}", offset=1).astype(float) for r in sorted(parts, key=lambda r: r["slice"])]))


def _index(costs: np.ndarray, percent: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that follow each other in a task are indexed once
        for batch in batches:
            sig, node = [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for k, hashes in enumerate(sets_of(batch.column("text")), 1):
                own = _node(_key(hashes))
                if len(hashes) and own not in seen:
                    seen.add(own)
                    part = signatures(hashes, costs, percent)
                    sig.append(part)
                    node.append(np.full(len(part), own, dtype=np.int64))
                if sig and (k % 2000 == 0 or k == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], ["sig", "node"])
                    sig, node = [], []

    return index


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which every group of the sorted input is whole; groups are bounded by GROUP."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if held and (cut or held[-1].column("group")[-1].as_py() != group[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, once each, of signatures that several nodes have; one row is held back, never a group."""
    sig, node, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and if it goes with the one before
    for batch in batches:
        sig, node = np.concatenate([sig, batch.column("sig").to_numpy()]), np.concatenate([node, batch.column("node").to_numpy()])
        if not len(sig):
            continue
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        same = sig[1:] == sig[:-1]
        keep = same | np.concatenate([[before], same[:-1]]) if len(same) else np.zeros(0, dtype=bool)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[:-1][keep]), pa.array(node[:-1][keep])], ["sig", "node"])
        before = bool(same[-1]) if len(same) else before
        sig, node = sig[-1:], node[-1:]
    if before:
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])


def _pairs(percent: int):
    """Pairs across the components of a group that the bucket counts allow."""

    def allowed(size, counts, fine, i, j):
        ok = np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent
        i, j = i[ok], j[ok]
        ok = _near(counts, size[i] + size[j], i, j, percent)
        i, j = i[ok], j[ok]
        ok = fine.allow(size[i] + size[j], i, j, percent)
        return i[ok], j[ok]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def told():
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["node", "pivot"])

        for table in _runs(batches):
            group, node, size, block = (table.column(c).to_numpy() for c in ("group", "node", "n_shingles", "block"))
            counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            last = np.append(first[1:], len(group))
            fine = _FineCounts(table.column("fine").to_pylist(), size)
            for i, j in _across(first, last, table.column("root").to_numpy(), block):
                i, j = allowed(size, counts, fine, i, j)
                if len(i):
                    both = np.stack([node[i], node[j]], axis=1)
                    both.sort(axis=1)
                    found.append(np.unique(both, axis=0))
                    held += len(found[-1])
                if held > 500_000:
                    yield told()
                    found, held = [], 0
        if found:
            yield told()

    return pairs


def _across(first: np.ndarray, last: np.ndarray, root: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each group whose roots differ, of a group of two blocks those between them; some at a time."""
    ii, jj, held = [], [], 0
    for a, z in zip(first, last, strict=True):
        two = (block[a:z] != block[a]).any()
        for x in range(a + 1, z):
            other = root[a:x] != root[x]
            j = a + np.flatnonzero(other & (block[a:x] != block[x]) if two else other)
            ii.append(np.full(len(j), x))
            jj.append(j)
            held += len(j)
            if held > 200_000:
                yield np.concatenate(ii), np.concatenate(jj)
                ii, jj, held = [], [], 0
    if held:
        yield np.concatenate(ii), np.concatenate(jj)


def _verified(percent: int):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(sets_of(batch.column("text")), sets_of(batch.column("other")), strict=True):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["node", "pivot"]).filter(pa.array(keep, pa.bool_()))

    return verified


def _plausible(percent: int):
    """Pairs, with both sets' sizes and finer counts, that these allow."""

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = np.concatenate([batch.column("n0").to_numpy(), batch.column("n1").to_numpy()])
            fine = _FineCounts(batch.column("f0").to_pylist() + batch.column("f1").to_pylist(), size)
            i = np.arange(n)
            near = np.minimum(size[:n], size[n:]) * 100 >= np.maximum(size[:n], size[n:]) * percent
            yield batch.select(["node", "pivot"]).filter(pa.array(near & fine.allow(size[:n] + size[n:], i, i + n, percent)))

    return plausible


_PAIR = "node long, pivot long"


def _links(pairs: DataFrame, about: DataFrame, members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the `pairs` (``node, pivot``) that link, verified on the shingle sets of whole texts."""
    ends = [about.select(F.col("node").alias(e), F.col("n_shingles").alias(f"n{k}"), F.col("fine").alias(f"f{k}")) for k, e in enumerate(("node", "pivot"))]
    near = pairs.join(ends[0], "node").join(ends[1], "pivot").select("node", "pivot", "n0", "n1", "f0", "f1").mapInArrow(_plausible(percent), _PAIR)
    pairs = written(near, "plausible")
    wanted = pairs.select(F.explode(F.array("node", "pivot")).alias("node")).distinct()
    keys = written(members.join(wanted, "node").groupBy("node").agg(F.min("text_key").alias("text_key")), "keys")
    texts = written(docs.join(small(keys, BROADCAST_ROWS), "text_key").select("node", "text").dropDuplicates(["node"]), "texts")
    # the members' texts first: a pivot's text is then joined where its pairs are, and not shuffled with each of them
    both = pairs.join(texts, "node").join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("other")), "pivot")
    out = written(both.select("node", "pivot", "text", "other").mapInArrow(giving_back(_verified(percent)), _PAIR), "links")
    dropped(texts, keys, pairs)
    return out


def _roots(*links: DataFrame) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.unionAll(more)
    return written(components(every.select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "roots")


def _rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """With the component of a column's sets; a set without links is its own."""
    return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def jaccard_classes(documents: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of `documents` (``doc_id, text``)."""
    docs = documents.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    described = written(docs.mapInArrow(giving_back(_describe), f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, node long, n_shingles long, counts binary, fine binary, slice int, table binary"), "members")
    members = described.where("slice is null").drop("slice", "table")
    sigs = docs.select("text").mapInArrow(giving_back(_index(_costs(described), percent)), "sig long, node long")
    groups = written(sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(giving_back(_shared), "sig long, node long"), "groups")
    about = members.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"), F.first("fine").alias("fine"))
    about = written(about.join(groups.select("node").distinct(), "node", "left_semi"), "about")
    # the pivot of a signature, by aggregates that add up before they shuffle
    laid = written(groups.join(groups.groupBy("node").agg(F.count("*").alias("shared")), "node"), "laid")
    lead = laid.groupBy("sig").agg(F.max_by("node", F.struct("shared", "node")).alias("pivot"))
    votes = written(groups.join(lead, "sig").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("votes")), "votes")
    dropped(laid)
    best = written(votes.groupBy("node").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("pivot")).select("node", "pivot"), "best")
    one = _links(best, about, members, docs, percent)
    roots = _roots(one)
    rest = _rooted(_rooted(votes, roots, "node", "r0"), roots, "pivot", "r1").where("r0 <> r1").select("node", "pivot").join(best, ["node", "pivot"], "left_anti")
    rest = written(rest, "rest")
    two = _links(rest, about, members, docs, percent)
    dropped(roots)
    roots = _roots(one, two)
    rooted = written(_rooted(groups, roots, "node", "root"), "rooted")
    mixed = rooted.groupBy("sig").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1 and n > 2").select("sig", F.ceil(F.col("n") / GROUP).alias("blocks"))
    # a large group meets in pairs of blocks, so none is ever whole in one task
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = rooted.join(mixed, "sig").withColumn("block", block).select("node", "root", "block", "blocks", "sig", F.explode(meets).alias("m"))
    dealt = dealt.select("node", "root", "block", F.when(F.col("blocks") == 1, F.col("sig")).otherwise(F.xxhash64("sig", "m.i", "m.j")).alias("group"))
    laid = dealt.join(about, "node").repartition("group").sortWithinPartitions("group", "node")
    tried = votes.select(F.least("node", "pivot").alias("node"), F.greatest("node", "pivot").alias("pivot"))
    across = written(laid.mapInArrow(giving_back(_pairs(percent)), _PAIR).distinct().join(tried, ["node", "pivot"], "left_anti"), "across")
    three = _links(across, about, members, docs, percent)
    dropped(groups, rooted, roots, about, votes, best, rest, across)
    roots = _roots(one, two, three)
    dropped(one, two, three)
    named = written(_rooted(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), roots, "node", "root"), "named")
    dropped(roots)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    return members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
