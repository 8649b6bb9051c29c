"""Near duplicates through MinHash: signatures, candidates, exact verification.

Items are distinct contents, named by a 128-bit digest (node, low).  An item has a signature, one
smallest hash for each of K hash functions, and keys: the first values of each of K's parts.  Items with
a key in common form a run.  In a forest the values after a key's are kept too, a byte each, and a
run, in their order, is a sorted prefix trie: the items that share a longer prefix lie together.

A run is walked in memory: an item not covered becomes a pivot, is compared by signature with the
items left, ties those at least `low` alike, and covers those at least `cover` alike.  Two similar items
then are joined through a pivot near one of them, so components of ties hold the pairs that share a
key.  A tie leaves the walk only where it joins what wasn't joined before, so a run of g items
gives fewer than g.  Long runs are walked in parts, very frequent keys are salted first; the parts' pivots
meet in a second walk, and what a group of pivots still has in several parts is tied as it is.

Within a component all pairs are verified on exact sets of shingles.  Components up to `BLOCK`
items are one task's; larger ones are cut into blocks and every pair of blocks is verified, so no task
holds more than two blocks, and no pairs leave a task: only each item's links, as a sum, and
a star for each cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import forget_shuffles, in_files, mix64, sieved, small_or_shuffled, written
from tilewright.llm.union_find import components, roots

#: Stored texts to the shingles of all, one text after another, and where each begins.
Shingles = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
PART = 1024
BLOCK = 256
#: Keys are salted that are thought to have more items than this, as seen in about SEEN of them.
HOT = 1_000_000
SEEN = 50_000
#: Of keys that are packed: items of a block, keys of a shard, bits of a sketch, how many of them two items must have alike,
#: and up to what length runs are judged by sketches. A pair alike by 0.8 has 28.8 bits alike, and misses 22 once in 5,700 (in
#: each run it is in, about four); of pairs that meet by chance, alike by 0.1, one in twelve passes.
PACK, SHARD, SKETCH, ALIKE, JUDGED = 1 << 17, 1 << 19, 32, 22, 64
_CHUNK = 65_536


class Hashes:
    """K hash functions; signatures of many sets at once."""

    def __init__(self, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)

    def signatures(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """flat: all sets' 64-bit shingles, none empty; starts: where each begins.  Rows: sets."""
        out = np.empty((len(starts), len(self.a)), np.uint32)
        ends = np.r_[starts[1:], len(flat)]
        lo = 0
        while lo < len(starts):
            # A few sets at a time, so that their shingles stay in the processor's cache.
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _CHUNK, "right")))
            part, at = flat[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
            x = (part >> np.uint64(32)).astype(np.uint32)
            h, some = np.empty_like(x), np.empty((len(self.a), hi - lo), np.uint32)
            for row, a, b in zip(some, self.a, self.b, strict=True):
                # A permutation of 32 bits; shingles are well mixed before.
                np.bitwise_xor(x, b, out=h)
                np.multiply(h, a, out=h)
                np.minimum.reduceat(h, at, out=row)
            out[lo:hi] = some.T
            lo = hi
        return out


def as_bytes(signatures: np.ndarray) -> np.ndarray:
    """A byte for each value.  Smallest hashes of many are all small, so every bit of a value takes part."""
    return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def recall(threshold: float, trees: int, depth: int) -> float:
    """How likely a pair as alike as the threshold has a prefix of this length in common in some tree."""
    return 1 - math.pow(1 - threshold**depth, trees)


def shortest_prefix(threshold: float, trees: int, target: float, longest: int) -> int:
    """The longest prefix at which even a pair just at the threshold is met with the target probability."""
    depth = longest
    while depth > 1 and recall(threshold, trees, depth) < target:
        depth -= 1
    return depth


def prefix_keys(signatures: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A 64-bit key for each tree: its number and the first `depth` values of its part of the signature.

    The lowest bit is 0: it is for salted keys.
    """
    n, k = signatures.shape
    part = k // trees
    out = np.empty((n, trees), np.uint64)
    for t in range(trees):
        key = np.full(n, t + 1, np.uint64)
        for d in range(depth):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, t * part + d])
        out[:, t] = key
    return (out & ~np.uint64(1)).view(np.int64)


def after_prefix(signatures: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each tree the values after the first `depth` of its part, a byte each, as a number that sorts as they do."""
    n, k = signatures.shape
    part = k // trees
    short = as_bytes(signatures)
    out = np.zeros((n, trees), np.int64)
    for t in range(trees):
        for d in range(depth, part):
            out[:, t] = out[:, t] << 8 | short[:, t * part + d]
    return out


class Forest:
    """A forest's shape: trees of prefixes from `shortest` to `longest`, and the recall to reach."""

    def __init__(self, threshold: float, trees: int, shortest: int, longest: int, target: float):
        self.threshold, self.trees, self.shortest, self.longest, self.target = threshold, trees, shortest, longest, target

    def matched(self, sigs: np.ndarray) -> int:
        """The prefix length for the items of one sorted trie.

        Starting from the longest, the matched prefix is shortened until the pairs as alike as those
        seen here are met with the target probability over all trees.  Seen are neighbours in the
        trie; a pair alike by s shares this trie with probability s ** shortest, so it stands for as many more.
        """
        seen = [np.zeros(0)]
        for apart in range(1, min(5, len(sigs))):
            alike = (sigs[apart:] == sigs[:-apart]).mean(axis=1)
            # Bytes of different values are equal once in 256 times.
            seen.append(np.maximum((alike - 1 / 256) / (1 - 1 / 256), 0))
        s = np.concatenate(seen)
        s = s[s >= self.threshold]
        if not len(s):
            return self.shortest
        weight = s**-self.shortest
        depth = self.longest
        while depth > self.shortest and weight @ (1 - (1 - s**depth) ** self.trees) < self.target * weight.sum():
            depth -= 1
        return depth

    def subtries(self, rest: np.ndarray, depth: int) -> np.ndarray:
        """Where groups with a prefix of this length begin in a run in order, and its end."""
        prefix = rest >> (8 * (self.longest - depth))
        return np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1], True])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key[, rest], node) in order of key and rest to (key, part, rest, node) of the distinct nodes of runs with two or more.

    Nodes are put in order within a batch; one that comes again in a run's next batch counts again.
    """
    last: tuple[int, int, int, int] | None = None
    for batch in batches:
        key, node = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not len(key):
            continue
        rest = batch["rest"].to_numpy() if "rest" in batch.schema.names else np.zeros(len(key), np.int64)
        same = key[1:] == key[:-1]
        again = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        node, rest = node.copy(), rest.copy()
        order = again[np.lexsort((node[again], rest[again], key[again]))]
        node[again], rest[again] = node[order], rest[order]
        new_key = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
        fresh = new_key | np.r_[last is None or node[0] != last[2], node[1:] != node[:-1]]
        starts = np.flatnonzero(new_key)
        # Number of each distinct node within its run, going on from the batch before.
        n = np.cumsum(fresh)
        run = np.cumsum(new_key)
        place = n - 1 - np.r_[0, n[starts] - 1][run]
        if last is not None:
            place[run == 0] += last[3]
        out = fresh & (place >= 1)
        # The first member of a run is sent along with the second.
        second = np.flatnonzero(out & (place == 1))
        before = run[second] == 0
        first = starts[np.maximum(run[second], 1) - 1] if len(starts) else np.zeros(len(second), np.int64)
        head_rest = np.where(before, last[1] if last else 0, rest[first])
        head_node = np.where(before, last[2] if last else 0, node[first])
        last = (int(key[-1]), int(rest[-1]), int(node[-1]), int(place[-1]) + 1)
        columns = [np.r_[key[out], key[second]], np.r_[place[out] // PART, np.zeros(len(second), np.int64)].astype(np.int32), np.r_[rest[out], head_rest], np.r_[node[out], head_node]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "part", "rest", "node"])


class Bands:
    """Where the bands lie in kept signatures: `wide` bytes each from `at` on; the first `values` bytes are one a value."""

    def __init__(self, bands: int, rows: int, at: int, wide: int, values: int):
        self.bands, self.rows, self.at, self.wide, self.values = bands, rows, at, wide, values

    def keys(self, kept: np.ndarray) -> np.ndarray:
        """Rows of bytes to a mixed 64-bit key for each band."""
        out = np.empty((len(kept), self.bands), np.uint64)
        for t in range(self.bands):
            band = np.zeros((len(kept), -(-self.wide // 8) * 8), np.uint8)
            band[:, : self.wide] = kept[:, self.at + t * self.wide : self.at + (t + 1) * self.wide]
            key = np.full(len(kept), t + 1, np.uint64)
            for part in band.view("<u8").T:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part)
            out[:, t] = key
        return out

    def sketches(self, kept: np.ndarray) -> np.ndarray:
        """For each band a bit of each of SKETCH values outside of it; of fewer values none is made."""
        bits = kept[:, : self.values] & 1
        out = np.zeros((len(kept), self.bands), "<u4")
        if self.values >= SKETCH + self.rows:
            for t in range(self.bands):
                some = bits[:, (self.rows * (t + 1) + np.arange(SKETCH)) % self.values]
                out[:, t] = np.ascontiguousarray(np.packbits(some, axis=1)).view("<u4")[:, 0]
        return out


def _packets(bands: Bands, shards: int):
    """Rows (node, kept) to a packet (shard, packet) for each block and shard: keys' 40 first bits by planes, in order, sketches, nodes."""

    def packed(nodes: list[np.ndarray], kept: list[bytes]) -> pa.RecordBatch:
        node = np.concatenate(nodes)
        rows = np.frombuffer(b"".join(kept), np.uint8).reshape(len(node), -1)
        key = bands.keys(rows).reshape(-1)
        order = np.argsort(key)
        key, sketch, node = key[order], bands.sketches(rows).reshape(-1)[order], node[order // bands.bands]
        shard = (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        plane = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].T
        packets = [plane[:, lo:hi].tobytes() + sketch[lo:hi].tobytes() + node[lo:hi].astype("<i8").tobytes() for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]].astype(np.int32)), pa.array(packets, pa.binary())], names=["shard", "packet"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, kept, size = [], [], 0
        for batch in batches:
            nodes.append(batch["node"].to_numpy())
            kept += batch["kept"].to_pylist()
            size += batch.num_rows
            if size >= PACK:
                yield packed(nodes, kept)
                nodes, kept, size = [], [], 0
        if size:
            yield packed(nodes, kept)

    return run


def _judged(key: np.ndarray, sketch: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in its run, node) of the distinct nodes that have another in their run with a like sketch, or a long run."""
    order = np.lexsort((node, key))
    key, sketch, node = key[order], sketch[order], node[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
    key, sketch, node = key[fresh], sketch[fresh], node[fresh]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    sizes = np.diff(edge)
    stays = np.repeat(sizes > 1, sizes)
    for m in np.unique(sizes[(sizes > 1) & (sizes <= JUDGED)]).tolist():
        starts = edge[:-1][sizes == m]
        step = max(1, 1_000_000 // (m * m))
        for lo in range(0, len(starts), step):
            at = starts[lo : lo + step, None] + np.arange(m)
            some = sketch[at]
            like = np.bitwise_count(some[:, :, None] ^ some[:, None, :]) <= SKETCH - ALIKE
            like[:, np.arange(m), np.arange(m)] = False
            stays[at.reshape(-1)] = like.any(axis=2).reshape(-1)
    key, node = key[stays], node[stays]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key, np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)])), node


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets sorted by shard to the rows that _runs gives, without what met by chance."""

    def runs(packets: list[bytes]) -> pa.RecordBatch:
        keys, sketches, nodes = [], [], []
        for x in packets:
            n = len(x) // 17
            plane = np.frombuffer(x, np.uint8, 5 * n).reshape(5, n)
            key = np.zeros(n, np.int64)
            for p in plane:
                key = key << 8 | p
            keys.append(key)
            sketches.append(np.frombuffer(x, "<u4", n, 5 * n))
            nodes.append(np.frombuffer(x, "<i8", n, 9 * n))
        key, place, node = _judged(np.concatenate(keys), np.concatenate(sketches), np.concatenate(nodes))
        columns = [key << 1, (place // PART).astype(np.int32), np.zeros(len(key), np.int64), node]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "part", "rest", "node"])

    held, last = [], None
    for batch in batches:
        for shard, packet in zip(batch["shard"].to_pylist(), batch["packet"].to_pylist(), strict=True):
            if shard != last and held:
                yield runs(held)
                held = []
            last = shard
            held.append(packet)
    if held:
        yield runs(held)


class _Walk:
    """Items of one run, in order: their ties, and the pivots that are left."""

    def __init__(self, sigs: np.ndarray):
        self.sigs = sigs
        self.label = np.arange(len(sigs))
        self.ties: list[tuple[int, int]] = []

    def cover(self, left: np.ndarray, low: float, cover: float) -> list[int]:
        width, pivots = self.sigs.shape[1], []
        while len(left):
            p = left[0]
            alike = np.count_nonzero(self.sigs[left] == self.sigs[p], axis=1) / width
            alike[0] = 1.0
            near = left[alike >= low]
            groups, first = np.unique(self.label[near], return_index=True)
            for g, at in zip(groups.tolist(), first.tolist(), strict=True):
                if g != self.label[p]:
                    self.ties.append((int(p), int(near[at])))
            if len(groups) > 1:
                self.label[np.isin(self.label, groups)] = groups[0]
            pivots.append(int(p))
            left = left[alike < cover]
        return pivots


def _cover(low: float, cover: float, forest: Forest | None, goes_on: Callable[[int, int, int], bool]):
    """(key, part, rest, node, sig) rows, sorted, to ties (a, b), and the pivots of the parts that go on.

    goes_on: of a run's key, part and number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int | None, int, int | None, bytes | None]] = []
        held: list[pa.RecordBatch] = []

        def walk(table: pa.Table, edge: np.ndarray) -> None:
            """The parts that lie between these edges."""
            if len(edge) < 2:
                return
            key, part, rest, node = (table[c].to_numpy()[: edge[-1]] for c in ("key", "part", "rest", "node"))
            sigs = np.frombuffer(b"".join(table["sig"].slice(0, edge[-1]).to_pylist()), np.uint8).reshape(edge[-1], -1)
            sizes = np.diff(edge)
            # Runs of two are judged at once.
            two = edge[:-1][(sizes == 2) & np.array([not goes_on(int(key[e]), int(part[e]), 2) for e in edge[:-1].tolist()])]
            near = two[(sigs[two] == sigs[two + 1]).mean(axis=1) >= low] if len(two) else two
            out.extend((None, a, b, None) for a, b in zip(node[near].tolist(), node[near + 1].tolist(), strict=True) if a != b)
            judged = set(two.tolist())
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if lo in judged:
                    continue
                items = _Walk(sigs[lo:hi])
                cuts = forest.subtries(rest[lo:hi], forest.matched(items.sigs)) if forest else np.array([0, hi - lo])
                pivots = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    pivots += items.cover(np.arange(a, b), low, cover)
                out.extend((None, int(node[lo + a]), int(node[lo + b]), None) for a, b in items.ties if node[lo + a] != node[lo + b])
                if goes_on(int(key[lo]), int(part[lo]), hi - lo):
                    out.extend((int(key[lo]), int(node[lo + p]), None, items.sigs[p].tobytes()) for p in pivots)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) if len(key) else np.zeros(1, np.int64)
            # The last part may go on in the next batch.
            walk(table, edge)
            held = table.slice(int(edge[-1])).to_batches()
            if len(out) > 50_000:
                yield _ties(out)
                out = []
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                walk(table, np.array([0, table.num_rows]))
        yield _ties(out)

    return run


def _ties(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "a", "b", "sig"])


_TIES = "key long, a long, b long, sig binary"


def _salted(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """pairs with very frequent keys replaced by several, and which key each of these stands for.

    Only how rows are dealt depends on the sample: a key in at least one of 800 items is found
    in it, so there are at most 800 a tree.
    """
    every = max(1, items.count() // SEEN)
    if every * SEEN <= HOT:
        return pairs, None
    frequent = pairs.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).groupBy("key").count()
    frequent = frequent.where((F.col("count") >= SEEN // 800) & (F.col("count") * every > HOT)).select("key", F.ceil(F.col("count") * every / HOT).cast("int").alias("salts"))
    frequent = written(frequent, "frequent-keys")
    if frequent.isEmpty():
        return pairs, None
    frequent = small_or_shuffled(frequent)
    salted = lambda key, salt: F.xxhash64(key, salt).bitwiseOR(F.lit(1))
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    dealt = pairs.join(frequent, "key", "left").withColumn("key", F.when(F.col("salts").isNull(), F.col("key")).otherwise(salted("key", salt))).drop("salts")
    stands = frequent.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(salted("key", "salt").alias("key"), F.col("key").alias("group"))
    return dealt, written(stands, "salted-keys")


def candidate_components(items: DataFrame, low: float, cover: float, forest: Forest | None = None, bands: Bands | None = None) -> DataFrame:
    """(node, root) of items (node long, keys array<long>, sig binary; of a forest also rest array<long>) that are tied to another.

    An item may come several times, but only a few: keys of one item are expected once a task.  With bands, items also
    have the signatures as kept (kept binary); unless keys have to be salted, these are sent in packets, and
    items that meet by chance go where they meet, or their number would grow with the square of the items'.
    """
    keyed = items.where("keys is not null")
    if forest:
        pairs = keyed.select(F.inline(F.arrays_zip("keys", "rest")).alias("key", "rest"), "node")
    else:
        pairs = keyed.select(F.explode("keys").alias("key"), "node")
    pairs, stands = _salted(keyed, pairs)
    if bands and stands is None:
        shards = max(1, -(-keyed.count() * bands.bands // SHARD))
        packets = keyed.select("node", "kept").mapInArrow(_packets(bands, shards), "shard int, packet binary")
        runs = packets.repartition("shard").sortWithinPartitions("shard").mapInArrow(_unpacked, "key long, part int, rest long, node long")
    else:
        order = ["key", "rest"] if forest else ["key"]
        runs = pairs.repartition("key").sortWithinPartitions(*order).mapInArrow(_runs, "key long, part int, rest long, node long")
        if forest:
            runs = in_files(runs, keyed.count() * forest.trees, 100_000)
    runs = written(runs, "runs")
    # The keys' shuffle is the largest by far.
    del pairs
    forget_shuffles(items.sparkSession)
    # Most items are alone with their keys; the signatures of these stay where they are.
    sigs = sieved(keyed.select("node", "sig"), runs.select("node"), ["node"]).dropDuplicates(["node"])
    met = runs.join(sigs, "node").select("key", "part", "rest", "node", "sig")
    walk = _cover(low, cover, forest, lambda key, part, n: bool(key & 1) or part > 0 or n >= PART)
    first = met.repartition("key", "part").sortWithinPartitions("key", "part", "rest", "node").mapInArrow(walk, _TIES)
    first = written(in_files(first, runs.count()) if forest else first, "ties")
    ties = first.where("b is not null").select("a", "b")
    left = first.where("b is null").select("key", F.col("a").alias("node"), "sig")
    if left.isEmpty():
        return components(ties)
    if stands is not None:
        left = left.join(stands, "key", "left").select(F.coalesce("group", "key").alias("key"), "node", "sig")
    left = written(left, "pivots")
    sizes = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    part = F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    met = left.join(small_or_shuffled(written(sizes, "pivot-parts")), "key").select("key", part.alias("part"), F.lit(0).cast("long").alias("rest"), "node", "sig")
    # Pivots stand for items up to 1 - cover away from them, on either side.
    walk = _cover(max(0.0, low - (1 - cover)), 0.6, None, lambda key, part, n: part >= 0)
    second = written(met.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(walk, _TIES), "ties")
    last = second.where("b is null").select("key", "a")
    star = last.join(last.groupBy("key").agg(F.min("a").alias("b")), "key").where("a <> b").select("a", "b")
    return components(ties.unionByName(second.where("b is not null").select("a", "b")).unionByName(star))


def shared(flat: np.ndarray, owner: np.ndarray, n: int, light: int = 16, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of n sets; i, j, size of the intersection, i < j, of the pairs that share anything).

    flat: members of all sets, repeats allowed, owner: the set of each, ascending.  Members in few
    sets are counted pair by pair, `chunk` pairs at a time; those in many are columns of a 0/1 matrix,
    which times itself gives their share.
    """
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    once = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])] if len(flat) else np.zeros(0, bool)
    flat, owner = flat[once], owner[once]
    sizes = np.bincount(owner, minlength=n)
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    df = np.diff(np.r_[starts, len(flat)])
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = (df > 1) & (df <= light)
    held, size = [], 0

    def count() -> None:
        nonlocal size
        if held:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            keys.append(k)
            counts.append(c)
            held.clear()
            size = 0

    for m in np.unique(df[few]).tolist():
        at = starts[few & (df == m)]
        i, j = np.triu_indices(m, 1)
        step = max(1, chunk // len(i))
        for lo in range(0, len(at), step):
            rows = owner[at[lo : lo + step, None] + np.arange(m)]
            held.append((rows[:, i] * n + rows[:, j]).reshape(-1))
            size += len(held[-1])
            if size > chunk:
                count()
    count()
    many = np.flatnonzero(df > light)
    if len(many):
        out = np.zeros((n, n), np.int32)
        for lo in range(0, len(many), 1024):
            some = many[lo : lo + 1024]
            x = np.zeros((n, len(some)), np.float32)
            for column, k in enumerate(some.tolist()):
                x[owner[starts[k] : starts[k] + df[k]], column] = 1
            out += np.rint(x @ x.T).astype(np.int32)
        k = np.flatnonzero(np.triu(out, 1))
        keys.append(k)
        counts.append(out.reshape(-1)[k].astype(np.int64))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return sizes, key // n, key % n, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


_VERIFY = "node long, low long, links long, root long"


def _verify(shingles: Shingles, threshold: float):
    """Rows sorted by (root, i, j) to links and local roots; many small groups are verified together."""
    columns = ["root", "i", "j", "block", "node", "low", "weight"]

    def judge(rows: list[np.ndarray], z: list[bytes]) -> pa.RecordBatch:
        root, i, j, block, node, low, weight = (np.concatenate([r[k] for r in rows]) for k in range(len(columns)))
        order = np.lexsort((low, node, block, j, i, root))
        root, i, j, block, node, low, weight = (c[order] for c in (root, i, j, block, node, low, weight))
        n = len(root)
        group = np.cumsum(np.r_[0, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        flat, starts = shingles([z[k] for k in order.tolist()])
        owner = np.repeat(np.arange(n), np.diff(np.r_[starts, len(flat)]))
        # A group's shingles are its own.
        flat = flat ^ mix64(group[owner].astype(np.uint64) + np.uint64(1))
        size, a, b, both = shared(flat, owner, n)
        alike = both >= threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9
        alike &= (group[a] == group[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
        a, b = a[alike], b[alike]
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(low), pa.array(np.rint(links).astype(np.int64)), pa.array(node[roots(a, b, n)])], names=["node", "low", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        z: list[bytes] = []
        last, size = None, 0
        for batch in batches:
            part = [batch[c].to_numpy().astype(np.int64) for c in columns]
            texts = batch["z"].to_pylist()
            cut = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]) | (part[2][1:] != part[2][:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                here = (part[0][lo], part[1][lo], part[2][lo])
                # Only whole groups are judged; one has at most two blocks of rows.
                if here != last and size and size + (hi - lo) > BLOCK:
                    yield judge(rows, z)
                    rows, z, size = [], [], 0
                last = here
                rows.append([c[lo:hi] for c in part])
                z += texts[lo:hi]
                size += hi - lo
        if size:
            yield judge(rows, z)

    return run


def verified(items: DataFrame, shingles: Shingles, threshold: float) -> DataFrame:
    """(node, low, links, root) of items (root, node, low, weight, z), all pairs within a root compared exactly.

    z is the item's text as `shingles` reads it; links the summed weight of the other items at least
    `threshold` alike; root now the final component's smallest node (its own if it has no link).
    """
    items = written(items, "items")
    # Components of several blocks: at most one for each BLOCK items.
    large = items.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = items.join(small_or_shuffled(written(large, "large")), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "low"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("root", "node", "low", "weight", "z", "block", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    # By ranges, which give a large group a task of its own.
    dealt = rows.repartitionByRange("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = written(dealt.mapInArrow(_verify(shingles, threshold), _VERIFY), "verified")
    final = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node", "low").agg(F.sum("links").alias("links"))
    return links.join(final, "node", "left").select("node", "low", "links", F.coalesce("root", "node").alias("root"))
