"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines; a long line counts as windows of `WIDTH` characters from its start)
are hashed to 64-bit digests; the k-th repeat of a digest gets a digest of its own.  A sketch
has three hash tables of cells (count, sum of digests, sum of check values), as large as it takes for
its own digests to be peeled out of it: one and a half cells a digest at least, in powers of two,
doubled on failure.

Two fingerprints are compared by nothing but their cells.  A larger sketch folds to any smaller size.
Folded to the smallest size, both subtract cell by cell, which cancels what they share; peeling then
takes out cells that hold one digest until all are empty and so recovers the digests in which the
versions differ.  Where it gets stuck it is tried again at four times the size, and at last each
sketch is peeled on its own.  Likeness is shared digests / all digests.

All of it runs on whole batches: the cells of many documents lie in one array.

Defined results: a null or empty text has an all-zero sketch; two empty texts are alike (1.0);
equal texts have equal fingerprints; rows with one doc_id are in the order of a hash of their text;
null ids come first; rows equal in id and text follow each other, and are one task's; in a table of one
row it is its own next document; an empty table gives an empty result; columns besides id and text are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import mix64, texts

WIDTH = 64
#: Cells of the smallest hash table of a sketch, and text bytes that are one range of documents.
PART = 8
RANGE_BYTES = 32_000_000
_SEEDS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_CELL = np.dtype([("count", "<i2"), ("key", "<u8"), ("check", "<u4")])
_NO_ID = -(2**63)
_pieces = re.compile(r"[^\n]{1,%d}\n?|\n" % WIDTH).findall


def digests(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all texts, one after another; offsets of each text's keys)."""
    one = xxhash.xxh3_64_intdigest
    keys: list[int] = []
    ends = [0]
    for text in docs:
        keys += [one(p.encode()) for p in _pieces(text)]
        ends.append(len(keys))
    flat, offsets = np.array(keys, np.uint64), np.array(ends, np.int64)
    owner = _owners(offsets)
    order = np.lexsort((flat, owner))
    f, o = flat[order], owner[order]
    new = np.r_[True, (f[1:] != f[:-1]) | (o[1:] != o[:-1])] if len(f) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    nth = np.arange(len(f)) - starts[np.cumsum(new) - 1] if len(f) else np.zeros(0, np.int64)
    flat[order] = mix64(f + mix64(nth.astype(np.uint64)))
    return flat, offsets


def _owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ _SEEDS[3]) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """The sketches of some documents: of each, the cells of one of its three tables (`part`), and how many keys it holds."""

    def __init__(self, part: np.ndarray, held: np.ndarray):
        self.part, self.held = part, held
        self.offset = np.r_[0, np.cumsum(3 * part)]
        n = int(self.offset[-1])
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    @classmethod
    def of(cls, keys: np.ndarray, offsets: np.ndarray) -> Sketches:
        """Sketches that can be peeled, of texts' digests."""
        held = np.diff(offsets)
        part = PART << np.ceil(np.log2(np.maximum(held / (2 * PART), 1))).astype(np.int64)
        owner, left = _owners(offsets), np.arange(len(held))
        while len(left):
            number = np.full(len(held), -1)
            number[left] = np.arange(len(left))
            here = number[owner] >= 0
            made = cls(part[left], held[left])
            made.add(keys[here], number[owner[here]], 1)
            solved, found, _, _ = made.peel()
            left = left[~(solved & (np.bincount(found, minlength=len(left)) == held[left]))]
            part[left] *= 2
        out = cls(part, held)
        out.add(keys, owner, 1)
        return out

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        """Adds (or takes out, by sign) keys; returns the cells that changed."""
        check = _checks(keys)
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        k, c = np.where(signs < 0, np.uint64(0) - keys, keys), np.where(signs < 0, np.uint32(0) - check, check)
        part, base = self.part[owner], self.offset[owner]
        places = [base + j * part + (mix64(keys ^ _SEEDS[j]) & (part - 1).astype(np.uint64)).astype(np.int64) for j in range(3)]
        for at in places:
            np.add.at(self.count, at, signs)
            np.add.at(self.key, at, k)
            np.add.at(self.check, at, c)
        return np.concatenate(places) if len(keys) else np.zeros(0, np.int64)

    def folded(self, chosen: np.ndarray, part: np.ndarray) -> Sketches:
        """Some of the sketches at smaller sizes: cells that come to lie on each other add up."""
        out = Sketches(part, self.held[chosen])
        size = 3 * self.part[chosen]
        owner = np.repeat(np.arange(len(chosen)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        at, own = self.offset[chosen][owner] + place, self.part[chosen][owner]
        to = out.offset[owner] + place // own * part[owner] + (place % own) % part[owner]
        np.add.at(out.count, to, self.count[at])
        np.add.at(out.key, to, self.key[at])
        np.add.at(out.check, to, self.check[at])
        return out

    def minus(self, other: Sketches) -> Sketches:
        """Differences of sketches of the same sizes."""
        out = Sketches(self.part, self.held)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(solved, for each document; owner, key and sign of each recovered digest); empties the cells."""
        n, cell_owner = len(self.part), np.repeat(np.arange(len(self.part)), 3 * self.part)
        owners, found, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        room = 3 * self.part
        at = np.arange(len(self.count))
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            sign = self.count[at]
            keys = np.where(sign < 0, np.uint64(0) - self.key[at], self.key[at])
            checks = np.where(sign < 0, np.uint32(0) - self.check[at], self.check[at])
            # A sketch that has given more than it can hold goes round in circles.
            pure = (_checks(keys) == checks) & (room[cell_owner[at]] > 0)
            at, sign, keys = at[pure], sign[pure], keys[pure]
            owner = cell_owner[at]
            _, once = np.unique(keys ^ mix64(owner.astype(np.uint64)), return_index=True)
            owner, sign, keys = owner[once], sign[once], keys[once]
            room = room - np.bincount(owner, minlength=n)
            for held, new in ((owners, owner), (found, keys), (signs, sign)):
                held.append(new)
            at = np.unique(self.add(keys, owner, -sign))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        solved = np.bincount(cell_owner[left], minlength=n) == 0
        return solved, np.concatenate(owners), np.concatenate(found), np.concatenate(signs)

    def strings(self) -> list[str]:
        """Each sketch as text: its number of keys, then its cells."""
        cells = np.zeros(len(self.count), _CELL)
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check
        ends = self.offset.tolist()
        return [base64.b64encode(int(n).to_bytes(4, "little") + cells[lo:hi].tobytes()).decode() for n, lo, hi in zip(self.held.tolist(), ends, ends[1:], strict=False)]

    @classmethod
    def parse(cls, strings: list[str]) -> Sketches:
        raw = [base64.b64decode(x) for x in strings]
        held = np.array([int.from_bytes(x[:4], "little") for x in raw], np.int64)
        out = cls(np.array([(len(x) - 4) // _CELL.itemsize // 3 for x in raw], np.int64), held)
        cells = np.frombuffer(b"".join([x[4:] for x in raw]), _CELL)
        out.count[:], out.key[:], out.check[:] = cells["count"], cells["key"], cells["check"]
        return out


def differences(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of the digests that are only in the i-th of a (1) or only in the i-th of b (-1)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    least = np.minimum(a.part, b.part)
    left, size = np.arange(len(a.part)), PART
    while len(left):
        # Not at a size that can't hold so many.
        now = left[(size <= least[left]) & (np.abs(a.held - b.held)[left] <= 3 * size)]
        part = np.full(len(now), size)
        solved, owner, keys, sign = a.folded(now, part).minus(b.folded(now, part)).peel()
        solved &= np.bincount(owner, sign, len(now)).astype(np.int64) == (a.held - b.held)[now]
        mine = solved[owner]
        out.append((now[owner[mine]], keys[mine], sign[mine]))
        left = np.setdiff1d(left, now[solved])
        if not (size < least[left]).any():
            break
        size *= 4
    if len(left):
        # Each on its own, which it was made large enough for.
        own = [x.folded(left, x.part[left]).peel() for x in (a, b)]
        owner, keys = np.concatenate([own[0][1], own[1][1]]), np.concatenate([own[0][2], own[1][2]])
        sign = np.repeat([1, -1], [len(own[0][1]), len(own[1][1])])
        order = np.lexsort((keys, owner))
        owner, keys, sign = owner[order], keys[order], sign[order]
        same = np.r_[False, (owner[1:] == owner[:-1]) & (keys[1:] == keys[:-1])]
        alone = ~(same | np.r_[same[1:], False])
        out.append((left[owner[alone]], keys[alone], sign[alone]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared digests / all digests of the i-th of a and of b; how many are only in the first, only in the second."""
    pair, _, sign = differences(a, b)
    first, second = (np.bincount(pair[sign == s], minlength=len(a.part)) for s in (1, -1))
    every = a.held + second
    return np.where(every > 0, (a.held - first) / np.maximum(every, 1), 1.0), first, second


def compare(a: list[str], b: list[str]) -> list[float]:
    """Likeness of fingerprints as they are stored."""
    return likeness(Sketches.parse(a), Sketches.parse(b))[0].tolist()


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by the first as many characters of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_gone long, n_new long"


def _compare(rows: list[tuple[int, str]], following: str) -> pa.RecordBatch:
    """rows: consecutive documents; following: the one after the last."""
    own = [text for _, text in rows]
    new = [edited(x, y) for x, y in zip(own, [*own[1:], following], strict=True)]
    n = len(own)
    every = Sketches.of(*digests([*own, following]))
    mine, after = (every.folded(at, every.part[at]) for at in (np.arange(n), np.arange(n) + 1))
    changed = Sketches.of(*digests(new))
    near, gone, fresh = likeness(mine, changed)
    columns = [
        pa.array([i for i, _ in rows], pa.int64()),
        pa.array([len(x) for x in own], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
        pa.array(mine.strings(), pa.string()),
        pa.array(changed.strings(), pa.string()),
        pa.array(near, pa.float64()),
        pa.array(likeness(mine, after)[0], pa.float64()),
        pa.array(gone, pa.int64()),
        pa.array(fresh, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])


class Ranges:
    """Ranges of (id, hash of the text): where each begins, in order."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.ids, self.hashes = ids, hashes

    def place(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each row; what is before all is in the first."""
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        at = hi - 1
        for i in np.flatnonzero(hi > lo).tolist():
            at[i] = lo[i] + np.searchsorted(self.hashes[lo[i] : hi[i]], hashes[i], "right") - 1
        return np.maximum(at, 0)


def _ranges(rows: DataFrame) -> Ranges:
    """One short row on the driver for each RANGE_BYTES of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / RANGE_BYTES))
    keys = rows.select("k", "h").repartitionByRange(n, "k", "h").withColumn("range", F.spark_partition_id())
    first = sorted((r["first"]["k"], r["first"]["h"]) for r in keys.groupBy("range").agg(F.min(F.struct("k", "h")).alias("first")).select("first").collect())
    return Ranges(np.array([k for k, _ in first] or [_NO_ID], np.int64), np.array([h for _, h in first] or [0], np.int64))


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sketch, that of its edited text, and both likenesses.

    n_gone and n_new: how many digests the edit took away and brought, as recovered from the sketches.
    Documents are cut into ranges in order of id; a task walks one range in order.  The first document
    of a range goes, as a copy, also to the range before, whose last document is edited with it.
    Texts are shuffled once, compressed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(text).alias("h"))
    ranges = _ranges(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        count = len(ranges.ids)
        for batch in batches:
            key, h = batch["k"].to_numpy(), batch["h"].to_numpy()
            at = ranges.place(key, h)
            packed = pa.array([pack(x.encode()) for x in texts(batch["text"])], pa.binary())
            heads = np.flatnonzero((ranges.ids[at] == key) & (ranges.hashes[at] == h))
            rows = np.r_[np.arange(batch.num_rows), heads]
            tail = np.arange(len(rows)) >= batch.num_rows
            where = np.where(tail, (at[rows] - 1) % count, at[rows])
            some = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(tail), batch["doc_id"].take(some), batch["h"].take(some), packed.take(some)], names=["range", "tail", "doc_id", "h", "z"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int, str]] = []
        size = 0
        for batch in batches:
            for tail, doc_id, z in zip(batch["tail"].to_pylist(), batch["doc_id"].to_pylist(), batch["z"].to_pylist(), strict=True):
                if tail and not held:
                    continue  # a further row equal to the range's next document
                text = unpack(z).decode()
                if tail:
                    yield _compare(held, text)
                    held, size = [], 0
                    continue
                if len(held) >= 512 or size > 4_000_000:
                    yield _compare(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            raise ValueError("a range of documents has no successor")

    dealt = rows.mapInArrow(deal, "range int, tail boolean, doc_id long, h long, z binary")
    return dealt.repartition("range").sortWithinPartitions("range", "tail", "doc_id", "h").mapInArrow(walk, _OUT)
