"""Byte-level BPE over a file of ranks, with a two-tier lookup.

A text is split by the pattern; each match is encoded alone.  Tier one: a minimal perfect hash
over the vocabulary's byte strings; a match that is a token in full (its bytes equal those in
its slot) is that one id.  Tier two, for all others: the bytes are nodes of a linked list, a heap
holds the ranks of neighbouring pairs, and the lowest rank merges until none is left.

Equal matches recur, so both tiers' answers are kept for recent ones, bounded in number and in
characters; new matches of a batch go through tier one together, as arrays.  Decoding goes by ids
alone: it looks each one up in the vocabulary.

Defined results: null and empty texts have no ids; ids of a text depend on it alone, so repeated
rows agree; ties of rank merge leftmost first; a match of any length is encoded whole; an empty
table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small_batches, texts
from tilewright.llm.mph import PerfectHash

#: How a text is split before merging (the public pattern of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEEP = 500_000
KEEP_CHARS = 16_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _hashes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join([xxhash.xxh3_128_digest(x) for x in items])
    words = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return words[:, 0], words[:, 1]


class BytePairEncoder:
    """encode(text), decode(ids), and the two tiers whole() and merged()."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = KEEP):
        self.ranks = ranks
        tokens = list(ranks)
        a, b = _hashes(tokens)
        self.mph = PerfectHash.build(a, b)
        slots = self.mph.slots(a, b)
        self.slot_bytes: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, slots.tolist(), strict=True):
            self.slot_bytes[slot] = token
        self.slot_ids = np.array([ranks[x] for x in self.slot_bytes], np.int64)
        self.vocabulary: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.vocabulary[i] = token
        self.numeral = [str(i) for i in range(len(self.vocabulary))]
        # (left id, right id) of every way to write a token as two tokens, as one integer.
        self.pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i
        self.single = [ranks[bytes([x])] for x in range(256)]
        self.find = regex.compile(pattern).findall
        self.keep = keep
        #: Two generations of answers, match -> ids, and the newer one's characters.
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def whole(self, items: list[bytes]) -> np.ndarray:
        """Tier one: each item's id if it is a token as it stands, else -1."""
        slots = self.mph.slots(*_hashes(items))
        out = np.full(len(items), -1, np.int64)
        for i in np.flatnonzero(slots >= 0).tolist():
            if self.slot_bytes[slots[i]] == items[i]:
                out[i] = self.slot_ids[slots[i]]
        return out

    def merged(self, item: bytes) -> list[int]:
        """Tier two: lowest rank first, leftmost among equals, over a linked list of parts."""
        pairs = self.pairs
        ids = [self.single[x] for x in item]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            # Stale entries: the part is gone, or its pair is another by now.
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := pairs.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, rank << 32 | i)
            p = before[i]
            if p >= 0 and (rank := pairs.get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, rank << 32 | p)
        return [x for x in ids if x >= 0]

    def _learn(self, matches: set[str]) -> None:
        """Answers for all these matches in the newer generation."""
        todo = [x for x in matches if x not in self.new]
        size = sum(map(len, todo))
        if len(self.new) + len(todo) > self.keep or self.chars + size > KEEP_CHARS:
            self.old, self.new = self.new, {}
            todo = list(matches)
            self.chars, size = 0, sum(map(len, todo))
        self.chars += size
        known = [x for x in todo if x in self.old]
        self.new.update((x, self.old[x]) for x in known)
        if len(known) < len(todo):
            fresh = [x for x in todo if x not in self.old] if known else todo
            raw = [x.encode() for x in fresh]
            for x, item, i in zip(fresh, raw, self.whole(raw).tolist(), strict=True):
                self.new[x] = (i,) if i >= 0 else tuple(self.merged(item))

    def encode_batch(self, many: list[str]) -> Iterator[list[int]]:
        """The ids of each text; new matches of all texts are looked up together."""
        split = [self.find(text) for text in many]
        every: set[str] = set()
        for matches in split:
            every.update(matches)
        self._learn(every)
        get = self.new.__getitem__
        for matches in split:
            yield list(chain.from_iterable(map(get, matches)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def as_text(self, ids: list[int]) -> str:
        """Decimal ids, one space between."""
        return " ".join(map(self.numeral.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN) -> BytePairEncoder:
    """One encoder for each process and file."""
    return BytePairEncoder(load_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in small_batches(batches, 256):
            ids = list(bpe.encode_batch(texts(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() without moving ids out of Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in small_batches(batches, 256):
            counts, ids, decoded = [], [], []
            for found in bpe.encode_batch(texts(batch["text"])):
                counts.append(len(found))
                ids.append(sha(bpe.as_text(found).encode()))
                decoded.append(sha(bpe.decode(found)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
