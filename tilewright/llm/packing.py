"""Best-fit packing of documents into sequences of at most `size` tokens.

Bounded-space online best fit: at most `open_bins` bins are open, and a bitset (one integer)
has bit f set while some open bin has f tokens free.  The lowest set bit at or above a piece's
length is the best fit.  When too many bins are open, the fullest (lowest set bit) closes.  When
the stream of a task ends, the pieces of the bins still open are packed again, longest first.

Only numbers are dealt out: texts are tokenized where they are read, and pieces
(id, number, start, length, crc) go, in an order drawn from their hash, to tasks of
TASK_PIECES each, so each task sees a mixture like the whole and leaves at most `open_bins`
bins unfilled.

Defined results: a null or empty text is its end id alone; an added token of the vocabulary
(<|endoftext|>) that stands in a text is that token's id; repeated rows are packed as often as
they come; an empty table gives an empty result; a longer document is cut into full pieces, the
remainder first.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small_batches, texts, written

TASK_PIECES = 1_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers JSON file, in an encoder that runs it faster.

    Its merges are in the order of their ids, so ids serve as ranks; its added tokens are cut out of
    texts first and have their own ids, as in the tokenizers library.  Tests hold both libraries' ids
    against each other.
    """
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocab, added = held["model"]["vocab"], {x["content"]: x["id"] for x in held.get("added_tokens") or []}
    if held.get("normalizer") or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path}: texts are changed before they are cut, or cut by other rules")
    if unlike := [x["content"] for x in held.get("added_tokens") or [] if x["single_word"] or x["lstrip"] or x["rstrip"]]:
        raise ValueError(f"{path}: added tokens that take in or need what is beside them: {unlike}")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and token not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


class Packer:
    """Bounded-space best fit.  add() gives nothing; closed bins are in `out` as (bin, fill order)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = 0
        self.held: dict[int, list[int]] = {}
        self.made = 0

    def add(self, item: int, length: int) -> int:
        """Puts the item in its bin and returns the bin's number."""
        fits = self.bits >> length
        if fits:
            space = length + ((fits & -fits).bit_length() - 1)
            number = self._take(space)
        else:
            if len(self.held) >= self.open_bins:
                self.held.pop(self._take((self.bits & -self.bits).bit_length() - 1))
            space, number = self.size, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append(item)
        if left := space - length:
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
        else:
            self.held.pop(number)
        return number

    def _take(self, space: int) -> int:
        at = self.free[space]
        number = at.pop()
        if not at:
            self.bits &= ~(1 << space)
        return number


def pack(lengths: np.ndarray, size: int, open_bins: int) -> np.ndarray:
    """The bin of each item, items in the order given."""
    packer = Packer(size, open_bins)
    bins = np.fromiter((packer.add(i, n) for i, n in enumerate(lengths.tolist())), np.int64, len(lengths))
    rest = np.array(sorted(i for held in packer.held.values() for i in held), np.int64)
    if len(rest):
        order = rest[np.argsort(-lengths[rest], kind="stable")]
        again = Packer(size, max(open_bins, len(packer.held)))
        better = np.fromiter((again.add(i, int(lengths[i])) for i in order.tolist()), np.int64, len(order))
        if again.made < len(packer.held):
            bins[order] = better + packer.made
    return bins


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document's ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(tokenizer).encode_to_numpy
        for batch in small_batches(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                ids = np.append(encode(text, allowed_special="all"), end_id).astype("<u4")
                first = len(ids) % size or size
                raw = ids.tobytes()
                start, k = 0, 0
                while start < len(ids):
                    stop = first + k * size
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start, k = stop, k + 1
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def pack_pieces(rows: DataFrame, size: int = 2048, open_bins: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length."""
    tasks = max(1, math.ceil(rows.count() / TASK_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).drop_columns(["__order"])
        lengths = table["length"].to_numpy()
        bins = pack(lengths, size, open_bins)
        order = np.argsort(bins, kind="stable")
        filled = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]])
        run_of = np.cumsum(np.r_[True, bins[order][1:] != bins[order][:-1]]) - 1
        offset = np.empty(len(bins), np.int64)
        offset[order] = filled - filled[first][run_of]
        number = bins + (TaskContext.get().partitionId() << 40)
        table = table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=100_000)

    # By place as well: ids may be null or repeat, and equal pieces must not be one task's.
    order = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = rows.withColumn("__order", order).repartition(tasks, "__order").sortWithinPartitions("__order")
    return dealt.mapInArrow(run, f"{_PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, open_bins: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed pieces of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(written(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces"), size, open_bins)
