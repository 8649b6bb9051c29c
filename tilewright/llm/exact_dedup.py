"""Exact dedup through a minimal perfect hash over the digests of a history.

The history is grouped by SHA-256 digest with map-side combining, so a text that fills a
third of all rows is a few partial rows, never one task's group.  The digests, in shards of
bounded size, go into minimal perfect hashes whose slots hold the full digest, the winner's
locator (the largest doc_id) and the count.  Documents then meet the shard of their digest in
a sorted stream: a slot whose digest is equal byte for byte makes the row a repeat of a known
text; all others (nonmembers) are grouped among themselves.  Shards that hold hot texts are
salted: their small index is copied to each salt, their rows are spread.

Defined results: null text counts as empty; a null doc_id never wins over another id; rows
repeated with one doc_id each count in group_size and agree in `kept`; an empty table gives an
empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small_or_shuffled, written
from tilewright.llm.mph import PerfectHash

SHARD_ROWS = 32_768
HOT_ROWS = 262_144
_INDEX = "shard long, mph binary, digests binary, winners binary, counts binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text as it is, JVM-side."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)
    return words[:, 0], words[:, 1]


def _matrix(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(-1, 32)


def _build_shard(table: pa.Table) -> pa.Table:
    digest = _matrix(table["digest"].combine_chunks())
    a, b = _words(digest)
    mph = PerfectHash.build(a, b)
    slot = mph.slots(a, b)
    kept = np.empty_like(digest)
    kept[slot] = digest
    winners, counts = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
    # A winner that is null (all ids null) is marked by the smallest long.
    winners[slot] = table["winner"].fill_null(np.iinfo(np.int64).min).to_numpy()
    counts[slot] = table["n"].to_numpy()
    return pa.table({"shard": table["shard"].slice(0, 1), "mph": [mph.dump()], "digests": [kept.tobytes()], "winners": [winners.tobytes()], "counts": [counts.tobytes()]})


class Index:
    """Shards of the history: frame (one row a shard), shards, and how often hot shards are salted."""

    def __init__(self, frame: DataFrame, hot: DataFrame, shards: int):
        self.frame, self.hot, self.shards = frame, hot, shards


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def build_index(history: DataFrame) -> Index:
    """history: digests() of the documents seen so far; every distinct one gets a slot."""
    total = history.count()
    groups = written(history.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")), "dedup-groups")
    shards = max(1, math.ceil(total / SHARD_ROWS))
    groups = groups.withColumn("shard", _shard(shards))
    frame = groups.groupBy("shard").applyInArrow(_build_shard, _INDEX)
    # At most total / HOT_ROWS shards are hot: a few bytes for each quarter million rows.
    hot = groups.groupBy("shard").agg(F.ceil(F.sum("n") / HOT_ROWS).cast("int").alias("salts")).where("salts > 1")
    return Index(frame, small_or_shuffled(written(hot, "dedup-hot")), shards)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, index = None, None
    for batch in batches:
        shard, salt = batch["shard"].to_numpy(zero_copy_only=False), batch["salt"].to_numpy(zero_copy_only=False)
        kind = batch["kind"].to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            if hi == lo:
                continue
            here = (int(shard[lo]), int(salt[lo]))
            part = batch.slice(lo, hi - lo)
            if kind[lo] == 0:
                row = {c: part[c][0].as_py() for c in ("mph", "digests", "winners", "counts")}
                key = here
                index = (PerfectHash.load(row["mph"]), np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), np.frombuffer(row["winners"], np.int64), np.frombuffer(row["counts"], np.int64))
                continue
            n = hi - lo
            keep, size, member = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            if key == here:
                mph, slots, winners, counts = index
                digest = _matrix(part["digest"])
                at = mph.slots(*_words(digest))
                found = np.flatnonzero(at >= 0)
                same = (slots[at[found]] == digest[found]).all(axis=1)
                found = found[same]
                member[found] = True
                keep[found], size[found] = winners[at[found]], counts[at[found]]
            none = ~member | (keep == np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], pa.array(keep, mask=none), pa.array(size, mask=~member)], names=["doc_id", "digest", "keep_id", "group_size"])


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """(doc_id, digest, keep_id, group_size) of each row; the last two null for nonmembers."""
    # Salted by place, not by id: ids may be null or repeat.
    docs = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("shard", _shard(index.shards)).join(index.hot, "shard", "left")
    docs = docs.select("shard", F.pmod("place", F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "digest", *(F.lit(None).cast("binary").alias(c) for c in ("mph", "digests", "winners", "counts")))
    slots = index.frame.join(index.hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    slots = slots.select("shard", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "mph", "digests", "winners", "counts")
    met = docs.unionByName(slots).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return met.mapInArrow(_look_up, "doc_id long, digest binary, keep_id long, group_size long")


def dedup(rows: DataFrame, index: Index) -> DataFrame:
    """Rows of digests() against an index; nonmembers group separately, with map-side combining.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    found = written(look_up(rows, index), "dedup-found")
    members, others = found.where("group_size is not null"), found.where("group_size is null").select("doc_id", "digest")
    groups = others.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    every = members.unionByName(others.join(groups, "digest"))
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of docs: which document of its equal texts stays.

    The history is the table itself: all its distinct digests make the index.
    """
    rows = written(digests(docs, id_col, text_col), "dedup-digests")
    return dedup(rows, build_index(rows))
