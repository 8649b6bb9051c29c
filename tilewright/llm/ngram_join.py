"""N-gram Jaccard join: pairs of documents whose five-word shingles are at least 0.8 alike.

A MinHash LSH forest: each of `TREES` trees holds the documents' signatures, `LONGEST` values a tree,
as sorted prefix tries.  A trie hangs on the shortest prefix, at which even a pair just at the threshold is
met with probability `TARGET`; within it the matched prefix is shortened from the longest, level by
level, until the pairs seen there are met with that probability over all trees.  What meets is
verified exactly (see minhash).

Words are runs of other than blank characters, lower case; a text of one to four words is a single
shingle.  Documents with equal sets of shingles are one class; only classes are joined.

Defined results: null and empty texts (no words) are one class, linked to each other alone; repeated
rows are copies of each other; ties for a class's id go to the smallest doc_id, null ids last;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import in_files, joined, mix64, small_batches, texts, written
from tilewright.llm.minhash import Forest, Hashes, after_prefix, as_bytes, candidate_components, prefix_keys, shortest_prefix, verified

WORDS = 5
THRESHOLD = 0.8
TREES, LONGEST, TARGET = 24, 12, 0.999
#: By signature, pivots cover documents at least COVER alike; a pair at the threshold has one's pivot 0.65 like
#: the other or more, and estimates are off by 0.1 less than once in a thousand.
LOW, COVER = 0.55, 0.85
_KEEP = 100_000


class WordShingles:
    """Texts to sorted sets of 64-bit shingles; hashes of words are kept for a bounded number of them."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        found = text.lower().split()
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(known) > _KEEP:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(found))
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if not len(h):
            return h
        n = min(self.words, len(h))
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mix64(out + np.uint64(i)) + h[i : len(h) - n + 1 + i]
        return np.unique(mix64(out + np.uint64(n)))

    def __call__(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of compressed texts, one after another, and where each text's begin."""
        unpack = zstandard.ZstdDecompressor().decompress
        sets = [self.of(unpack(x).decode()) for x in many]
        return np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])


def _features(words: int, forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, hashes = WordShingles(words), Hashes(forest.trees * forest.longest)
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: set[bytes] = set()
        for batch in small_batches(batches, 256):
            ids, digests, new, sets, z = batch["doc_id"], [], [], [], []
            for text in texts(batch["text"]):
                found = shingles.of(text)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                digests.append(digest)
                # Keys of one class are sent once a task, so copies never crowd a key.
                fresh = len(found) > 0 and digest not in seen
                new.append(fresh)
                if fresh:
                    if len(seen) > _KEEP:
                        seen.clear()
                    seen.add(digest)
                    sets.append(found)
                    z.append(pack(text.encode()))
            name = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            mask = ~np.array(new, bool)
            where = pa.array(np.where(mask, 0, np.cumsum(~mask) - 1), mask=mask)
            if sets:
                sig = hashes.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * forest.trees)
                keys, after = (pa.ListArray.from_arrays(offsets, pa.array(x(sig, forest.trees, forest.shortest).reshape(-1))).take(where) for x in (prefix_keys, after_prefix))
                sigs = pa.array([x.tobytes() for x in as_bytes(sig)], pa.binary()).take(where)
                packed = pa.array(z, pa.binary()).take(where)
            else:
                keys, after, sigs, packed = (pa.nulls(len(ids), t) for t in (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))
            rest = [c for c in batch.schema.names if c not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([ids, pa.array(name[:, 0]), pa.array(name[:, 1]), keys, after, sigs, packed, *(batch[c] for c in rest)], names=["doc_id", "node", "low", "keys", "rest", "sig", "z", *rest])

    return run


def _joined(rows: DataFrame, threshold: float, words: int, trees: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Features of rows (doc_id, text and others), and of each content with a copy or link its class and links.

    A class is named by (linked, root, of): a component's root, or the one content that has copies only.
    """
    forest = Forest(threshold, trees, shortest_prefix(threshold, trees, target, LONGEST), LONGEST, target)
    rest = "".join(f", {c} {kind}" for c, kind in rows.dtypes if c not in ("doc_id", "text"))
    features = written(rows.mapInArrow(_features(words, forest), "doc_id long, node long, low long, keys array<long>, rest array<long>, sig binary, z binary" + rest), "join-features")
    n = features.count()
    classes = written(in_files(features.groupBy("node", "low").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), n), "join-classes")
    tied = written(candidate_components(features.select("node", "keys", "rest", "sig"), LOW, COVER, forest), "join-candidates")
    chosen = joined(features.where("z is not null").select("node", "low", "z"), tied, ["node"]).dropDuplicates(["node", "low"])
    items = chosen.join(classes.select("node", "low", F.col("n").alias("weight")), ["node", "low"])
    found = written(in_files(verified(items.select("root", "node", "low", "weight", "z"), WordShingles(words), threshold), n), "join-links")
    named = classes.join(found, ["node", "low"])
    groups = named.groupBy("root").agg(F.min("first").alias("class_id"))
    linked = named.join(groups, "root").select("node", "low", "class_id", (F.col("n") - 1 + F.col("links")).alias("n_links"), F.lit(True).alias("linked"), "root", F.lit(0).cast("long").alias("of"))
    alone = classes.where("n > 1").join(found.select("node", "low"), ["node", "low"], "left_anti").select("node", "low", F.col("first").alias("class_id"), (F.col("n") - 1).alias("n_links"), F.lit(False).alias("linked"), F.col("node").alias("root"), F.col("low").alias("of"))
    return features, linked.unionByName(alone)


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    class_id is the smallest doc_id of its connected group; n_links the number of other documents
    at least `threshold` like it, copies counted one by one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features, known = _joined(rows, threshold, words, trees, target)
    every = features.select("doc_id", "node", "low").join(known.select("node", "low", "class_id", "n_links"), ["node", "low"], "left")
    own = F.col("n_links").isNull()
    return every.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def decide_copies(docs: DataFrame, digest_col: str, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, kept) of every row that has a copy or link: of a class the first (doc_id, digest) is kept.

    Rows are told apart by id and the digest of their text, so ids may repeat or be null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(digest_col).alias("digest"))
    features, known = _joined(rows, threshold, words, trees, target)
    key = ["linked", "root", "of"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("place")
    met = written(features.select("node", "low", place).join(known.select("node", "low", *key), ["node", "low"]).select(*key, "place"), "join-places")
    stays = met.groupBy(*key).agg(F.min("place").alias("stays"))
    return met.join(stays, key).select("place.doc_id", "place.digest", F.col("place").eqNullSafe(F.col("stays")).alias("kept"))
