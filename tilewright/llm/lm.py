"""Language-model scoring by a weighted backoff automaton over word n-grams.

The model.  A text is its words and one end.  The root state has an arc for every word seen in
learning, weight log10 P1(word), P1 = (count - D) / N, and one for all others with the mass that
the discount D frees.  Every n-gram that is a context seen in learning is a state u, texts' starts among
them: it has an arc for each continuation w seen, weight log10 (c(u, w) + m P(w | shorter)) / (c(u) + m),
to the state of the longest context that u and w end in, and a failure arc, weight log10 m / (c(u) + m),
to the state of the shorter context.  m = MASS * c(u) ** b stands for the context's distinct
continuations (one after one occurrence, ever fewer new ones later); b, of each order, is such that
c(u) ** b, summed over all contexts, is the number of distinct n-grams.  One traversal from left to
right carries the state: at each word it takes the arc, or failure arcs until there is one, and adds
the weights.

At scale neither model nor texts fit one machine, and every count covers the whole corpus:
  1. Where texts are read they become blocks of about `BLOCK` tokens, written as word numbers; a longer
     text goes on in the next block, after the words that are its context.  From these comes, for each
     shard of the 64-bit n-gram space, a packet: the sorted hashes of the block's distinct n-grams
     and their counts in learning.
  2. Each shard adds up its packets and answers each with the corpus totals, in the packet's order.
     Its sums of counts, added up in Spark, give N, V and the discounts.
  3. Each block, with its answers, builds the part of the automaton that its texts can reach, and
     traverses it, many texts abreast; long texts in lanes, each of which first reads the words
     that are its context, which is all that a state knows.
Hashes spread evenly, so frequent words and repeated texts load no task more than others.  Sorted
hashes cost about five bytes, totals less than one.

Defined results: a null or empty text is its end alone; with nothing to learn from, all
probabilities are 1 (score 0); a null id is learned from; repeated rows count as often as they
come; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bucket_of, mix64, small_batches, text_bytes, written

BLOCK = 1_500_000
LANE = 512
SHARD_BYTES = 16_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_START, _END = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
_ORDER_BITS = np.uint64(7)
_POWERS = np.linspace(0, 1, 41)
MASS = 4.0


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lowered; bytes.split() cuts at \\x20 and \\x09 to \\x0D."""
    return text.translate(_LOWER).split()


def _press(x: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    raw = np.ascontiguousarray(x)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(raw.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes())


def _unpress(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind = np.dtype(raw[:4].strip().decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _press_sorted(x: np.ndarray) -> bytes:
    return _press(np.diff(x, prepend=np.uint64(0)))


def _unpress_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpress(blob), dtype=np.uint64)


class Block:
    """Pieces of documents as one run of word numbers, each document's end included."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, skips: np.ndarray, words: np.ndarray, train: np.ndarray):
        """words: 64-bit hashes by number; lengths, skips and train: of each piece.

        A piece that goes on with a text begins with `skip` words that are context only; a text's first has none.
        """
        self.ids, self.lengths, self.skips, self.words, self.train = ids, lengths, skips, words, train
        self.starts = np.cumsum(lengths) - lengths
        self.first = np.zeros(len(ids), bool)
        self.first[self.starts] = True
        place = np.arange(len(ids)) - np.repeat(self.starts, lengths)
        #: Whether a token is the piece's own, and how many tokens before it are known, a text's start among them.
        self.own = place >= np.repeat(skips, lengths)
        self.known = place + np.repeat(skips == 0, lengths)

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each n up to order: (distinct n-grams as 64-bit keys, the number of the one that ends at each position).

        A document's first word is preceded by a start; where an n-gram would reach before what is known, the
        number is -1.
        """
        named = lambda keys, n: (keys & ~_ORDER_BITS) | np.uint64(n)
        out = [(named(mix64(self.words), 1), self.ids)]
        h = self.words[self.ids]
        before = np.r_[_START, h[:-1]]
        before[self.first] = _START
        shorter = mix64(np.uint64(0x9E3779B97F4A7C15) + before)
        for n in range(2, order + 1):
            context = shorter if n == 2 else np.r_[np.uint64(0), shorter[:-1]]
            shorter = mix64(context * np.uint64(0xD1342543DE82EF95) + h)
            whole = self.known >= n - 1
            keys, inverse = np.unique(named(shorter[whole], n), return_inverse=True)
            number = np.full(len(h), -1, np.int32)
            number[whole] = inverse
            out.append((keys, number))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], limit: int, order: int) -> Iterator[tuple[Block, pa.Array, np.ndarray]]:
    """Blocks, and of each piece the doc_id and the number of its row."""
    number: defaultdict[bytes, int] = defaultdict()
    ids: list[np.ndarray] = []
    doc_ids: list[int | None] = []
    rows: list[int] = []
    held: list[bool] = []
    skips: list[int] = []

    def fresh() -> None:
        for x in (number, ids, doc_ids, rows, held, skips):
            x.clear()
        number.default_factory = number.__len__
        number[b"\n"]  # the end; no word is a line break

    def done() -> tuple[Block, pa.Array, np.ndarray]:
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
        words[0] = _END
        lengths = np.array([len(x) for x in ids], np.int64)
        return Block(np.concatenate(ids), lengths, np.array(skips, np.int64), words, ~np.array(held, bool)), pa.array(doc_ids, pa.int64()), np.array(rows, np.int64)

    fresh()
    size, row = 0, TaskContext.get().partitionId() << 32
    for batch in small_batches(batches):
        for doc_id, text, out in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["held_out"].to_pylist(), strict=True):
            found = tokens(text)
            found.append(b"\n")
            at, row = 0, row + 1
            while at < len(found):
                # A text's first piece is at least a context long, so that what goes on has a whole one.
                stop, begin = min(len(found), at + max(limit - size, order)), max(0, at - order + 1)
                part = found[begin:stop]
                ids.append(np.fromiter(map(number.__getitem__, part), np.int32, len(part)))
                doc_ids.append(doc_id)
                rows.append(row)
                held.append(out)
                skips.append(at - begin)
                size, at = size + stop - at, stop
                if size >= limit:
                    yield done()
                    fresh()
                    size = 0
    if ids:
        yield done()


def _edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of sorted keys begins, and the end."""
    cuts = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(keys, cuts), len(keys)].astype(np.int64)


_BLOCKS = "block long, doc_ids binary, rows binary, lengths binary, skips binary, train binary, ids binary, words binary"


def _to_blocks(limit: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (block, doc_ids, rows) in enumerate(_blocks(batches, limit, order)):
            number = TaskContext.get().partitionId() << 32 | k
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([doc_ids], names=["doc_id"]))
            row = [sink.getvalue().to_pybytes(), *map(_press, (rows, block.lengths, block.skips, block.train.astype(np.uint8), block.ids, block.words))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in row)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _read(row: dict) -> Block:
    return Block(*(_unpress(row[x]) for x in ("ids", "lengths", "skips", "words")), _unpress(row["train"]).astype(bool))


_PACKETS = "block long, shard int, keys binary, counts binary"


def _to_packets(shards: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            block = _read(row)
            learned = np.repeat(block.train, block.lengths) & block.own
            grams = block.grams(order)
            keys = np.concatenate([k for k, _ in grams])
            counts = np.concatenate([np.bincount(at[learned & (at >= 0)], minlength=len(k)) for k, at in grams]).astype(np.uint32)
            rank = np.argsort(keys, kind="stable")
            keys, counts = keys[rank], counts[rank]
            at = _edges(keys, shards)
            spans = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
            columns = [[row["block"]] * len(spans), [s for s, _, _ in spans], [_press_sorted(keys[lo:hi]) for _, lo, hi in spans], [_press(counts[lo:hi]) for _, lo, hi in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "shard", "keys", "counts"])

    return run


_TOTALS = "block long, shard int, totals binary, sums array<double>"


def _add_up(order: int):
    def run(table: pa.Table) -> pa.Table:
        packets = [_unpress_sorted(x) for x in table["keys"].to_pylist()]
        keys, inverse = np.unique(np.concatenate(packets), return_inverse=True)
        counts = np.concatenate([_unpress(x) for x in table["counts"].to_pylist()])
        totals = np.bincount(inverse, counts, len(keys)).astype(np.uint64)
        ends = np.cumsum([len(x) for x in packets])
        small = totals.astype(np.uint32) if totals.max(initial=0) < 1 << 32 else totals
        answers = [_press(small[part]) for part in np.split(inverse, ends[:-1])]
        n = keys & _ORDER_BITS
        by_order = [totals[(n == k) & (totals > 0)] for k in range(1, order + 1)]
        # Few values of a count are distinct, so their powers cost little.
        spread = [np.unique(t, return_counts=True) for t in by_order]
        sums = np.array([[t.sum(), (t == 1).sum(), (t == 2).sum(), len(t), *(c @ (v[:, None].astype(np.float64) ** _POWERS))] for t, (v, c) in zip(by_order, spread, strict=True)], np.float64)
        # One row more, without a block, for what is summed over shards.
        return pa.table({"block": pa.array([*table["block"].to_pylist(), None], pa.int64()), "shard": pa.array([table["shard"][0].as_py()] * (len(answers) + 1), pa.int32()), "totals": pa.array([*answers, None], pa.binary()), "sums": pa.array([*[None] * len(answers), sums.reshape(-1)], pa.list_(pa.float64()))})

    return run


class Weights:
    """What the automaton's weights come from besides counts."""

    def __init__(self, sums: np.ndarray):
        """sums: for each order, tokens, n-grams seen once, twice, at all, and their counts' powers."""
        self.n, once, twice, self.v = (int(x) for x in sums[0][:4])
        # All words seen once would leave nothing to words seen.
        self.discount = min(once / (once + 2 * twice), 0.95) if once else 0.5
        self.unknown = self.discount * self.v / self.n if self.n else 1.0
        #: For orders 2 and on: the power of a context's count that is its distinct continuations.
        self.power = [float(np.interp(sums[k][3], sums[k - 1][4:], _POWERS)) for k in range(1, len(sums))]


class Automaton:
    """The states and arcs that a block's n-grams reach.

    State 0 is the root, 1 a text's start; after them come the block's distinct words, pairs and so on
    that were learned and are shorter than the order.  fall_to and fall: each state's failure arc and
    its weight.  root and root_to: weight and goal of the root's arc for each word.  All other arcs are
    found by `key`, state * words + word, in order; weight and to are theirs.
    """

    def __init__(self, block: Block, grams: list[tuple[np.ndarray, np.ndarray]], totals: list[np.ndarray], w: Weights):
        """totals: for each order, the corpus count of each distinct n-gram of the block."""
        self.block, self.order, self.words = block, len(grams), max(1, len(block.words))
        counts = [t.astype(np.float64) for t in totals]
        seen = counts[0] > 0
        p = np.where(seen, np.maximum(counts[0] - w.discount, 1e-9) / max(w.n, 1), w.unknown)
        base = np.cumsum([2, *map(len, counts[:-1])]).tolist()
        self.root = np.log10(p)
        self.root_to = np.where(seen & (self.order > 1), base[0] + np.arange(len(seen)), 0)
        # As many texts were learned as ends, so as many starts.
        starts = float(counts[0][0]) if len(seen) else 0.0
        self.fall, self.fall_to = np.zeros(base[-1]), np.zeros(base[-1], np.int64)
        mass = lambda count, n: MASS * np.maximum(count, 1.0) ** w.power[n - 1]
        # States by the length of their context; those that weren't learned are never entered.
        if self.order > 1:
            self.fall[1] = np.log10(mass(starts, 1) / (starts + mass(starts, 1)))
        keys, weights, goals = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for n in range(1, self.order):
            # Any place of each n-gram: its own goal, and its suffix, are the same at all of them.
            m = mass(counts[n - 1], n)
            span = slice(base[n - 1], base[n - 1] + len(m))
            self.fall[span] = np.log10(m / (counts[n - 1] + m))
            if n > 1:
                at = self._places(grams[n - 1])
                self.fall_to[span] = base[n - 2] + grams[n - 2][1][at]
            at = self._places(grams[n])
            taken = np.flatnonzero(counts[n] > 0)
            at = at[taken]
            opens = (block.known[at] == n) & (np.repeat(block.skips == 0, block.lengths)[at]) if n == 1 else np.zeros(len(at), bool)
            before = grams[n - 1][1][np.maximum(at - 1, 0)]
            context = np.where(opens, starts, counts[n - 1][before])
            m = mass(context, n)
            longer = np.zeros(len(counts[n]))
            longer[taken] = (counts[n][taken] + m * p[grams[n - 1][1][at]]) / (context + m)
            p = longer
            keys.append(np.where(opens, 1, base[n - 1] + before) * self.words + block.ids[at])
            weights.append(np.log10(p[taken]))
            goals.append(base[n] + taken if n < self.order - 1 else base[n - 1] + grams[n - 1][1][at])
        key = np.concatenate(keys)
        rank = np.argsort(key)
        self.key, self.weight, self.to = key[rank], np.concatenate(weights)[rank], np.concatenate(goals)[rank]

    @staticmethod
    def _places(gram: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each distinct n-gram a position where it ends."""
        keys, number = gram
        out = np.zeros(len(keys), np.int64)
        there = np.flatnonzero(number >= 0)
        out[number[there]] = there
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) of a word in each of several states."""
        state, gained = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            here, now = state[left], word[left]
            at_root = here == 0
            done = left[at_root]
            gained[done] += self.root[now[at_root]]
            state[done] = self.root_to[now[at_root]]
            left, here, now = left[~at_root], here[~at_root], now[~at_root]
            if not len(left):
                break
            key = here * self.words + now
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
            gained[left[hit]] += self.weight[at[hit]]
            state[left[hit]] = self.to[at[hit]]
            left, here = left[~hit], here[~hit]
            gained[left] += self.fall[here]
            state[left] = self.fall_to[here]
        return state, gained

    def traverse(self, lane: int = LANE) -> np.ndarray:
        """log10 probability of each token, texts abreast, each from left to right with its state.

        A piece longer than a lane is read in several, each but a text's first from its context on.
        """
        block, out = self.block, np.zeros(len(self.block.ids))
        cuts = [np.arange(skip, n, lane) for skip, n in zip(block.skips.tolist(), block.lengths.tolist(), strict=True)]
        piece = np.repeat(np.arange(len(cuts)), [len(x) for x in cuts])
        place = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        warm = np.minimum(self.order - 1, place)
        opens = (place == warm) & (block.skips[piece] == 0) & (self.order > 1)
        begin = block.starts[piece] + place - warm
        stop = block.starts[piece] + np.minimum(place + lane, block.lengths[piece])
        # Longest first, so that those still being read are the first ones.
        rank = np.argsort(begin - stop, kind="stable")
        begin, stop, warm, state = begin[rank], stop[rank], warm[rank], opens[rank].astype(np.int64)
        sizes = stop - begin
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))
            at = begin[:n] + t
            state[:n], gained = self.step(state[:n], block.ids[at])
            own = t >= warm[:n]
            out[at[own]] = gained[own]
        return out


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, w: Weights):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        row = table.slice(0, 1).to_pylist()[0]
        block = _read(row)
        answers = [_unpress(x) for x in table["totals"].to_pylist()[1:]]
        grams = block.grams(order)
        sizes = np.cumsum([len(k) for k, _ in grams])
        totals = np.empty(sizes[-1], np.uint64)
        if sum(map(len, answers)) != len(totals):
            raise ValueError("a block's answers are not all there")
        totals[np.argsort(np.concatenate([k for k, _ in grams]), kind="stable")] = np.concatenate(answers)
        by_order = np.split(totals, sizes[:-1])
        add = lambda x: np.add.reduceat(np.where(block.own, x, 0), block.starts)
        known = (by_order[0] > 0).astype(np.int64)[block.ids]
        base = np.log10((by_order[0].astype(np.float64) + 0.5) / (w.n + 0.5 * (w.v + 1)))[block.ids]
        doc_ids = pa.ipc.open_stream(row["doc_ids"]).read_all()["doc_id"]
        score = add(Automaton(block, grams, by_order, w).traverse())
        return pa.table({"row": _unpress(row["rows"]), "doc_id": doc_ids, "held_out": ~block.train, "n_tokens": block.lengths - block.skips, "n_known": add(known), "train_tokens": np.full(len(score), w.n, np.int64), "base_score": add(base), "score": score})

    return run


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned outside the fold.

    order: 1 to 7 words of an n-gram.
    """
    if not 1 <= order <= int(_ORDER_BITS):
        raise ValueError(f"no n-grams of {order} words")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (bucket_of(F.col(id_col), folds) == fold).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    blocks = written(rows.mapInArrow(_to_blocks(BLOCK, order), _BLOCKS), "lm-blocks")
    packets = blocks.mapInArrow(_to_packets(shards, order), _PACKETS)
    answers = written(packets.groupBy("shard").applyInArrow(_add_up(order), _TOTALS), "lm-totals")
    sums = np.zeros(order * (4 + len(_POWERS)))
    for r in answers.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        sums[r["pos"]] = r["n"]
    weights = Weights(sums.reshape(order, -1))
    texts = blocks.withColumn("shard", F.lit(-1)).withColumn("totals", F.lit(None).cast("binary"))
    found = answers.where("block is not null").select("block", "shard", "totals")
    pieces = texts.unionByName(found, allowMissingColumns=True).groupBy("block").applyInArrow(_score(order, weights), _SCORES)
    once = [F.first(c).alias(c) for c in ("doc_id", "held_out", "train_tokens")]
    summed = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return pieces.groupBy("row").agg(*once, *summed).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
