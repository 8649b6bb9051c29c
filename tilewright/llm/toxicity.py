"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: its words, lower case, and their first four, five and
six letters.  The score is a bias, a weight for each term, and for each pair of terms the inner
product of their factors, so an insult beside a mention of a group can count for more than both
alone.  Weights are learned on the driver from at most `per_class` labelled rows of each class;
the model has at most `terms` terms, whatever the size of the corpus.

Defined results: null and empty texts score the bias alone; if labels of only one class (or none)
can be learned from, every score is 0; repeated rows score alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bucket_of, forget_shuffles, give_back, slices, small_batches, texts
from tilewright.llm.sampling import labelled

BITS = 20
PREFIXES = (4, 5, 6)
_words = re.compile(r"\w+").findall


def terms_of(word: str) -> list[int]:
    """Hashed terms of a lower-case word."""
    raw = [word.encode(), *((word[:n] + "*").encode() for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x) & ((1 << BITS) - 1) for x in raw]


class Terms:
    """Texts to arrays of term numbers; a word's terms are kept for a bounded number of words."""

    def __init__(self, number: np.ndarray | None = None, keep: int = 100_000):
        self.number = number  # hashed term -> number in the model or -1; None: hashes themselves
        self.keep = keep
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> np.ndarray:
        out: set[int] = set()
        known = self.known
        for word in set(_words(text.lower())):
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.keep:
                    known.clear()
                ids = terms_of(word)
                if self.number is not None:
                    ids = [i for i in self.number[ids].tolist() if i >= 0]
                ids = known[word] = tuple(ids)
            if ids:
                out.update(ids)
        return np.fromiter(out, np.int64, len(out))


def alone(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far each term tells the classes apart: standard errors of the log ratio, or the root of the
    likelihood ratio if more, which doesn't level off for a rare term of one class only."""
    share = (seen + 0.5) / (n[:, None] + 1.0)
    errors = np.abs(np.log(share[1] / share[0])) / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    due = seen.sum(axis=0) * (n / n.sum())[:, None]
    gain = (seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-12))).sum(axis=0)
    return np.maximum(errors, np.sqrt(2 * np.maximum(gain, 0.0)))


def in_pairs(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, n: np.ndarray, paired: float, block: int = 512) -> np.ndarray:
    """For each term the most standard errors by which rows with it and another term differ from what both say alone.

    All pairs of terms are counted that are in as many rows as it takes, with classes of one size, to
    come to `paired`: blocks of a 0/1 matrix, kept as bits, times each other.
    """
    out = np.zeros(seen.shape[1])
    often = np.flatnonzero(seen.sum(axis=0) >= paired * paired)
    number = np.full(seen.shape[1], -1, np.int64)
    number[often] = np.arange(len(often))
    bits = []
    for c in (0, 1):
        of = [x[x >= 0] for x in (number[rows[i]] for i in np.flatnonzero(labels == c).tolist())]
        held = np.zeros((len(often), -(-len(of) // 8)), np.uint8)
        for i, x in enumerate(of):
            held[x, i // 8] |= np.uint8(128 >> i % 8)
        bits.append(held)
    log_odds = np.log((seen[1, often] + 0.5) / (seen[0, often] + 0.5))
    spread = 1 / (seen[1, often] + 0.5) + 1 / (seen[0, often] + 0.5)
    best = np.zeros(len(often))
    for lo in range(0, len(often), block):
        left = [np.unpackbits(x[lo : lo + block], axis=1).astype(np.float32) for x in bits]
        for at in range(lo, len(often), block):
            a, b = slice(lo, lo + block), slice(at, at + block)
            count = [x @ np.unpackbits(y[b], axis=1).astype(np.float32).T for x, y in zip(left, bits, strict=True)]
            both = count[0] + count[1]
            # What both terms say alone, and how uncertain that is.
            p = 1 / (1 + np.exp(np.log(n[1] / n[0]) - log_odds[a, None] - log_odds[None, b]))
            wide = both * p * (1 - p)
            z = np.abs(count[1] - both * p) / np.sqrt(np.maximum(wide + wide * wide * (spread[a, None] + spread[None, b]), 0.25))
            z[both < paired * paired] = 0.0
            if at == lo:
                np.fill_diagonal(z, 0.0)
            best[a] = np.maximum(best[a], z.max(axis=1))
            best[b] = np.maximum(best[b], z.max(axis=0))
    out[often] = best
    return out


class FactorizationMachine:
    """bias + sum of weights + sum over pairs of <factor, factor>, through a logistic."""

    def __init__(self, hashed: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.hashed, self.bias, self.weight, self.factor = hashed, bias, weight, factor

    def numbers(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int64)
        out[self.hashed] = np.arange(len(self.hashed))
        return out

    def score(self, ids: np.ndarray) -> float:
        v = self.factor[ids]
        s = v.sum(axis=0)
        z = self.bias + self.weight[ids].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, terms: int = 30_000, factors: int = 4, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, least: int = 3, clear: float = 2.5, paired: float = 5.5, batch: int = 128) -> FactorizationMachine:
        """Minibatches in a fixed order with per-weight step sizes; of terms seen in `least` rows those stay
        that tell the classes apart, alone by `clear` standard errors or with another term by `paired`."""
        size = 1 << BITS
        seen = np.zeros((2, size), np.int64)
        for ids, y in zip(rows, labels.tolist(), strict=True):
            seen[y, ids] += 1
        n = np.bincount(labels, minlength=2)
        if n.min() == 0:
            return cls(np.zeros(0, np.int64), -40.0, np.zeros(0), np.zeros((0, factors)))
        # Of a million hashed terms few are in `least` rows; only these are judged.
        enough = np.flatnonzero(seen.sum(axis=0) >= least)
        apart = np.full(size, -1.0)
        apart[enough] = alone(seen[:, enough], n)
        if clear > 0:
            # A term that says nothing alone counts as much as its clearest pair, on the same scale.
            together = in_pairs(rows, labels, seen, n, paired)
            apart[enough] = np.maximum(apart[enough], np.where(together[enough] >= paired, together[enough], 0.0))
        apart[apart < clear] = -1.0
        del seen
        hashed = np.sort(np.argsort(-apart, kind="stable")[:terms])
        hashed = hashed[apart[hashed] >= 0]
        model = cls(hashed, float(np.log(n[1] / n[0])), np.zeros(len(hashed)), np.zeros((len(hashed), factors)))
        number = model.numbers()
        rng = np.random.default_rng(7)
        model.factor[:] = rng.normal(0, 0.01, model.factor.shape)
        kept = [x[x >= 0].astype(np.int32) for x in (number[ids] for ids in rows)]
        gw, gv, gb = np.full(len(hashed), 1e-8), np.full(model.factor.shape, 1e-8), 1e-8
        for _ in range(epochs):
            order = rng.permutation(len(kept))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                lengths = np.array([len(kept[i]) for i in some])
                ids = np.concatenate([kept[i] for i in some]) if lengths.sum() else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(some)), lengths)
                v = model.factor[ids]
                s = np.stack([np.bincount(row, v[:, f], len(some)) for f in range(factors)], axis=1)
                z = model.bias + np.bincount(row, model.weight[ids], len(some)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (v * v).sum(1), len(some)))
                d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]
                used, at = np.unique(ids, return_inverse=True)
                w = np.bincount(at, d[row], len(used)) / len(some) + l2 * model.weight[used]
                each = d[row][:, None] * (s[row] - v)
                u = np.stack([np.bincount(at, each[:, f], len(used)) for f in range(factors)], axis=1) / len(some) + l2 * model.factor[used]
                gw[used] += w * w
                gv[used] += u * u
                gb += float(d.mean()) ** 2
                model.weight[used] -= rate * w / np.sqrt(gw[used])
                model.factor[used] -= 0.3 * rate * u / np.sqrt(gv[used])
                model.bias -= rate * float(d.mean()) / gb**0.5
        return model


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in small_batches(batches):
        ids = [np.sort(terms.of(x)) for x in texts(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32())), batch["label"]], names=["doc_id", "terms", "label"])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_class: int = 4000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """A model from at most per_class labelled rows of each class outside the fold.

    Terms are hashed where the texts are; the driver gets hashed terms only.
    """
    sample = labelled(docs, labels, label_col, per_class, folds, fold, id_col, text_col)
    kind = dict(sample.dtypes)["doc_id"]
    table = sample.mapInArrow(_hash_rows, f"doc_id {kind}, terms array<int>, label int").toArrow().sort_by("doc_id")
    flat = table["terms"].combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    # Views, and the fit's tables go back to the system: later stages share this process and its limit.
    rows = [values[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
    forget_shuffles(docs.sparkSession)
    model = FactorizationMachine.fit(rows, table["label"].to_numpy().astype(np.int64))
    del rows, values, flat, table
    give_back()
    return model


def score_column(model: FactorizationMachine, text: Column) -> Column:
    """The score (0 to 1) of a text column."""
    state: dict[str, Terms] = {}

    @F.arrow_udf("double")
    def score(array: pa.Array) -> pa.Array:
        if "terms" not in state:
            state["terms"] = Terms(model.numbers())
        return pa.array([model.score(state["terms"].of(x)) for part in slices(array) for x in texts(part)], pa.float64())

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels, folds, fold, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col), folds) == fold).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
