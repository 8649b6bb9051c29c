"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it to the end.  Bytes are
embedded; learned filters slide over each chunk; each filter's largest response in a chunk is
its feature (max pooling).  Over a document's chunks the mean and the maximum of these features,
and how full its chunks are, go through one hidden layer to one probability.

The network is fitted on the driver on at most `per_class` labelled rows of each class, whole
texts.  Only the windows that win the pooling get gradients, so a step costs little more than
scoring.

Defined results: null and empty texts are one chunk of blanks; if labels of only one class (or
none) can be learned from, every score is 0.5; repeated rows score alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bucket_of, slices, text_bytes
from tilewright.llm.sampling import labelled

CHUNK, OVERLAP = 256, 16
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 24, 16
_STEP = CHUNK - OVERLAP
_WINDOWS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks as rows of CHUNK bytes, number of the text of each, share of each text's chunks that it fills)."""
    parts, owner, fill = [], [], []
    for i, text in enumerate(texts):
        n = max(1, -(-max(len(text) - OVERLAP, 1) // _STEP))
        padded = text.ljust(n * _STEP + OVERLAP, b" ")
        flat = np.frombuffer(padded, np.uint8)
        parts.append(np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (_STEP, 1)))
        owner += [i] * n
        fill.append(len(text) / len(padded))
    return np.concatenate(parts), np.array(owner, np.int64), np.array(fill, np.float32)


class ByteConvNet:
    """Parameters as arrays in `p`; score(texts) gives probabilities."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.p = {
            "embed": draw(256, EMBED) * 0.5,
            "filter": draw(WIDTH * EMBED, FILTERS) * (1.4 / (WIDTH * EMBED) ** 0.5),
            "fbias": np.zeros(FILTERS, np.float32),
            "hidden": draw(2 * FILTERS + 1, HIDDEN) * (1.4 / (2 * FILTERS) ** 0.5),
            "hbias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN) * 0.1,
            "obias": np.zeros(1, np.float32),
        }

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response in each chunk, and the window it came from."""
        p, best, at = self.p, [], []
        for lo in range(0, len(rows), 64):
            x = p["embed"][rows[lo : lo + 64]]
            s = x.strides
            windows = np.lib.stride_tricks.as_strided(x, (len(x), _WINDOWS, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2]))
            y = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ p["filter"]
            y = y.reshape(len(x), _WINDOWS, FILTERS)
            best.append(y.max(axis=1))
            if where:
                at.append(y.argmax(axis=1))
        return np.maximum(np.concatenate(best) + p["fbias"], 0), np.concatenate(at) if where else None

    @staticmethod
    def _join(h: np.ndarray, owner: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.searchsorted(owner, np.arange(len(fill)))
        sizes = np.diff(np.r_[starts, len(owner)])
        top = np.maximum.reduceat(h, starts, axis=0)
        mean = np.add.reduceat(h, starts, axis=0) / sizes[:, None]
        return np.concatenate([mean, top, fill[:, None]], axis=1).astype(np.float32), starts, sizes

    def _head(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.maximum(d @ self.p["hidden"] + self.p["hbias"], 0)
        z = a @ self.p["out"] + self.p["obias"][0]
        return a, 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, owner, fill = chunks(texts)
        h, _ = self.pooled(rows)
        d, _, _ = self._join(h, owner, fill)
        return self._head(d)[1].astype(np.float64)

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        rows, owner, fill = chunks(texts)
        h, at = self.pooled(rows, where=True)
        d, _, sizes = self._join(h, owner, fill)
        a, prob = self._head(d)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dz = ((prob - labels) * weights / len(texts)).astype(np.float32)
        g["out"], g["obias"] = a.T @ dz, dz.sum(keepdims=True)
        da = dz[:, None] * p["out"] * (a > 0)
        g["hidden"], g["hbias"] = d.T @ da, da.sum(axis=0)
        dd = da @ p["hidden"].T
        dh = (dd[:, :FILTERS] / sizes[:, None])[owner] + dd[:, FILTERS:-1][owner] * (h == d[owner, FILTERS:-1])
        dh = (dh * (h > 0)).astype(np.float32)
        g["fbias"] = dh.sum(axis=0)
        # The winning windows: bytes of each, for each chunk and filter.
        place = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
        won = rows[np.arange(len(rows))[:, None, None], place]
        x = p["embed"][won].reshape(len(rows), FILTERS, -1)
        g["filter"] = np.einsum("cf,cfx->xf", dh, x)
        dx = (dh[:, :, None] * p["filter"].T[None]).reshape(-1, EMBED)
        flat = won.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, dx[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.004) -> ByteConvNet:
        """Adam over minibatches in a fixed order; both classes weigh the same."""
        n = np.bincount(labels, minlength=2)
        if n.min() == 0:
            self.p["out"][:] = 0
            return self
        weight = (len(labels) / (2 * n))[labels]
        rng = np.random.default_rng(11)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                g = self.gradients([texts[i] for i in some], labels[some], weight[some])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    x -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_class: int = 1500, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> ByteConvNet:
    """A network from at most per_class labelled rows of each class outside the fold."""
    rows = sorted((r["doc_id"], (r["text"] or "").encode(), r["label"]) for r in labelled(docs, labels, label_col, per_class, folds, fold, id_col, text_col).toLocalIterator())
    return ByteConvNet().fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))


def score_column(model: ByteConvNet, text: Column) -> Column:
    """The score (0 to 1) of a text column."""

    @F.arrow_udf("double")
    def score(array: pa.Array) -> pa.Array:
        # Few texts at a time: a long one is many chunks.
        out = [model.score(text_bytes(part)) for part in slices(array, 32)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels, folds, fold, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col), folds) == fold).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
