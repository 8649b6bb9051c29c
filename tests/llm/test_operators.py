"""Each operator against brute force on small tables, and on odd rows."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import CLASHING, clashing, odd_texts, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import bpe, common, exact_dedup, fingerprints, langid, line_dedup, lm, minhash, ngram_join, packing, quality, queries, toxicity, union_find
from tilewright.llm.common import bucket_of, written
from tilewright.llm.mph import PerfectHash
from tilewright.llm.union_find import components

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


# Perfect hash, union-find ------------------------------------------------------------------------


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal(keys):
    a = np.array(sorted(keys), np.uint64)
    b = a ^ np.uint64(12345)
    mph = PerfectHash.load(PerfectHash.build(a, b).dump())
    assert sorted(mph.slots(a, b).tolist()) == list(range(len(a)))
    other = np.setdiff1d(a + np.uint64(1), a)
    assert all(-1 <= s < max(len(a), 1) for s in mph.slots(other, other).tolist())


def test_perfect_hash_refuses_repeats():
    with pytest.raises(ValueError):
        PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, int(x)) for x in rng.integers(101, 200, 60)] + [(300, 300)] + [tuple(map(int, rng.integers(400, 500, 2))) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    tied = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in tied}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_need_rounds_only_if_large(spark, monkeypatch):
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(500, 600)] * 2
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    mark = common.tables()
    once = {tuple(r) for r in components(frame).collect()}
    assert common.tables() == mark + 1
    # The same by rounds, from stars that several tasks give.
    monkeypatch.setattr(union_find, "_HELD", 0)
    by_rounds = components(frame).collect()
    assert common.tables() > mark + 2 and {tuple(r) for r in by_rounds} == once and len(by_rounds) == len(once)


def test_small_tables_are_few_files(spark):
    rows = spark.range(0, 2500, 1, 50).repartition(40, "id")
    few = written(common.in_files(rows, 2500, 1000), "few")
    assert len(few.inputFiles()) <= 3 and few.count() == 2500 == few.distinct().count()
    assert common.in_files(rows, 0).rdd.getNumPartitions() == 1


# Packing -----------------------------------------------------------------------------------------


def _check_packed(got, ids, size):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(ids[doc])
        assert all(r["length"] == size for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[doc][r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_seq)


def test_packing_keeps_every_id(spark, rows, docs):
    tokenizer = Tokenizer.from_file(JSON)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    n = _check_packed(packing.pack_documents(docs, JSON, 2048).collect(), ids, 2048)
    least = -(-sum(map(len, ids.values())) // 2048)
    assert least <= n <= math.ceil(1.02 * least) + 1


def test_packing_odd_rows(spark):
    texts = odd_texts()
    tokenizer = Tokenizer.from_file(JSON)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    _check_packed(packing.pack_documents(clashing(table(spark, texts)), JSON, 512).collect(), ids, 512)
    twice = packing.pack_documents(table(spark, ["a", "a", "b"], ids=[1, 1, None]), JSON).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1
    assert packing.pack_documents(table(spark, []), JSON).count() == 0


def test_packing_added_tokens(spark):
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, end * 3, f"a  {end}  b\n{end}\n", f"it{end}'s {end[:-1]} <|end {end.upper()} |>{end}<|", f"caf\u00e9{end}12{end} 12 \u65e5{end}\u672c", f"  {end}\t\t"]
    tokenizer = Tokenizer.from_file(JSON)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert all(50256 in x for x in ids.values())
    assert all(packing.byte_level_encoder(JSON).encode(t, allowed_special="all") + [0] == ids[i] for i, t in enumerate(texts))
    _check_packed(packing.pack_documents(table(spark, texts), JSON, 16).collect(), ids, 16)


@given(st.lists(st.integers(1, 100), max_size=200), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_bins_hold_what_fits(lengths, open_bins):
    lengths = np.array(lengths, np.int64)
    bins = packing.pack(lengths, 100, open_bins)
    assert len(bins) == len(lengths)
    if len(lengths):
        assert np.bincount(bins, lengths).max() <= 100


def test_fullest_bin_closes_first():
    p = packing.Packer(10, 2)
    first, second, third = p.add(0, 7), p.add(1, 6), p.add(2, 8)
    assert (first, second, third) == (0, 1, 2) and set(p.held) == {1, 2}
    assert p.add(3, 2) == 2 and p.add(4, 4) == 1


# BPE ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own_bpe():
    return bpe.BytePairEncoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, keep=500)


def test_bpe_of_texts(rows, own_bpe, reference_bpe):
    for _, text in rows:
        ids = own_bpe.encode(text)
        assert ids == reference_bpe.encode_ordinary(text) and own_bpe.decode(ids) == text.encode()


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_of_any_text(own_bpe, reference_bpe, text):
    assert own_bpe.encode(text) == reference_bpe.encode_ordinary(text)


def test_bpe_splits_like_the_library(own_bpe, reference_bpe):
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    text = [f"a{c}1{c} {c}b  {c}" for c in every]
    wrong = [c for c, t in zip(every, text, strict=True) if own_bpe.encode(t) != reference_bpe.encode_ordinary(t)]
    assert not wrong


def test_bpe_digests(spark, reference_bpe):
    texts = odd_texts()
    got = bpe.digest(clashing(table(spark, texts)), RANKS).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = reference_bpe.encode_ordinary(t or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    full = bpe.encode(table(spark, ["a b", None]), RANKS).orderBy("doc_id").collect()
    assert full[0]["ids"] == reference_bpe.encode_ordinary("a b") and full[1]["ids"] == [] and full[0]["decoded"] == b"a b"
    assert bpe.digest(table(spark, []), RANKS).count() == 0


# Fingerprints ------------------------------------------------------------------------------------


def _pieces(text):
    """Multiset of pieces, as (piece, number among its equals)."""
    seen, out = collections.Counter(), set()
    for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
        for p in re.findall(r"[^\n]{1,64}\n?|\n", line):
            out.add((p, seen[p]))
            seen[p] += 1
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _check_fingerprints(got, texts):
    n = len(texts)
    for k, r in enumerate(got):
        own, following = texts[k] or "", texts[(k + 1) % n] or ""
        q = len(own) // 4
        new = own[: len(own) - q] + following[:q]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(_jaccard(_pieces(own), _pieces(new)))
        assert r["near_next"] == pytest.approx(_jaccard(_pieces(own), _pieces(following)))
        assert (r["n_gone"], r["n_new"]) == (len(_pieces(own) - _pieces(new)), len(_pieces(new) - _pieces(own)))
    # The fingerprints that are returned give the likenesses by themselves.
    stored = [r["fingerprint"] for r in got]
    assert fingerprints.compare(stored, [r["edited_fingerprint"] for r in got]) == pytest.approx([r["near_edited"] for r in got])
    assert fingerprints.compare(stored, [*stored[1:], *stored[:1]]) == pytest.approx([r["near_next"] for r in got])


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_versions(docs).orderBy("doc_id").collect()
    _check_fingerprints(got, [t for _, t in rows])
    by_text = collections.defaultdict(set)
    for r, (_, t) in zip(got, rows, strict=True):
        by_text[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in got]) > 0.4 > 10 * np.mean([r["near_next"] for r in got])


def test_fingerprints_odd_rows(spark):
    texts = odd_texts()
    got = fingerprints.fingerprint_versions(clashing(table(spark, texts).repartition(3))).orderBy("doc_id").collect()
    _check_fingerprints(got, texts)
    one = fingerprints.fingerprint_versions(table(spark, ["alone here"], ids=[None])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = fingerprints.fingerprint_versions(table(spark, ["a line", "a line", "b", "c\nd"], ids=[1, 1, None, 1])).collect()
    assert [r["doc_id"] for r in rows].count(1) == 3 and len(rows) == 4
    assert sorted(r["near_next"] for r in rows if r["doc_id"] == 1)[-1] == 1.0
    assert fingerprints.fingerprint_versions(table(spark, [])).count() == 0


def test_sketch_differences_are_the_digests():
    rng = np.random.default_rng(2)
    for n, m, both in ((0, 0, 0), (3, 2, 40), (0, 7, 500), (300, 250, 0), (40, 900, 10)):
        draw = rng.integers(0, 2**63, n + m + both).astype(np.uint64)
        one, two = np.r_[draw[:n], draw[n + m :]], draw[n:]
        a, b = (fingerprints.Sketches.of(x, np.array([0, len(x)])) for x in (one, two))
        _, keys, sign = fingerprints.differences(a, b)
        assert set(keys[sign == 1].tolist()) == set(draw[:n].tolist()) and set(keys[sign == -1].tolist()) == set(draw[n : n + m].tolist())
        parsed = fingerprints.Sketches.parse(a.strings())
        assert parsed.strings() == a.strings() and parsed.peel()[0].all()


def test_fingerprints_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4000)
    texts = [f"text {i} " * (i % 9) for i in range(5000)]
    got = fingerprints.fingerprint_versions(table(spark, texts, ids=[i * 7 - 9000 for i in range(5000)])).orderBy("doc_id").collect()
    _check_fingerprints(got, texts)


# Exact dedup -------------------------------------------------------------------------------------


def _check_dedup(got, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((-1 if i is None else i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup(spark, docs, rows):
    _check_dedup(exact_dedup.exact_dedup(docs).collect(), rows)
    texts = odd_texts()
    _check_dedup(exact_dedup.exact_dedup(clashing(table(spark, texts))).collect(), list(enumerate(texts)))
    _check_dedup(exact_dedup.exact_dedup(table(spark, ["a", "a", "b", "c", "c"], ids=[1, 1, None, None, None])).collect(), [(1, "a"), (1, "a"), (None, "b"), (None, "c"), (None, "c")])
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_hot_text_over_salted_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 64)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 100)
    texts = ["hot"] * 1000 + [f"t{i % 700}" for i in range(1500)]
    _check_dedup(exact_dedup.exact_dedup(table(spark, texts)).collect(), list(enumerate(texts)))


def test_exact_dedup_nonmembers_group_separately(spark):
    old, new = table(spark, ["a", "b", "b"]), table(spark, ["b", "c", "c", "d"], ids=[10, 11, 12, 13])
    index = exact_dedup.build_index(exact_dedup.digests(old))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(exact_dedup.digests(new), index).collect()}
    assert got == {10: (2, 2), 11: (12, 2), 12: (12, 2), 13: (13, 1)}


# Classifiers -------------------------------------------------------------------------------------


def _accuracy(got, truth):
    held = [(r["predicted"], r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    return np.mean([p == y for p, _, y in held]), held


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    # Two terms each harmless, toxic together; the rest is noise.
    x = [np.array([t for t, on in ((1, a), (2, b)) if on] + rng.integers(10, 200, 8).tolist()) for a, b in rng.integers(0, 2, (3000, 2))]
    y = np.array([int(1 in t[:2] and 2 in t[:2]) for t in x])
    model = toxicity.FactorizationMachine.fit([np.unique(t) for t in x], y, clear=-1.0, least=0, epochs=30, l2=1e-5)
    number = model.numbers()
    score = lambda *t: model.score(np.array([number[i] for i in t]))
    assert score(1, 2) > 0.5 > max(score(1), score(2))


def test_toxicity_learns_pairs_that_say_nothing_alone():
    rng = np.random.default_rng(1)
    # Each term is as frequent in both classes; toxic are both together, or neither.
    x = [np.unique([t for t, on in ((1, a), (2, b)) if on] + rng.integers(10, 200, 8).tolist()) for a, b in rng.integers(0, 2, (4000, 2))]
    y = np.array([int((1 in t) == (2 in t)) for t in x])
    model = toxicity.FactorizationMachine.fit(x, y)
    number = model.numbers()
    assert (number[[1, 2]] >= 0).all()
    score = lambda *t: model.score(number[list(t)])
    assert score(1, 2) > 0.5 > max(score(1), score(2))


def test_toxicity_keeps_rare_words_of_one_class():
    rng = np.random.default_rng(1)
    rows = [np.unique([*([5] if i < 16 and i % 2 else []), *rng.integers(10, 200, 8)]) for i in range(2000)]
    model = toxicity.FactorizationMachine.fit(rows, np.arange(2000) % 2)
    assert model.weight[model.numbers()[5]] > 0 <= model.numbers()[5]


def test_toxicity(spark, docs, labels):
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    accuracy, _ = _accuracy(got, truth)
    assert accuracy > 0.8


def test_quality(spark, docs, labels):
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    accuracy, _ = _accuracy(got, truth)
    assert accuracy > 0.75


def _terms_by_hand(text):
    out = set()
    for word in re.findall(r"\w+", text.lower()):
        out |= {word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)}
    return {zlib.crc32(x.encode()) % 2**20 for x in out}


def test_toxicity_scores_by_all_pairs(docs, labels, rows):
    """Each score against the sum over single terms and over every pair of them."""
    model = toxicity.learn(docs, labels)
    number = model.numbers()
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    for i, text in rows[:60]:
        ids = [number[t] for t in _terms_by_hand(text or "") if number[t] >= 0]
        z = model.bias + sum(model.weight[k] for k in ids) + sum(float(model.factor[a] @ model.factor[b]) for a, b in itertools.combinations(ids, 2))
        want = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(want >= 0.5)


def _network_by_hand(p, text):
    """The network of quality.py, one window at a time."""
    step = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-max(len(text) - quality.OVERLAP, 1) // step))
    padded = text.ljust(n * step + quality.OVERLAP, b" ")
    pooled = []
    for c in range(n):
        chunk = padded[c * step : c * step + quality.CHUNK]
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            x = np.concatenate([p["embed"][b] for b in chunk[at : at + quality.WIDTH]])
            best = np.maximum(best, x @ p["filter"])
        pooled.append(np.maximum(best + p["fbias"], 0))
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0), [len(text) / len(padded)]])
    z = np.maximum(features @ p["hidden"] + p["hbias"], 0) @ p["out"] + p["obias"][0]
    return 1 / (1 + math.exp(-z))


def test_quality_scores_by_every_window(docs, labels, rows):
    model = quality.learn(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    short = [(i, t) for i, t in rows if len(t or "") < 4000][:25]
    for i, text in short:
        assert got[i]["score"] == pytest.approx(_network_by_hand(model.p, (text or "").encode()), abs=1e-3)


def test_contradicting_labels_and_repeated_ids_are_defined(spark):
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 0][:4]
    marks = spark.createDataFrame([(learned[0], 0), (learned[0], 1), (learned[1], 0), (learned[2], None), (None, 1)], "doc_id long, toxic int")
    twice = table(spark, ["b text", "a text", "c", "d", "e"], ids=[learned[0], learned[0], learned[1], learned[2], None])
    for parts in (1, 3):
        got = toxicity.labelled(twice.repartition(parts), marks.repartition(parts), "toxic", 10, 5, 0).collect()
        assert sorted(tuple(r) for r in got) == sorted([(learned[0], "a text", 1), (learned[1], "c", 0)])


def test_scores_do_not_depend_on_other_columns_or_rows(spark, docs, labels):
    model = quality.learn(docs, labels)
    texts = odd_texts()
    score = lambda df, m: {r[0]: r[1] for r in df.select("doc_id", m(df["text"]).alias("s")).collect()}
    a = score(clashing(table(spark, texts)), lambda c: quality.score_column(model, c))
    b = score(table(spark, texts).repartition(5), lambda c: quality.score_column(model, c))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-5) for k in a)
    fm = toxicity.learn(docs, labels)
    c = score(clashing(table(spark, texts)), lambda c: toxicity.score_column(fm, c))
    assert set(c) == set(range(len(texts))) and c[0] == c[1] and c[6] == c[7]


def test_sample_is_bounded(spark):
    from tilewright.llm.sampling import labelled

    docs = table(spark, ["t"] * 50, ids=[7] * 40 + list(range(100, 110)))
    marks = spark.createDataFrame([(i, i % 2) for i in (7, *range(100, 110), 7)], "doc_id long, toxic int")
    got = labelled(docs, marks, "toxic", 3, 5, 0).collect()
    assert len(got) <= 6 and len({r["doc_id"] for r in got}) == len(got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in got)


def test_no_labels(spark, labels):
    none = labels.limit(0)
    texts = table(spark, ["a b", None])
    assert {r["score"] for r in quality.score_documents(texts, none).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.score_documents(texts, none).collect()) < 1e-6
    assert toxicity.score_documents(table(spark, []), none).count() == 0 == quality.score_documents(table(spark, []), none).count()


def test_convolution_gradients():
    rng = np.random.default_rng(2)
    net = quality.ByteConvNet(seed=1)
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (5, 300, 900)]
    y, w = np.array([0, 1, 1]), np.ones(3)
    loss = lambda: float(-np.mean(np.where(y == 1, np.log(net.score(texts)), np.log(1 - net.score(texts)))))
    grads = net.gradients(texts, y, w)
    for name in ("out", "hidden", "filter", "embed", "fbias"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        k = int(np.argmax(np.abs(g)))
        old, h = flat[k], 1e-2
        flat[k] = old + h
        up = loss()
        flat[k] = old - h
        down = loss()
        flat[k] = old
        assert g[k] == pytest.approx((up - down) / (2 * h), rel=0.15, abs=1e-4)


def test_chunks_cover_everything():
    for n in (0, 1, 255, 256, 257, 1000):
        text = bytes(i % 251 for i in range(n))
        rows, owner, fill = quality.chunks([text, b"x"])
        whole = b"".join([rows[0].tobytes(), *(r.tobytes()[quality.OVERLAP :] for r in rows[1 : (owner == 0).sum()])])
        assert whole[:n] == text and 0 <= fill[0] <= 1


# Language model ----------------------------------------------------------------------------------


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class _Model:
    """The interpolated model by counting, for any order."""

    def __init__(self, texts, order):
        self.order, self.starts = order, len(texts)
        self.count = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            words = _tokens(t)
            history = ["<s>", *words]
            for i, w in enumerate(words):
                self.count[1][w] += 1
                for n in range(2, order + 1):
                    if i + 2 >= n:
                        self.count[n][tuple(history[i + 2 - n : i + 2])] += 1
        one = self.count[1]
        self.n, self.v = sum(one.values()), len(one)
        n1, n2 = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
        self.d = min(n1 / (n1 + 2 * n2), 0.95) if n1 else 0.5
        powers = np.linspace(0, 1, 41)
        self.power = [float(np.interp(len(self.count[k + 1]), [sum(c**p for c in self.count[k].values()) for p in powers], powers)) for k in range(1, order)]

    def p(self, context, w):
        if not context:
            return (self.count[1][w] - self.d) / self.n if self.count[1][w] else self.d * self.v / self.n
        shorter = self.p(context[1:], w)
        c = self.starts if context == ("<s>",) else self.count[len(context)][context if len(context) > 1 else context[0]]
        if not c:
            return shorter
        m = lm.MASS * c ** self.power[len(context) - 1]
        return (self.count[len(context) + 1][(*context, w)] + m * shorter) / (c + m)

    def score(self, text):
        words = _tokens(text)
        history = ["<s>", *words]
        return sum(math.log10(self.p(tuple(history[max(0, i + 2 - self.order) : i + 1]), w)) for i, w in enumerate(words))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, rows, monkeypatch, order):
    if order > 2:
        monkeypatch.setattr(lm, "BLOCK", 6000)
        monkeypatch.setattr(lm, "LANE", 40)
        monkeypatch.setattr(lm, "SHARD_BYTES", 100_000)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    model = _Model([t for i, t in rows if not held(i)], order)
    got = {r["doc_id"]: r for r in lm.score_documents(docs, order=order).collect()}
    assert set(got) == {i for i, _ in rows}
    one = model.count[1]
    for i, t in rows:
        words, r = _tokens(t), got[i]
        base = sum(math.log10((one[w] + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["n_tokens"] == len(words) and r["train_tokens"] == model.n
        assert r["n_known"] == sum(one[w] > 0 for w in words) and r["held_out"] == held(i)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-6)


def _automaton(learned, asked, order):
    """The operator's automaton over a block of these texts, with the block's own counts as the corpus's."""
    number, ids, lengths = {"\n": 0}, [], []
    for text in [*learned, *asked]:
        words = _tokens(text)
        words[-1] = "\n"
        ids += [number.setdefault(w, len(number)) for w in words]
        lengths.append(len(words))
    train = np.arange(len(lengths)) < len(learned)
    hashes = np.random.default_rng(0).integers(0, 2**63, len(number)).astype(np.uint64)
    block = lm.Block(np.array(ids), np.array(lengths), np.zeros(len(lengths), np.int64), hashes, train)
    grams = block.grams(order)
    own = np.repeat(train, lengths)
    totals = [np.bincount(at[own & (at >= 0)], minlength=len(k)).astype(np.uint64) for k, at in grams]
    sums = np.array([[t.sum(), (t == 1).sum(), (t == 2).sum(), (t > 0).sum(), *(t[t > 0, None].astype(float) ** lm._POWERS).sum(axis=0)] for t in totals])
    return lm.Automaton(block, grams, totals, lm.Weights(sums)), number


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_a_distribution(order):
    """From any state, the operator's own weights of all words and one for all others add up to 1."""
    learned = ["a b a c", "b b a", "c a b d", "a b a c", "d d d b a b"]
    automaton, number = _automaton(learned, ["new", "a b new c a", "c"], order)
    known = [n for w, n in number.items() if w != "new"]
    for history in (["a"], ["a", "b"], ["b", "a"], ["c", "new"], ["d", "d", "d"], ["new", "a", "b"], []):
        state = np.array([1 if order > 1 else 0])
        for w in history:
            state, _ = automaton.step(state, np.array([number[w]]))
        total = sum(10 ** automaton.step(state, np.array([n]))[1][0] for n in [*known, number["new"]])
        assert total == pytest.approx(1.0)


def test_language_model_carries_a_state():
    automaton, number = _automaton(["a b c", "a b d", "x b c"], ["a b c"], 3)
    step = lambda state, w: automaton.step(np.array([state]), np.array([number[w]]))[0][0]
    after = {h: step(step(1, h[0]), h[1]) for h in ("ab", "xb")}
    # Two words of context are told apart; one that was never seen falls to the shorter.
    assert len(set(after.values())) == 2 and step(after["ab"], "a") == step(after["xb"], "a") == step(0, "a")
    whole = automaton.traverse()
    assert all(np.allclose(automaton.traverse(lane), whole) for lane in (1, 2, 3))


def test_language_model_probabilities_of_repeated_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    got = lm.score_documents(table(spark, ["a b c"] * 60, ids=ids), order=3).collect()
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_odd_rows_and_small_blocks(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK", 50)
    monkeypatch.setattr(lm, "SHARD_BYTES", 50_000)
    texts = odd_texts()
    got = {r["doc_id"]: r for r in lm.score_documents(clashing(table(spark, texts)), order=order).collect()}
    assert set(got) == set(range(len(texts))) and all(math.isfinite(r["score"]) for r in got.values())
    assert got[0]["score"] == got[1]["score"] and got[0]["n_tokens"] == 1 and got[6]["score"] == pytest.approx(got[7]["score"])
    assert lm.score_documents(table(spark, [])).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score_documents(table(spark, ["a b"], ids=[alone])).first()
    assert r["train_tokens"] == 0 and r["score"] == 0 == r["base_score"]


# Language ----------------------------------------------------------------------------------------


def test_language(docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.95


def test_language_odd_rows(spark):
    texts = odd_texts()
    langs = ["en" if i % 2 else None for i in range(len(texts))]
    got = {r["doc_id"]: r for r in langid.identify(clashing(table(spark, texts, langs=langs))).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 4, 5))
    assert all(got[i]["lang_pred"] == "en" for i in (3, 6, 7, 8, 9, 10, 13))
    assert {r["lang_pred"] for r in langid.identify(table(spark, texts)).collect()} == {"und"}
    assert langid.identify(table(spark, [])).count() == 0


def _rank_order(text, size):
    """A text's n-grams, most frequent first: letters, lower case, runs of all else one blank."""
    plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    if not plain.strip():
        return []
    counts = collections.Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
    del counts[" "]
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), [ord(c) if c != " " else 0 for c in x[0]]))][:size]


def test_out_of_place_distance(spark):
    """Profiles, distances and predictions against counting by hand, scripts with many letters among them."""
    rng = np.random.default_rng(5)
    scripts = {"la": "abcdeghé", "ru": "абвгдежз", "zh": [chr(c) for c in range(0x4E00, 0x9000, 97)], "ja": "ひらがなカタ"}
    texts, langs = [], []
    for i in range(80):
        lang = list(scripts)[i % 4]
        letters = list(scripts[lang])
        texts.append(" ".join("".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(12)) + "! 12")
        langs.append(lang)
    size = langid.PROFILE
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80)]
    profiles = {}
    for lang in scripts:
        counts = collections.Counter()
        for t, g, h in zip(texts, langs, held, strict=True):
            if g == lang and not h:
                plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {t.lower()} "))
                counts.update(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n] != " ")
        profiles[lang] = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), [ord(c) if c != " " else 0 for c in x[0]]))][:size]
    learned = langid.learn(table(spark, texts, langs=langs).where(~(bucket_of(F.col("doc_id"), 4) == 2)))
    for row, name in zip(learned.ranks, learned.names, strict=True):
        there = np.flatnonzero(row >= 0)
        assert [langid.letters(int(c)) for c in learned.codes[there][np.argsort(row[there])]] == profiles[name]
    got = {r["doc_id"]: r for r in langid.identify(table(spark, texts, langs=langs)).collect()}
    for i, t in enumerate(texts):
        own = _rank_order(t, size)
        apart = {x: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (best, held[i]) and got[i]["score"] == pytest.approx(1 - apart[best] / (size * len(own)))


def test_letters_of_all_scripts_stay_apart():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    codes = langid._codes()[[ord(c) for c in every]]
    assert len(set(codes.tolist())) == len(every) and len(langid.grams("12 !")[0]) == 0
    found, counts = langid.grams("Ab  ab!")
    assert {langid.letters(int(c)): int(n) for c, n in zip(found, counts, strict=True)} == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2, "b a": 1}


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.learn(table(spark, ["a"] * 9, langs=[f"x{i}" for i in range(9)]))


# Near duplicates ---------------------------------------------------------------------------------


def _link_by_hand(sets, threshold=0.8):
    links, parent = collections.defaultdict(set), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    for a, b in {tuple(sorted(p)) for ks in where.values() for p in itertools.combinations(ks, 2)}:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a].add(b)
            links[b].add(a)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return links, {k: find(k) for k in sets}


def _words5(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else {()}


def _check_join(got, rows):
    links, root = _link_by_hand({i: _words5(t) for i, t in rows})
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (root[i], len(links[i])) for i, _ in rows}


def test_join(docs, rows):
    _check_join(ngram_join.join_documents(docs).collect(), rows)


def _family(n, words=60, seed=3):
    """Near copies of one text, each with a word or two changed."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.integers(0, words, 1 + k % 2):
            text[at] = f"x{k}"
        out.append(" ".join(text))
    return out


def test_join_of_a_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PART", 32)
    rows = list(enumerate([*_family(150, 120), *[f"other {i} " * 9 for i in range(40)]]))
    _check_join(ngram_join.join_documents(table(spark, [t for _, t in rows])).collect(), rows)


def test_join_odd_rows(spark):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in ngram_join.join_documents(clashing(table(spark, texts))).collect()}
    assert [got[i]["class_id"] for i in (0, 1, 2, 5)] == [0] * 4 and got[0]["n_links"] == 3
    assert got[7]["class_id"] == 6 and got[11]["class_id"] == 10 and got[3]["n_links"] == 0
    twice = ngram_join.join_documents(table(spark, ["a b c d e f"] * 3, ids=[4, 4, None])).collect()
    assert {(r["class_id"], r["n_links"]) for r in twice} == {(4, 2)}
    assert ngram_join.join_documents(table(spark, [])).count() == 0


def test_join_with_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SEEN", 40)
    monkeypatch.setattr(minhash, "HOT", 30)
    monkeypatch.setattr(minhash, "PART", 16)
    rows = list(enumerate([*_family(150, 120, seed=8), *[f"other {i} " * 9 for i in range(40)]]))
    _check_join(ngram_join.join_documents(table(spark, [t for _, t in rows])).collect(), rows)


def _forest():
    shortest = minhash.shortest_prefix(0.8, 24, 0.999, 12)
    return minhash.Forest(0.8, 24, shortest, 12, 0.999)


def _trie(n, alike, forest, seed=0):
    """Signature bytes of items that are, by expectation, as alike to each other as told."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, 288).astype(np.uint8)
    own = rng.random((n, 288)) >= alike**0.5
    return np.where(own, rng.integers(0, 256, (n, 288)), base).astype(np.uint8)


def test_prefixes_are_shortened_to_the_target_by_what_is_seen():
    forest = _forest()
    assert minhash.recall(0.8, 24, forest.shortest) >= 0.999 > minhash.recall(0.8, 24, forest.shortest + 1)
    depths = [forest.matched(_trie(60, alike, forest)) for alike in (0.99, 0.9, 0.84, 0.81)]
    assert depths[0] == 12 and depths == sorted(depths, reverse=True) and depths[-1] < 9
    # Nothing as alike as the threshold is seen: no prefix is long enough to be sure.
    assert forest.matched(_trie(20, 0.3, forest)) == forest.shortest


def test_tries_are_sorted_and_cut_at_prefixes():
    forest = _forest()
    sig = np.random.default_rng(3).integers(0, 2**32, (300, 288)).astype(np.uint32)
    sig[100:] = sig[:200]
    sig[100:, 7::12] = 1
    rest = minhash.after_prefix(sig, 24, forest.shortest)
    values = minhash.as_bytes(sig).reshape(300, 24, 12)[:, 0, forest.shortest :]
    order = np.argsort(rest[:, 0], kind="stable")
    assert [bytes(values[i]) for i in order] == sorted(bytes(x) for x in values)
    for depth in range(forest.shortest, 13):
        cuts = forest.subtries(rest[order, 0], depth)
        groups = [{bytes(values[i][: depth - forest.shortest]) for i in order[a:b]} for a, b in itertools.pairwise(cuts)]
        assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == len(groups)


def test_join_meets_pairs_at_the_threshold(spark):
    """Measured recall on pairs that are barely 0.8 alike: at least 0.99 (0.999 is aimed at)."""
    rng = np.random.default_rng(9)
    texts = []
    for k in range(300):
        words = [f"w{k}x{i}" for i in range(200)]
        other = list(words)
        for at in rng.choice(np.arange(5, 195, 6), 4, replace=False):
            other[at] = f"new{k}x{at}"
        texts += [" ".join(words), " ".join(other)]
    sets = [_words5(t) for t in texts]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 600, 2)]
    assert all(0.8 <= x < 0.83 for x in alike)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.join_documents(table(spark, texts)).collect()}
    assert sum(got.values()) >= 0.99 * 600


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]
    sig = minhash.Hashes(400).signatures(np.r_[a, b], np.array([0, 1000]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(800 / 1200, abs=0.08)


@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=25), min_size=1, max_size=40))
@settings(max_examples=40, deadline=None)
def test_intersections(sets):
    flat = np.concatenate([np.array(sorted(s) * 2, np.uint64) for s in sets])
    owner = np.repeat(np.arange(len(sets)), [2 * len(s) for s in sets])
    size, a, b, n = minhash.shared(flat, owner, len(sets), light=3, chunk=10)
    assert size.tolist() == [len(s) for s in sets]
    want = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] & sets[j]}
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want


def _characters(line, size=5):
    return {line[i : i + size] for i in range(len(line) - size + 1)} if len(line) >= size else {("whole", line)}


def _check_lines(got, rows):
    first, order = {}, sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, t in order:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line.strip(), (i, p))
    number = {line: k for k, line in enumerate(first)}
    _, root = _link_by_hand({k: _characters(line) for line, k in number.items()})
    stays = {}
    for line, k in number.items():
        stays[root[k]] = min(stays.get(root[k], first[line]), first[line])
    want = {i: [p for p, line in enumerate((t or "").split("\n")) if line.strip() and stays[root[number[line.strip()]]] != (i, p)] for i, t in rows}
    assert {r["doc_id"]: r["removed"] for r in got} == want
    assert all(r["n_removed"] == len(r["removed"]) and r["n_lines"] == (dict(rows)[r["doc_id"]] or "").count("\n") + 1 for r in got)


def test_lines(docs, rows):
    _check_lines(line_dedup.decide(docs).collect(), rows)


def test_lines_odd_rows(spark):
    texts = odd_texts()
    texts[6] = texts[7] = "\n".join(f"line number {i} of a long text" for i in range(300))
    _check_lines(line_dedup.decide(clashing(table(spark, texts))).collect(), list(enumerate(texts)))
    twice = line_dedup.decide(table(spark, ["same line here", "same line here"], ids=[1, 1])).collect()
    assert sorted(r["n_removed"] for r in twice) == [0, 1]
    assert line_dedup.decide(table(spark, [])).count() == 0


def _changed_lines(n=60, seed=3):
    rng = np.random.default_rng(seed)
    lines = ["".join(rng.choice(list("abcdefgh ij"), 90)).strip() or "x" for _ in range(n)]
    return list(enumerate("\n".join([x, x[:40] + "#" + x[41:], f"own line {i}", lines[i - 1]]) for i, x in enumerate(lines)))


def test_lines_with_shuffled_tables(spark, monkeypatch):
    """What is too large to broadcast goes through sieves; no text and no key is written with the occurrences."""
    held = {}
    put = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: held.setdefault(name, put(df, name)))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = _changed_lines()
    _check_lines(line_dedup.decide(table(spark, [t for _, t in rows])).collect(), rows)
    assert set(held["line-features"].columns) == {"row", "doc_id", "n_lines", "pos", "node", "low", "sig"}


def test_lines_with_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SEEN", 40)
    monkeypatch.setattr(minhash, "HOT", 30)
    rows = _changed_lines()
    _check_lines(line_dedup.decide(table(spark, [t for _, t in rows])).collect(), rows)


@pytest.mark.parametrize("rows", [3, 8])
def test_lines_with_other_bands(spark, rows):
    lines = _changed_lines()
    _check_lines(line_dedup.decide(table(spark, [t for _, t in lines]), rows=rows, target=0.9999).collect(), lines)


def test_lines_that_meet_by_chance_stay_where_they_are():
    """Their number grows with the square of the lines', and so would the table of what met."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(60)]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(4000)]
    lines += [x[:-1] + "#" for x in lines[:100]]
    kept = minhash.as_bytes(minhash.Hashes(60).signatures(*line_dedup.LineShingles().of(lines)))
    bands, node = line_dedup._bands(12, 5), np.repeat(np.arange(4100), 12)
    key = bands.keys(kept).reshape(-1)
    sketch = bands.sketches(kept).reshape(-1)
    met = np.unique(key[:48_000], return_counts=True)[1]
    assert len(minhash._judged(key[:48_000], sketch[:48_000], node[:48_000])[0]) < 0.5 * met[met > 1].sum()
    got, place, stayed = minhash._judged(key, sketch, node)
    assert set(range(100)) | set(range(4000, 4100)) <= set(stayed.tolist())
    assert len(np.unique(got)) == (place == 0).sum()


def test_sieve_lets_all_keys_through_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    keys = written(spark.range(0, 100_000, 5).withColumnRenamed("id", "node"), "keys")
    got = common.sieved(spark.range(100_000).withColumnRenamed("id", "node").withColumn("z", F.lit("z")), keys, ["node"])
    assert got.columns == ["node", "z"]
    found = [r["node"] for r in got.select("node").collect()]
    assert len(found) == len(set(found)) and set(range(0, 100_000, 5)) <= set(found) and len(found) < 29_000
    monkeypatch.setattr(common, "SIEVE_MOST", 1 << 10)
    assert common.sieved(keys, keys, ["node"]).count() == 20_000


def test_lines_rewritten(spark):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, ["a first line\n\nmine", "yours\na first line\n", None])).collect()}
    assert got == {0: "a first line\n\nmine", 1: "yours\n", 2: None}


def test_lines_with_one_or_two_characters_changed(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts, must = [], []
    for length in range(40, 171, 10):
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), length))
        one = line[: length // 2] + "#" + line[length // 2 + 1 :]
        two = line[: length // 3] + "#" + line[length // 3 + 1 : 2 * length // 3] + "#" + line[2 * length // 3 + 1 :]
        texts += [line, one, "\n".join([two, "Z" * length])]
        # By shingles of five a change costs five: (L - 9) / (L + 1) for one, (L - 14) / (L + 6) for two.
        must += [False, length >= 50, length >= 100]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    _, root = _link_by_hand({i: {t.split("\n")[0][k : k + 5] for k in range(len(t.split("\n")[0]) - 4)} for i, t in enumerate(texts)})
    first = {i: 0 in got[i] for i in got}
    assert first == {i: root[i] != i for i in got}
    assert all(first[i] for i, m in enumerate(must) if m)


@pytest.mark.parametrize("rows", [3, 5, 8])
def test_bands_reach_the_recall(rows):
    bands = line_dedup.bands_for(rows)
    assert minhash.recall(0.8, bands, rows) >= line_dedup.TARGET > minhash.recall(0.8, bands - 1, rows)


def test_estimates_of_long_and_short_lines_are_unbiased():
    rng = np.random.default_rng(6)
    for length in (60, 4000):
        line = "".join(rng.choice(list("abcdefghij klmnop"), length))
        pairs = [(line, line[: length - cut] + "".join(rng.choice(list("qrstuvwxyz"), cut))) for cut in (length // 20, length // 3)]
        for one, two in pairs:
            flat, starts = line_dedup.LineShingles(5).of([one, two])
            sig = minhash.as_bytes(minhash.Hashes(600).signatures(flat, starts))
            want = len(_characters(one) & _characters(two)) / len(_characters(one) | _characters(two))
            assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.07)


def test_buckets(spark):
    df = spark.createDataFrame([(5,), (None,)], "i long").select(bucket_of(F.col("i"), 5).alias("b"))
    assert [r["b"] for r in df.collect()] == [zlib.crc32(b"5") % 5, -1]


def test_clashing_columns_are_all_there(spark):
    assert set(CLASHING) <= set(clashing(table(spark, ["a"])).columns)


def test_the_toxicity_fit_holds_little(monkeypatch):
    """The driver's memory is shared with the JVM; a fit of 2,000 rows of 500 terms took 160 MB and more beside them."""
    import tracemalloc

    rng = np.random.default_rng(5)
    common_terms = rng.integers(0, 1 << 20, 3000)
    rows = [np.unique(rng.choice(common_terms, 500)).astype(np.int32) for _ in range(2000)]
    labels = np.arange(2000) % 2
    rows = [np.union1d(x, [7]).astype(np.int32) if y else x for x, y in zip(rows, labels.tolist(), strict=True)]
    tracemalloc.start()
    model = toxicity.FactorizationMachine.fit(rows, labels, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in model.hashed and peak < 100e6
