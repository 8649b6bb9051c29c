"""The stages of the pipeline, one after another, against brute force and planted rows."""

import collections
import math
import zlib

import corpus_pipeline
import pytest
from helpers import clashing, table
from pyspark.sql import functions as F
from test_operators import _link_by_hand, _words5

from tilewright.llm import langid
from tilewright.llm.common import bucket_of, tables, written


@pytest.fixture(scope="module")
def planted(spark, sf):
    """The documents and, with ids from 10**6 on, cases of which each stage's fate is known."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = "the and of erwh onharent thly edoution to in is it that reha nded ouble hant erst"
    parts = ["th", "er", "on", "an", "in", "ed", "re", "ha", "nd"]
    base = [a + b for a in parts for b in parts]
    family = [" ".join([*base[:i], "ofthat", *base[i + 1 :]]) for i in (5, 17, 29, 41, 53, 65)]
    cases = {
        "copy a": f"the thin anderes of {clean} onted that",
        "copy b": f"the thin anderes of {clean} onted that",
        "marks": "!!! 123 ... ###",
        "none": None,
        "clean": clean,
        **{f"near {i}": t for i, t in enumerate(family)},
    }
    extra = table(spark, list(cases.values()), ids=range(10**6, 10**6 + len(cases)))
    return docs.unionByName(extra), {k: 10**6 + i for i, k in enumerate(cases)}


@pytest.fixture(scope="module")
def stages(spark, sf, planted):
    out, docs = [], planted[0]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), f"test-{name}")
        out.append((name, before, docs))
    return out


def _ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_all_but_the_last_return_documents(stages, planted):
    for _, _, after in stages[:-1]:
        assert after.columns == planted[0].columns
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [n for n, _, _ in stages]


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, stages, planted):
    _, before, after = stages[0]
    gone = _ids(before) - _ids(after)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert gone and not gone & set(planted[1].values())
    assert all(truth.get(i, 1) == 1 for i in gone)


def test_language_drops_what_is_in_none(stages, planted):
    """Against predictions one by one, and the least that held-out texts of each language are like it."""
    _, before, after = stages[1]
    rows = before.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    profiles = langid.learn(before.where(~(bucket_of(F.col("doc_id"), 4) == 2)))
    found = {r["doc_id"]: profiles.predict(r["text"]) for r in rows}
    least = collections.defaultdict(lambda: 1.0)
    for r in rows:
        lang, score = found[r["doc_id"]]
        if held(r["doc_id"]) and r["lang"] == lang:
            least[lang] = min(least[lang], math.floor(score * 10_000) / 10_000)
    # Of so few held-out texts the rarest thousandth is the least.
    want = {i for i, (lang, score) in found.items() if lang == "und" or score < (least[lang] if lang in least else 0.0)}
    assert _ids(before) - _ids(after) == want >= {planted[1]["marks"], planted[1]["none"]}
    assert len(want) < 0.1 * len(rows)


def test_clashing_columns(spark, sf):
    docs = clashing(table(spark, ["the and of erwh onharent", "the and of erwh onharent", "other words here and there", None], langs=["en"] * 4))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.pack(spark, docs, sf).count() == 4


def test_copies(stages, planted):
    _, before, after = stages[2]
    groups = collections.defaultdict(list)
    for r in before.collect():
        groups[r["text"]].append(r["doc_id"])
    assert _ids(after) == {max(v) for v in groups.values()}
    assert planted[1]["copy b"] in _ids(after)


def test_near_copies(stages, planted):
    _, before, after = stages[3]
    _, root = _link_by_hand({r["doc_id"]: _words5(r["text"]) for r in before.collect()})
    assert _ids(after) == set(root.values())
    assert {planted[1][f"near {i}"] for i in range(6)} & _ids(after)


def test_packed(stages):
    _, before, after = stages[4]
    assert _ids(after) == _ids(before)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_rows_repeated_with_one_id(spark, sf):
    docs = table(spark, ["same text of one id"] * 2 + ["other words"], ids=[7, 7, 8])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()) == [7, 8]


def _rows(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_copies_of_one_id_or_none(spark, sf):
    rows = [(7, "A"), (7, "B"), (9, "A"), (None, "B again"), (None, "C"), (9, "C"), (8, "E"), (8, "E"), (6, "E"), (None, "F"), (None, "F"), (5, None), (5, "")]
    got = _rows(corpus_pipeline.drop_copies(spark, table(spark, [t for _, t in rows], ids=[i for i, _ in rows]), sf))
    fives = [k for k in got if k[0] == 5]
    assert len(fives) == 1 and not got[fives[0]] - 1
    assert {k: n for k, n in got.items() if k[0] != 5} == {(7, "B"): 1, (9, "A"): 1, (None, "B again"): 1, (9, "C"): 1, (8, "E"): 1, (None, "F"): 1}


def test_near_copies_of_one_id_or_none(spark, sf):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (3, 20, 40)]
    apart = [" ".join(f"{c}{i}" for i in range(20)) for c in "pqrst"]
    twin = " ".join(f"v{i}" for i in range(30))
    rows = [(1, " ".join(words)), (None, near[0]), (None, apart[0]), (2, near[1]), (2, apart[1]), (1, apart[2]), (1, near[2]), (3, apart[3]), (3, apart[3]), (None, twin), (None, twin.upper()), (None, apart[4])]
    got = _rows(corpus_pipeline.drop_near_copies(spark, table(spark, [t for _, t in rows], ids=[i for i, _ in rows]), sf))
    family = [k for k in got if k[1] in near or k[1] == rows[0][1]]
    twins = [k for k in got if k[1].lower() == twin]
    assert len(family) == 1 and family[0][0] == 1 and len(twins) == 1
    assert set(got.values()) == {1} and set(got) - {*family, *twins} == {(None, apart[0]), (2, apart[1]), (1, apart[2]), (3, apart[3]), (None, apart[4])}


def test_empty_table(spark, sf):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        assert after.count() == 0
        docs = docs if stage is corpus_pipeline.pack else after


def test_run_is_the_stages(spark, sf):
    mark = tables()
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns
    # Of all that the stages wrote only the last input and what packing reads are left.
    assert tables() - mark == 2
