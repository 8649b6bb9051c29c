"""The queries of this subpackage, each over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import bpe, exact_dedup, fingerprints, langid, line_dedup, lm, ngram_join, packing, quality, toxicity
from tilewright.llm.common import documents, labels, release_unread, tables


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query; tables that only led to its result are deleted once it is planned."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark = tables()
        return release_unread(query(spark, sf_dir), mark)

    return run


@tidy
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), size=2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir), folds=5, fold=0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(documents(spark, sf_dir))


@tidy
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), labels(spark, sf_dir), folds=3, fold=1)


@tidy
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir), folds=5, fold=1)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), folds=4, fold=2)


@tidy
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(documents(spark, sf_dir), threshold=0.8, words=5)


@tidy
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decide(documents(spark, sf_dir), threshold=0.8, size=5)


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 fingerprints, as far as SQL can say it."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3's ids decode to."""
    return op3_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_language_model": op7_language_model,
    "op8_language": op8_language,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "fingerprint_edits": fingerprint_edits,
    "bpe_round_trip": bpe_round_trip,
}

#: crc32 of doc_id as text: a step of the polynomial for each bit of each byte.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "fingerprint_edits": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS after, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS head FROM documents)
        SELECT doc_id, length(text) AS n_chars,
               sha256(left(text, length(text) - length(text) // 4) || left(coalesce(after, head), length(text) // 4)) AS edited_sha256 FROM t
    """,
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    # An n-gram is its letters' code points + 1 (blank: 1) in steps of 21 bits; profiles hold 400.
    "op8_language": r"""
        WITH held AS MATERIALIZED (SELECT doc_id, text, lang, ({crc}) % 4 = 2 AS held_out FROM documents),
        plain AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' ') || ' ' AS s FROM held WHERE regexp_matches(text, '\p{{L}}')),
        letter AS (SELECT doc_id, i, CASE WHEN substr(s, i::INT, 1) = ' ' THEN 1 ELSE unicode(substr(s, i::INT, 1)) + 1 END::BIGINT AS c FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM plain)),
        three AS (SELECT doc_id, c, lead(c) OVER w AS d, lead(c, 2) OVER w AS e FROM letter WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        gram AS (SELECT doc_id, c AS g FROM three WHERE c > 1 UNION ALL SELECT doc_id, c * 2097152 + d FROM three WHERE d IS NOT NULL UNION ALL SELECT doc_id, c * 4398046511104 + d * 2097152 + e FROM three WHERE e IS NOT NULL),
        counted AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM gram GROUP BY ALL),
        own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS place FROM counted QUALIFY place < 400),
        learned AS (SELECT lang, g, sum(n) AS n FROM counted JOIN held USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
        profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS place FROM learned QUALIFY place < 400),
        apart AS (SELECT o.doc_id, l.lang, sum(coalesce(abs(o.place - p.place), 400)) AS d, count(*) AS n FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g GROUP BY ALL),
        best AS (SELECT doc_id, lang, 1 - d::DOUBLE / (400 * n) AS score FROM apart QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)
        SELECT h.doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(score, 0) AS score FROM held h LEFT JOIN best b USING (doc_id)
    """,
    "op9_ngram_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
        gram AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM sets),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM both_ JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE n >= 0.8 * (len(x.g) + len(y.g) - n) - 1e-9),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
        SELECT r.a AS doc_id, min(r.b) AS class_id, (SELECT count(*) FROM link l WHERE l.a = r.a) AS n_links FROM reach r GROUP BY r.a
    """,
}
ORACLES["op8_language"] = ORACLES["op8_language"].format(crc=CRC32)
