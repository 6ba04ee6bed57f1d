"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bpe, decontamination, fingerprints, language, language_model, licenses, lines, neardups, personal, toxicity
from undula.llm.common import crc_mod
from undula.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(n: int, rest: int):
    return F.coalesce(crc_mod(F.col("doc_id"), n) == rest, F.lit(False)).alias("held_out")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and of the next documents."""
    return fingerprints.with_next(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return neardups.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them hold."""
    done = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("kept"), F.lit("")).cast("binary")
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, toxicity.learnable(labels))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document; counts and base_sha256 are of the base spans."""
    found = personal.find_personal(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.rank = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(personal.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal.spans_text("base").cast("binary"), 256).alias("base_sha256"), personal.spans_text("spans").alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(language.learnable(docs)))
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score", "ambiguous")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontamination.search_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a license whose notice it holds."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes they decode to."""
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and network scores of each document."""
    scored = language_model.score_texts(_table(spark, sf_dir, "documents"), language_model.learnable())
    return scored.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_near_duplicates, op3_line_dedup, op4_toxicity, op5_personal_data, op6_language, op7_decontamination, op8_licenses, op9_bpe, op10_language_model)
}

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(text: str) -> str:
    """SQL: the words of a text, as a list."""
    one = f"translate(coalesce({text}, ''), {_UPPER} || {_BLANKS}, {_LOWER} || '      ')"
    return f"list_filter(string_split({one}, ' '), lambda x: x <> '')"


def _shingles(words: str) -> str:
    """SQL: the shingles of a list of words, as a list of strings."""
    return f"CASE WHEN len({words}) >= 5 THEN list_transform(range(1, len({words}) - 3), lambda i: array_to_string(list_slice({words}, i, i + 4), ' ')) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
     placed AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM cut),
     keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), {_UPPER}, {_LOWER}) AS key FROM placed),
     held AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     marked AS (SELECT k.doc_id, k.pos, k.line, CASE WHEN h.key IS NOT NULL AND k.doc_id <> h.last THEN 1 ELSE 0 END AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_decontamination": f"""
WITH dw AS (SELECT doc_id, {_words("text")} AS w FROM documents),
     iw AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({_shingles("w")}) AS s FROM dw) a),
     its AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest({_shingles("w")}) AS s FROM iw) a),
     n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
SELECT ds.doc_id, its.item_id, CAST(max(n.n) AS BIGINT) AS n_shingles, CAST(count(*) AS DOUBLE) / max(n.n) AS containment
FROM ds JOIN its ON ds.s = its.s JOIN n ON n.item_id = its.item_id
GROUP BY ds.doc_id, its.item_id HAVING count(*) >= 0.8 * max(n.n)""",
    "op8_licenses": f"""
WITH t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(id, license, text)),
     tw AS (SELECT id, license, {_words("text")} AS w FROM t),
     ts AS (SELECT id, license, {_shingles("w")} AS s FROM tw),
     tb AS (SELECT id, license, s, CASE WHEN len(s) <= 4 THEN 4 WHEN len(s) <= 8 THEN 8 WHEN len(s) <= 16 THEN 16 ELSE 32 END AS block FROM ts),
     te AS (SELECT DISTINCT id, license, block, unnest(s) AS s FROM tb),
     tn AS (SELECT id, count(*) AS n FROM te GROUP BY id),
     dw AS (SELECT doc_id, {_words("text")} AS w FROM documents),
     dl AS (SELECT doc_id, {_shingles("w")} AS s FROM dw),
     dp AS (SELECT doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS pos FROM dl),
     hits AS (SELECT dp.doc_id, te.id, te.license, te.s, dp.pos // te.block AS b FROM dp JOIN te ON dp.s = te.s),
     seen AS (SELECT DISTINCT doc_id, id, license, s, b FROM hits UNION SELECT DISTINCT doc_id, id, license, s, b - 1 AS b FROM hits WHERE b > 0),
     shares AS (SELECT seen.doc_id, seen.license, CAST(count(*) AS DOUBLE) / max(tn.n) AS share FROM seen JOIN tn ON tn.id = seen.id GROUP BY seen.doc_id, seen.id, seen.license, seen.b)
SELECT doc_id, license, max(share) AS containment FROM shares WHERE share >= 0.8 GROUP BY doc_id, license""",
}
