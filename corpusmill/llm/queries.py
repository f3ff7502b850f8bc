"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import classifier, decontaminate, licenses, packing, quality_rules, simhash, substring, tokencount, toxicity, warc
from corpusmill.llm.common import load


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(load(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(load(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.with_source(load(spark, sf_dir, "pages"))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", F.to_json("headers").alias("headers"), F.md5("block").alias("block_md5"), F.when(F.col("warc_type") != "response", warc.text_of(F.col("block"))).alias("text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_quality_classifier, op4_substring_dedup, op5_license_scan, op6_toxicity, op7_decontamination, op8_warc_derivatives, op9_simhash, op10_quality_rules)}

D_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"


def _d_seeds(table: str, key: str) -> str:
    """Words with those that follow them, by window functions."""
    ahead = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in (1, 2, 3, 5, 6, 7, 9))
    return f"SELECT {key}, pos, word AS w0, {ahead} FROM {table} WINDOW o AS (PARTITION BY {key} ORDER BY pos)"


def _d_mask(offsets: tuple[int, ...]) -> str:
    return "SELECT d.row, b.item, d.pos - b.pos AS shift FROM d JOIN b ON " + " AND ".join(f"d.w{k} = b.w{k}" for k in offsets)


#: Every alignment of op 7 by joins on the words themselves; items of 8 words and over, as the tables have.
D_OP7 = f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {D_WORDS} AS w FROM documents), items AS (SELECT item_id, row_number() OVER () AS item, {D_WORDS} AS w FROM benchmark),
 dw AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM docs), bw AS (SELECT item, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM items), d AS ({_d_seeds("dw", "row")}), b AS ({_d_seeds("bw", "item")}),
 lined AS ({" UNION ".join(map(_d_mask, decontaminate.MASKS))}), apart AS (SELECT *, coalesce(shift - lag(shift) OVER (PARTITION BY row, item ORDER BY shift) > {decontaminate.SLACK}, false) AS far FROM lined),
 placed AS (SELECT row, item, shift, sum(far::INT) OVER (PARTITION BY row, item ORDER BY shift) AS place FROM apart), held AS (SELECT p.row, p.item, p.place, bw.pos AS j, min(greatest(p.shift, 0)) AS first_word FROM placed p JOIN bw ON bw.item = p.item JOIN dw ON dw.row = p.row AND dw.pos = bw.pos + p.shift AND dw.word = bw.word GROUP BY ALL),
 spread AS (SELECT *, lead(j, {decontaminate.LOCAL - 1}) OVER (PARTITION BY row, item, place ORDER BY j) - j < {decontaminate.LOCAL_SPAN} AS near FROM held), found AS (SELECT row, item, place, count(*) AS n, min(first_word) AS first_word, coalesce(bool_or(near), false) AS near FROM spread GROUP BY ALL),
 best AS (SELECT f.*, len(i.w) AS item_words, i.item_id FROM found f JOIN items i USING (item) WHERE f.n >= {decontaminate.MIN_COVERAGE} * len(i.w) OR near QUALIFY row_number() OVER (PARTITION BY row, item ORDER BY n DESC, first_word) = 1)
 SELECT doc_id, item_id, n AS n_matched, CAST(item_words AS BIGINT) AS item_words, round(n / item_words::DOUBLE, 6) AS coverage, CAST(first_word AS BIGINT) AS first_word FROM best JOIN docs USING (row)"""

#: The others cannot be said in SQL at whole size (tokenizers, fits, HTML, 64-bit hashes of shingles
#: over whole tables); tests/llm holds each against brute force instead.
ORACLE_SQL: dict[str, str] = {"op7_decontamination": D_OP7}
