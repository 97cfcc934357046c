"""One query for each corpus operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import ann, bpe, exact_dedup, license_scan, lm_scoring, near_dup, packing, periodic_runs, phrases, quality_rules, sharding, token_counts, warc
from netloom.llm.common import Work, shared_folder

MULTI, WORD = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.suffix_sums(Work(spark).table(token_counts.length_histogram(docs, public_tokenizers.path(MULTI)), "histogram"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD))


def quality_verdicts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Statistics of docs with the verdict of rules learned from the labelled ones among them."""
    sample = quality_rules.labelled_sample(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(quality_rules.statistics(docs), quality_rules.learn(sample, list(quality_rules.features())))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality_verdicts(spark, _table(spark, sf_dir, "documents"), sf_dir)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0")
    return lm_scoring.score(docs, *lm_scoring.fit(docs, good))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(MULTI)
    done = bpe.decode_ids(bpe.encode_texts(_table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc"
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs; where crc32 of the id is divisible by 10, words repeat from a place on with a period, both fixed by the crc.

    Such a text's words are joined by one space; every other text, and that of a null id, is as it was.
    """
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w")).withColumn("_n", F.size("_w").cast("long"))
    rows = rows.withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    at = F.expr("transform(_w, (w, i) -> if(i < _a, w, _w[cast(_a + (i - _a) % _p as int)]))")
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = periodic_runs.periodic_runs(with_repeats(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    told = told.select("doc_id", "runs", "collapsed", longest.alias("_l"))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_l.start")).alias("start"),
        F.col("_l.length").alias("length"),
        (-F.col("_l.period")).alias("period"),
        F.expr("1000 * _l.length div -_l.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_exact_dedup, op4_packing, op5_quality_rules, op6_lm_scoring, op7_sharding, op8_bpe, op9_warc, op10_near_dup, op11_phrases, op12_nearest, op13_periodic_runs, pipeline)}

_SPACES = r"[\x20\x09-\x0D]+"

SQL = {
    "op3_exact_dedup": rf"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept
            FROM t
        )
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
    """,
    "op9_warc": """
        WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), d AS (
            SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM t
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last_id <> page_id THEN last_id END AS refers_to
        FROM f
    """,
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, doc_id,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
        ), grams AS (
            SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size))
        ), counts AS (
            SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100
        ), cuts AS (
            SELECT lang, size, phrase, f, k, array_to_string(w[1 : k], ' ') AS left_part, array_to_string(w[k + 1 :], ' ') AS right_part
            FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, size - 1)) AS k FROM counts WHERE size > 1)
        ), scored AS (
            SELECT c.lang, c.size, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = left_part JOIN counts y ON y.lang = c.lang AND y.phrase = right_part
            JOIN totals t ON t.lang = c.lang
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
        ), kept AS (
            SELECT * FROM scored s
            WHERE NOT EXISTS (
                SELECT 1 FROM counts x
                WHERE x.lang = s.lang AND x.size > s.size AND 100 * x.f >= 100 * s.a AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ')
            )
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept QUALIFY rank <= 2000
    """,
}
