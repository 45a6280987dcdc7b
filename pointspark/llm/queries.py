"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm import bpe, decontaminate, line_dedup, media, ranked, secrets, segmentation, simhash, spelling, token_counts, token_files, toxicity, warc
from pointspark.llm.common import new_path, read


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS chosen FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM chosen THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM chosen THEN NULL ELSE chosen END AS refers_to
FROM m
"""


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_documents(read(spark, sf_dir, "documents"), path, tokenizer, 2)
    return token_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "size", "containment")


def op3_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Words of a text in lower case, and its distinct shingles of k words.
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+')"
SHINGLES_SQL = "SELECT DISTINCT id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM {rows})"
OP4_SQL = f"""
WITH bw AS (SELECT id, w, least(5, len(w)) AS k FROM (SELECT item_id AS id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
dw AS (SELECT doc_id AS id, {WORDS_SQL} AS w, k FROM documents, (SELECT DISTINCT k FROM bw)),
d AS ({SHINGLES_SQL.format(rows="dw")}),
b AS ({SHINGLES_SQL.format(rows="bw")}),
n AS (SELECT id, count(*) AS size FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b ON d.k = b.k AND d.s = b.s GROUP BY d.id, b.id)
SELECT doc_id, item_id, shared, size, CAST(shared AS DOUBLE) / size AS containment
FROM m JOIN n ON n.id = m.item_id WHERE 100 * shared >= 80 * size
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.documents_as_media(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(read(spark, sf_dir, "documents"), model, path_col="source")
    return found.select("doc_id", "position", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


#: The terms of a text, with repeats.
TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
d AS (SELECT doc_id, {TERMS_SQL} AS terms FROM documents),
s AS (SELECT count(*) AS n_all, sum(len(terms)) AS l_all FROM d WHERE len(terms) > 0),
m AS (SELECT doc_id, terms, CAST(100 - 90 + (90 * len(terms) * n_all) // l_all AS BIGINT) AS m FROM d, s WHERE len(terms) > 0),
t AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM m) GROUP BY doc_id, m, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s
),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: Lines with their keys; {docs} is a table or a subquery in brackets.
LINES_SQL = """
SELECT doc_id, pos, line,
  translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}))
"""
OP8_SQL = f"""
WITH l AS ({LINES_SQL.format(docs="documents")}),
f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.doc_id, l.pos, l.line, (f.k IS NOT NULL AND l.doc_id <> f.keeper) AS lost FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def queries() -> dict:
    return {
        "op1_warc_archive": op1_warc_archive,
        "op2_token_files": op2_token_files,
        "op3_segmentation": op3_segmentation,
        "op4_decontamination": op4_decontamination,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_media_columns": op7_media_columns,
        "op8_line_dedup": op8_line_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_token_counts": op10_token_counts,
        "op11_pair_index_bpe": op11_pair_index_bpe,
        "op12_ranked_search": op12_ranked_search,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": OP1_SQL, "op4_decontamination": OP4_SQL, "op8_line_dedup": OP8_SQL, "op12_ranked_search": OP12_SQL}
