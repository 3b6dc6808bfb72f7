"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, chat, embedding_join, exact_dedup, lm, mixing, ngram_join, pii, token_counts, toxicity
from tabulon.llm.common import read_table

#: Where the public vocabulary of byte-level BPE lies; a parameter of every function that takes a path.
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "source")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


#: Rows that a query learns nothing from, by the CRC-32 of the key's decimal text.
HELD_OUT = "pmod(crc32(CAST(doc_id AS STRING)), {}) = {}"


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"), held_out=HELD_OUT.format(7, 2))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role: string, content: string>>")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(chat.to_turns(rows).union(chat.to_turns(own))))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(read_table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~F.expr(HELD_OUT.format(5, 0)))
    return toxicity.learn(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    held_out = F.coalesce(F.expr(HELD_OUT.format(5, 0)), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_lm_scores": op5_lm_scores,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_personal_data": op8_personal_data,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_join": op10_embedding_join,
}

_WHITE = "'[\\x09-\\x0D\\x20]'"
_CONTROL = "|".join("".join("\\" + c if c in "\\[]/" else c for c in x) for x in ("\\", *chat.CONTROL))

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w
            FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * both_ >= 85 * (s.n + t.n - both_)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
        parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
        classes AS (SELECT doc_id, count(*) OVER (PARTITION BY c) AS class_size FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) || count(*) AS c FROM grams GROUP BY doc_id))
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(class_size, 1)::BIGINT AS class_size
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN parts USING (doc_id) LEFT JOIN classes USING (doc_id)""",
    "op3_mixing": r"""
        WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::BIGINT AS size FROM documents),
        by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
        weighted AS (
            SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM by_source),
        leveled AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM weighted WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST)),
        plan AS (
            SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE
                ELSE (SELECT max(level) FROM leveled WHERE NOT cap <= level * weight) * weight END AS target
            FROM leveled),
        tape AS (
            SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
            FROM sizes),
        cuts AS (
            SELECT source, ceil(floor(target) / 1024)::BIGINT AS blocks, row_number() OVER r AS place, count(*) OVER () AS places,
                floor(sum(target) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (sum(target) OVER ()) * 4294967296)::BIGINT AS edge,
                floor((sum(target) OVER ()) / 1024)::BIGINT AS slots
            FROM plan WHERE target >= 1 WINDOW r AS (ORDER BY source NULLS LAST)),
        owners AS (
            SELECT source, blocks, place, slots, coalesce(lag(edge) OVER (ORDER BY place), 0) AS lower_, CASE WHEN place = places THEN 4294967296 ELSE edge END AS upper_ FROM cuts),
        points AS (SELECT i AS slot, (i * 2654435769) % 4294967296 AS point FROM range((SELECT max(slots) FROM cuts)) t(i)),
        ranked AS (
            SELECT slot, place, blocks, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block FROM points JOIN owners ON point >= lower_ AND point < upper_),
        short AS (
            SELECT place, blocks, slots, coalesce(held, 0) AS held FROM owners LEFT JOIN (SELECT place, count(*) AS held FROM ranked GROUP BY place) USING (place)
            WHERE coalesce(held, 0) < blocks),
        closing AS (
            SELECT place, slots, held + j AS block, (j + ((place * 2654435769) % 4294967296) / 4294967296.0::DOUBLE) / (blocks - held) AS position
            FROM (SELECT *, unnest(range(blocks - held)) AS j FROM short)),
        schedule AS (
            SELECT source, block, slot FROM (
                SELECT place, block, slot FROM ranked WHERE block < blocks
                UNION ALL SELECT place, block, slots + row_number() OVER (ORDER BY position, place) - 1 FROM closing) JOIN cuts USING (place)),
        turns AS (
            SELECT t.doc_id, t.source, t.size, source_size, target, a + k * source_size AS a, least(a + k * source_size + size, floor(target)::BIGINT) AS z
            FROM tape t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source, range(2) r(k)),
        parts AS (
            SELECT turns.*, b.block, s.slot, least(z, (b.block + 1) * 1024) - greatest(a, b.block * 1024) AS words
            FROM turns, LATERAL (SELECT unnest(CASE WHEN z > a THEN range((a // 1024)::BIGINT, ((z - 1) // 1024 + 1)::BIGINT) ELSE [] END) AS block) b
            JOIN schedule s ON s.source IS NOT DISTINCT FROM turns.source AND s.block = b.block)
        SELECT t.doc_id, t.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, t.source
        FROM tape t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source
        LEFT JOIN (SELECT doc_id, sum(words) AS taken, min(slot) AS first_slot FROM parts GROUP BY doc_id) USING (doc_id)""",
    "op6_exact_dedup": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]', '', 'g') AS content FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
            doc_id = first_value(doc_id) OVER g AS kept, sha256(content) AS text_sha256
        FROM texts WINDOW g AS (PARTITION BY content ORDER BY length(text) DESC, doc_id)""",
    "op7_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (3 + sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 ELSE 13 END))::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op10_embedding_join": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
        parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts""",
}
