"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, shared_dir, table

#: Where the public vocabulary files lie; a parameter, never copied into the repository.
TOKENIZERS = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentencepiece

    return sentencepiece.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read_records(warc.write_bundles(table(spark, sf_dir, "pages"), shared_dir(spark)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, shared_dir(spark))
    held_out = F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), shared_dir(spark))
    held_out = F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"), shared_dir(spark), percent=90, k=3)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.join(table(spark, sf_dir, "embeddings"), shared_dir(spark), threshold=0.95)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    book = quality.ledger(table(spark, sf_dir, "documents"))
    judged = quality.apply_policy(book, quality.POLICIES["v2"])
    base = F.col("failed_mask").bitwiseAND(F.lit(quality.BASE.mask).cast("long")) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed_mask")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfile

    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark), tokenizer_path("word_bpe_49k.json"), 2))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = chat.format_chats(table(spark, sf_dir, "conversations"), shared_dir(spark), TOOL_SCHEMAS)
    return rows.select("conv_id", "turn", "role", "kind", "order_turn", "order_step", F.octet_length("json").cast("long").alias("json_bytes"), F.sha2("json", 256).alias("json_sha256"), "n_calls", "n_answered", "n_invalid", "linked", "cyclic")


#: Tools that the corpus may call; a parameter.
TOOL_SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculator": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality": op8_quality,
    "op9_token_ids": op9_token_ids,
    "op10_chat": op10_chat,
}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n FROM pages),
             f AS (SELECT h, min(page_id) first FROM p WHERE n >= 100 GROUP BY h HAVING count(*) > 1)
        SELECT page_id, n AS payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
        FROM p LEFT JOIN f ON p.h = f.h
    """,
    "op8_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
             g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) i FROM d)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM g) WHERE c > 1),
             c AS (SELECT doc_id, count(DISTINCT i + k) n FROM r, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
             m AS (SELECT d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars,
                          length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
                          length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) n_digits,
                          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l,
                          coalesce(c.n, 0) n_repeat_words
                   FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
             x AS (SELECT *, len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines FROM m),
             b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                          + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
                          + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
                          + CASE WHEN 100 * n_digits > 30 * word_chars THEN 64 ELSE 0 END + CASE WHEN n_words > 10000000 THEN 128 ELSE 0 END AS mask FROM x)
        SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols,
               CAST(n_dup_lines AS BIGINT) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words,
               (mask & 3) <> 0 AS base_failed, (mask & 127) = 0 AS kept, CAST(mask AS BIGINT) failed_mask
        FROM b
    """,
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE
             d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM d),
             n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id x, b.doc_id y, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
             l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 90 * (u.n + v.n - i)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached)
        SELECT node AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY node
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE
             v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
             l AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
             r(node, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached),
             c AS (SELECT node, min(reached) component_id FROM r GROUP BY node)
        SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.x = c.node) AS n_links, component_id, node = component_id AS kept FROM c
    """,
    # as long as no message holds a tool call; calls and their linking are tested by brute force
    "op10_chat": """
        WITH m AS (SELECT *, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}' j FROM conversations)
        SELECT conv_id, turn, role, 'plain' AS kind, turn AS order_turn, CAST(0 AS BIGINT) AS order_step, strlen(j) AS json_bytes, sha256(j) AS json_sha256,
               CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_answered, CAST(0 AS BIGINT) AS n_invalid, false AS linked, false AS cyclic
        FROM m
    """,
}
