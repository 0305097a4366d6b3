"""Queries of the corpus operators, each over its whole table, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, exact_topk, html_text, importance, language, mixing, packing, personal_data, prefix_trie, simhash, suffix_dedup, vector_dedup
from .common import table


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(table(spark, sf_dir, "embeddings"))


def word_tokenizer() -> str:
    """The public word-level tokenizer file that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = html_text.fit(html_text.labelled_pages())
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, weights).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in personal_data.KINDS]
    digest = F.sha2(F.expr(personal_data.written("base")), 256).alias("base_sha256")
    learned = [F.expr(f"cast(size(filter(added, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in personal_data.LEARNED]
    spans = F.expr(personal_data.written("concat(base, added)")).alias("spans")
    return found.select("doc_id", *counts, digest, spans, *learned, (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~language.held_out())
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "found.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(mix).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.unionByName(own)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_vector_dedup, op2_packing, op3_html_text, op4_personal_data, op5_exact_dedup, op6_chat, op7_language, op8_simhash, op9_mixing, op10_suffix_dedup, op11_exact_topk, op12_prefix_trie, op13_importance)}

# the table of CRC-32's steps, and the CRC-32 of a list of bytes
_CRC_TABLE = """crc_table AS (
            SELECT list(x ORDER BY b) AS tab FROM (
                SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x
                FROM range(256) AS r(b))
        )"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


_OCTETS = "list_transform(range(length(hex(encode(f))) // 2), lambda k: ('0x' || substr(hex(encode(f)), (2 * k + 1)::BIGINT, 2))::BIGINT)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = """list_concat(w, list_transform(range(1, length(w)), lambda k: w[k] || ' ' || w[k + 1]), list_transform(range(1, length(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))"""

ORACLES = {
    "op11_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (
            SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_prefix_trie": f"""
        WITH {_CRC_TABLE}, t0 AS (
            SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ), t AS (
            SELECT c, said, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) - 1 AS i FROM t0
        ), convs AS (
            SELECT c, c - c % 100 AS head, n, {_crc("list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 6 AS h
            FROM (SELECT c, count(*) AS n FROM t GROUP BY c), crc_table
        ), k AS (
            SELECT a.c, a.head, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM convs AS a LEFT JOIN convs AS b ON a.head = b.c
        ), r AS (
            SELECT k.c, t.i, t.said, t.chars FROM k JOIN t ON t.c = k.head AND t.i < k.k
            UNION ALL SELECT k.c, t.i - k.h + k.k, t.said, t.chars FROM k JOIN t ON t.c = k.c AND t.i >= k.h
        ), path AS (
            SELECT c, i + 1 AS d, chars, string_agg(said, '') OVER (PARTITION BY c ORDER BY i) AS key FROM r
            UNION ALL SELECT c, 0, 0, '' FROM convs
        ), ends AS (
            SELECT d, key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
            FROM (SELECT *, max(d) OVER (PARTITION BY c) AS len FROM path) WHERE d = len GROUP BY d, key
        ), node AS (
            SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM path GROUP BY d, key
        ), linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id, coalesce(ch.n_children, 0) AS n_children
            FROM node AS n LEFT JOIN node AS p ON p.d = n.d - 1 AND p.key = left(n.key, 64 * (n.d - 1))
            LEFT JOIN (SELECT d - 1 AS d, left(key, 64 * (d - 1)) AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2) AS ch ON ch.d = n.d AND ch.key = n.key
        ), under AS (
            SELECT p.d, p.key, sum((v.n_convs - 1) * v.chars) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
            FROM linked AS v JOIN path AS p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.d, p.key
        )
        SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN n.parent_conv_id END AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves,
               CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM linked AS n JOIN under AS u ON u.d = n.d AND u.key = n.key LEFT JOIN ends AS e ON e.d = n.d AND e.key = n.key""",
    "op13_importance": f"""
        WITH {_CRC_TABLE}, d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
            SELECT regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), df AS (
            SELECT r, f, count(*) AS n FROM (SELECT r, unnest({_FEATURES}) AS f FROM d) GROUP BY r, f
        ), bf AS (
            SELECT f, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS f FROM b) GROUP BY f
        ), named AS (
            SELECT f, {_crc(_OCTETS)} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table
        ), s AS (
            SELECT bucket, sum(n) AS s FROM df JOIN named USING (f) GROUP BY bucket
        ), t AS (
            SELECT bucket, sum(n) AS t FROM bf JOIN named USING (f) GROUP BY bucket
        ), totals AS (
            SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt
        ), gain AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000)))) AS BIGINT) AS g
            FROM s LEFT JOIN t USING (bucket), totals
        ), weights AS (
            SELECT r, sum(n * g) AS weight FROM df JOIN named USING (f) JOIN gain USING (bucket) GROUP BY r
        ), scored AS (
            SELECT d.r, doc_id, length(w) AS n_words, greatest(0, 3 * length(w) - 3) + CASE WHEN length(w) = 1 THEN 1 ELSE 0 END AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM d LEFT JOIN weights USING (r)
        ), ranked AS (
            SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, r) END AS place,
                   count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM ranked""",
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op6_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\b'), '<|', '\l|'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\sINST]'), '[/INST]', '\s/INST]') AS et,
                   replace(replace(replace(replace(replace(replace(replace(replace(role, '\', '\b'), '<|', '\l|'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\sINST]'), '[/INST]', '\s/INST]'), '|', '\p'), chr(10), '\n') AS er
            FROM t
        ), p AS (
            SELECT *, '<|' || er || '|>' || chr(10) || et || '<|end|>' || chr(10) AS piece FROM e
        ), o AS (
            SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of_n,
                   sum(length(piece)) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
            FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, piece)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(so_far) FILTER (role = 'assistant' OR n = of_n) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id""",
}
