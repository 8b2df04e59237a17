"""The training-data queries and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import sha256_hex, table


def _texts(parts: list[Column], sep: str = ":") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def _spans(found: str, order: tuple[str, str, str], base: tuple[str, ...] | None = None) -> Column:
    """All spans of ``found``, or those of the base kinds, as one string."""
    spans = F.col(found) if base is None else F.filter(found, lambda s: s["kind"].isin(*base))
    return F.array_join(F.transform(spans, lambda s: _texts([s[c] for c in order])), ",")


def _count(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.permindex import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn_model(docs))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.winnow import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.edits import edited_counts

    return edited_counts(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import pii

    found = pii.scan(table(spark, sf_dir, "documents"))
    order = ("kind", "start", "end")
    return found.select(
        "doc_id",
        *[_count("found", k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        sha256_hex(_spans("found", order, pii.BASE_KINDS)).alias("base_sha256"),
        _spans("found", order).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.chat import format_conversations, with_marker_conversation

    return format_conversations(with_marker_conversation(table(spark, sf_dir, "conversations")), digest=True)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import secrets

    found = secrets.scan(table(spark, sf_dir, "documents"))
    order = ("kind", "start", "end")
    return found.select(
        "doc_id",
        *[_count("found", k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        sha256_hex(_spans("found", order, secrets.BASE_KINDS)).alias("base_sha256"),
        _spans("found", order).alias("spans"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.simhash import near_duplicate_groups

    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return groups.select("doc_id", hexed, "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.html import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_edit_token_counts": op4_edit_token_counts,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_secrets": op7_secrets,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_WORDS = (
    "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
t AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + len(regexp_extract_all(role, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|'))
      + length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
""",
    "op3_benchmark_decontamination": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[j:j + least(len(w), 8) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS j FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
hits AS (
  SELECT d.r, d.j, d.n, i.item_id
  FROM (SELECT r, j, n, array_to_string(w[j:j + n - 1], ' ') AS k
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j
              FROM docs, (SELECT DISTINCT n FROM item_windows))) d
  JOIN item_windows i ON i.n = d.n AND i.k = d.k
),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(j, j + n - 1)) AS p FROM hits) GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
""",
}
