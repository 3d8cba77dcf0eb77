"""Registered queries of the operators and of the pipeline, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, hard_negatives, mixing, near_dup, quality_net, quality_rules, sharding, token_counts, token_files, url_filter, warc, whitening
from .shared import table, utf8_bytes, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))
EXTRA_CONVERSATION = "</s>[INST] ok [/INST]"


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


def _url_oracle() -> str:
    terms = ", ".join(f"('{t}', {w})" for t, w in sorted(url_filter.VOCABULARY.items()))
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '{r[r.index('/'):]}', '{'allow' if ok else 'block'}')" for r, ok in URL_RULES)
    return f"""
WITH terms(term, weight) AS (VALUES {terms}), rules(rule, rhost, rpath, said) AS (VALUES {rules}),
u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hits AS (SELECT page_id, term, weight FROM u JOIN terms ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
t AS (SELECT page_id, count(*) FILTER (weight >= {url_filter.STRICT}) AS strict_hits, count(*) FILTER (weight < {url_filter.STRICT}) AS soft_hits,
  cast(coalesce(sum(weight) FILTER (weight < {url_filter.STRICT}), 0) AS BIGINT) AS soft_weight FROM hits GROUP BY page_id),
r AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM u JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(strict_hits, 0) > 0 OR (coalesce(soft_hits, 0) >= 2 AND coalesce(soft_weight, 0) >= 3) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_weight, 0) AS soft_weight
FROM u LEFT JOIN t USING (page_id) LEFT JOIN r USING (page_id)"""


@query("op1_url_filter", _url_oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url by host rules, else by the weighted vocabulary."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules=URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").cast("long").alias("strict_hits"), F.size("soft_terms").cast("long").alias("soft_hits"), "soft_weight")


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by jump hash of doc_id, with slots and the shard among nine."""
    sized = table(spark, sf_dir, "documents").select("doc_id", (utf8_bytes("text") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    sharded = sharding.number_slots(sharding.assign_shards(sized, "doc_id", 8))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.jump_shard(F.col("doc_id"), 9).alias("grown_shard"))


# Base32 of a SHA-1 from its 40 hex digits: groups of five digits are 20 bits, four characters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(h, cast(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> cast(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')"


@query("op3_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT body, max(page_id) AS answer FROM p GROUP BY body)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = answer THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> answer THEN answer END AS refers_to
FROM p JOIN best USING (body)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as a content-addressed archive and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_near_dup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document and the closest verified link of its text."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def _chat_oracle() -> str:
    starts = [c for c in dict.fromkeys(chat.CONTROLS) if not any(c != o and c.startswith(o) for o in chat.CONTROLS)]  # one for every place that is broken
    breaks = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in starts)
    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '{EXTRA_CONVERSATION}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)),
hidden AS (SELECT *, list_transform([role, text], lambda x: length(x) + length(x) - length(replace(x, '\\', '')) + {breaks}) AS n FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n[1] + length(role) - length(replace(role, chr(10), '')) + n[2] + {len(chat.OPEN) + len(chat.CLOSE) + 2})::BIGINT AS formatted_chars FROM hidden GROUP BY conv_id"""


@query("op5_chat", _chat_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from what was formatted."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_CONVERSATION), (-7, 1, "assistant", EXTRA_CONVERSATION)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.union(extra))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# Typed content of a conversation row: its text cut at line breaks, with an attachment behind each line, of a kind and size that the line decides.
_KINDS = ("image", "audio", "document")


@query("chat_parts", """
WITH l AS (SELECT conv_id, turn, role, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (
  SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM conversations)),
a AS (SELECT conv_id, turn, i - 1 AS ordinal, ['image', 'audio', 'document'][length(line) % 3 + 1] AS kind, md5(line) AS ref,
  CASE length(line) % 3 WHEN 0 THEN 85 + 170 * ceil(10 * length(line) / 512) * ceil(7 * length(line) / 512) WHEN 1 THEN ceil(length(line) * 0.5 * 25) ELSE 800 * (length(line) % 5) END::BIGINT AS tokens FROM l)
SELECT conv_id, turn, count(*) AS placeholders, string_agg(kind || ':' || ref || ':' || tokens, ' ' ORDER BY ordinal) AS attachments, sum(tokens)::BIGINT AS expanded_tokens FROM a GROUP BY conv_id, turn""")
def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, image, audio and document parts of every message: the references and expanded tokens of its placeholders, counted in the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def parts(line):
        n, none = F.length(line), lambda kind: F.lit(None).cast(kind)
        text = F.struct(F.lit("text").alias("type"), line.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"))
        held = F.struct(F.element_at(F.array(*[F.lit(k) for k in _KINDS]), n % 3 + 1).alias("type"), none("string").alias("text"), F.md5(line.cast("binary")).alias("ref"),
                        (n * 10).cast("int").alias("width"), (n * 7).cast("int").alias("height"), (n * 0.5).cast("double").alias("seconds"), (n % 5).cast("int").alias("pages"))
        return F.array(text, held)

    formatted = chat.format_turns(rows.withColumn("parts", F.flatten(F.transform("lines", parts))), text=None, parts="parts")
    marks = sum((F.size(F.split("segment", f"<\\|{k}\\|>", -1)) - 1 for k in _KINDS), F.lit(0))
    told = F.transform("attachments", lambda a: F.concat_ws(":", a["kind"], a["ref"], a["tokens"].cast("string")))
    return formatted.select("conv_id", "turn", marks.cast("long").alias("placeholders"), F.array_join(told, " ").alias("attachments"), "expanded_tokens")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the isolation forest's verdict on every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 percent by source weights 3, 1, 2."""
    return mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_quality_net")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text."""
    scored = quality_net.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of all documents with its suffix sums."""
    # written, as two branches read it: every text is encoded once
    return token_counts.suffix_sums(written(token_counts.length_histogram(table(spark, sf_dir, "documents").select("text")), "lengths"))


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose tiles cover half of the item or more."""
    found = decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_tiles", "covered", "item_tokens", "coverage", F.lit(True).alias("contaminated"))


@query("op11_hard_negatives", """
WITH r AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, all embeddings searched."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files in order of doc_id, and read back from them."""
    import public_tokenizers

    manifest, folder = token_files.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(manifest, folder)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened to four components by an exact covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
