"""Queries over the driver's tables, one for each operator, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, licenses, line_dedup, merkle, mixing, pieces, quality_rules, simhash, sql, token_files, url_filter, vector_codes, vector_search, warc
from .shared import new_folder, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch times follow from the page id, and the lists from the pages' hosts, as no table has them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.pmod(F.col("page_id") * 7919, F.lit(365))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(url_filter.START + day * 86400))
    found = url_filter.evaluate(captures, stored(url_filter.derived_lists(pages), "lists"))
    return found.select("page_id", day.alias("fetched_day"), "host", "n_hits", "lists", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.sample(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), k=2)
    return found.select("doc_id", "rank", "n_pieces", "log_probability", "perturbed", "log_inclusion", F.crc32("ids").alias("ids_crc32"), "restores")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "archives"))
    return warc.read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), store=lambda df: stored(df, "counts"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


#: A conversation whose texts are made of control strings.
ODD = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    odd = spark.createDataFrame(ODD, "conv_id long, turn int, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(odd)
    folder = new_folder(spark, "chat")
    return chat_format.digests(chat_format.format_conversations(rows, folder), folder)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' file lies; nothing is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    parts = token_files.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end=2)
    return token_files.read_tokens(spark, folder, parts, {"ids_crc32": "long"}, token_files.checksum).withColumnRenamed("key", "doc_id")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases the texts of a fifth of the rows, by id."""
    lower = F.translate("text", line_dedup.UPPER, line_dedup.UPPER.lower())
    when = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": lower}, when)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _escapes(column: str) -> str:
    """SQL for how many characters the default template's escaping adds: one for each control string and backslash."""
    counts = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (*chat_format.CONTROL, "\\")]
    return " + ".join(counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_sentencepiece, op4_warc, op5_quality_rules, op6_licenses, op7_vector_search, op8_chat_format, op9_mixing, op10_token_files, op11_line_dedup, op12_vector_codes, op13_merkle)}

ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
        WITH p AS (
            SELECT page_id, (page_id * 7919) % 365 AS day,
                nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
                list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS steps
            FROM pages),
        n AS (
            SELECT 'd' AS tag, pattern, ('0x' || substr(md5('d' || pattern), 1, 4))::BIGINT AS n FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS pattern FROM p WHERE host IS NOT NULL) WHERE pattern <> ''
            UNION ALL SELECT 'h', host, ('0x' || substr(md5('h' || host), 1, 4))::BIGINT FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)
            UNION ALL SELECT 'a', host, ('0x' || substr(md5('a' || host), 1, 4))::BIGINT FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)
            UNION ALL SELECT 'p', pattern, ('0x' || substr(md5('p' || pattern), 1, 4))::BIGINT FROM (SELECT DISTINCT host || '/' || steps[1] AS pattern FROM p WHERE host IS NOT NULL AND len(steps) > 0)),
        held AS (
            SELECT 'spam' AS list, 'block' AS policy, 'domain' AS kind, pattern, n % 300 AS since, CASE WHEN n % 6 = 0 THEN n % 300 + 45 ELSE 100000 END AS until FROM n WHERE tag = 'd' AND n % 3 = 0
            UNION ALL SELECT 'malware', 'block', 'host', pattern, n % 340, n % 340 + 20 FROM n WHERE tag = 'h' AND n % 4 = 0
            UNION ALL SELECT 'malware', 'block', 'host', pattern, n % 340 + 40, 100000 FROM n WHERE tag = 'h' AND n % 8 = 0
            UNION ALL SELECT 'trusted', 'allow', 'host', pattern, n % 300, 100000 FROM n WHERE tag = 'a' AND n % 5 = 0
            UNION ALL SELECT 'adult', 'block', 'prefix', pattern, n % 300, 100000 FROM n WHERE tag = 'p' AND n % 6 = 0),
        asked AS (
            SELECT page_id, day, 'host' AS kind, host AS pattern FROM p WHERE host IS NOT NULL
            UNION ALL SELECT page_id, day, 'domain', unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM p WHERE host IS NOT NULL
            UNION ALL SELECT page_id, day, 'prefix', unnest(list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/'))) FROM p WHERE host IS NOT NULL),
        hit AS (SELECT a.page_id, h.list, h.policy, length(h.pattern) AS size FROM asked a JOIN held h ON a.kind = h.kind AND a.pattern = h.pattern AND a.day >= h.since AND a.day < h.until),
        best AS (
            SELECT page_id, count(*) AS n_hits, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
                arg_max(policy, size * 2 + CASE WHEN policy = 'allow' THEN 1 ELSE 0 END) AS verdict
            FROM hit GROUP BY page_id)
        SELECT p.page_id, p.day AS fetched_day, p.host, coalesce(n_hits, 0) AS n_hits, coalesce(lists, '') AS lists, coalesce(verdict, 'none') AS verdict
        FROM p LEFT JOIN best USING (page_id)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
        FROM w
    """,
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS o FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
        w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM r),
        f AS (
            SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
            FROM w WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(level, (cap / weight, nth)) FILTER (WHERE level <= cap / weight) AS level FROM f),
        t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * l.level), cap::DOUBLE) AS target FROM f, l),
        c AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS start,
                CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
    """,
    "op11_line_dedup": sql.LINE_DEDUP,
    "op12_vector_codes": sql.lloyd(),
    "op13_merkle": sql.merkle(),
    "op7_vector_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id AS query_id, min(v) AS w FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
        s AS (SELECT query_id, vec_id, CAST(coalesce(list_sum(list_transform(list_zip(v, w), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score FROM q JOIN v ON vec_id <> query_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op8_chat_format": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        l AS (
            SELECT *, length(text) + {_escapes("text")} + CASE role WHEN 'user' THEN 19 WHEN 'assistant' THEN 18
                ELSE 20 + length(role) + {_escapes("role")} + length(role) - length(replace(role, ']', '')) END AS chars
            FROM c),
        g AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt, CAST(sum(chars) AS BIGINT) AS formatted_chars
            FROM l GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, false AS rewrites FROM g
    """,
}
