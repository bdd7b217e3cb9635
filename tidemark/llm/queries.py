"""The queries of this subpackage, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, extract, fingerprint, langid, licences, mixing, neardup, quality, topk, trie, urlwords, warc, whiten
from tidemark.plans.lineage import new_table_path

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the bytes that they decode to, as digests."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


#: Documents stand for files: a directory for each hundred ids of a source, below one for each
#: thousand; every fifth file is a licence file of its directory, every 25th one of the directory above.
FILE_PATH = """
    coalesce(source, 'none') || '/p' || cast(doc_id div 1000 as string) || '/' || case
        when doc_id % 25 = 0 then 'LICENSE.' || cast(doc_id as string)
        when doc_id % 5 = 0 then 'q' || cast(doc_id div 100 as string) || '/LICENSE.' || cast(doc_id as string)
        else 'q' || cast(doc_id div 100 as string) || '/f' || cast(doc_id as string) || '.txt' end
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document as a file: its own, or that of its nearest ancestor directory."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(FILE_PATH).alias("path"), "text")
    return licences.scan(docs).select("doc_id", "path", "licence", "similarity", "licence_origin")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, written to an archive and read back."""
    path = new_table_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_sha256")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: shingles of 4 words, similarity of 0.8 or more."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.main_text(_table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others of every hundredth vector by integer inner product."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op11_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every page's url; words are counted in the pages' own texts."""
    pages = _table(spark, sf_dir, "pages")
    return urlwords.judge(pages, urlwords.corpus_words(pages), public_tokenizers.path("word_bpe_49k.json"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, heads shared."""
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_license_scan,
        op3_source_mix,
        op4_warc_archive,
        op5_minhash_near_dedup,
        op6_language_id,
        op7_quality_classifier,
        op8_html_extraction,
        op9_exact_top_k,
        op10_order_minhash,
        op11_host_words,
        op12_embedding_whitening,
        op13_conversation_trie,
    )
}

_TOLD_VALUES = ", ".join(f"({k}, {marks}::VARCHAR[], {versions}::VARCHAR[], {str(denies).lower()})" for k, (marks, versions, denies) in enumerate(licences.telling(text) for _, text in licences.TEMPLATES))
_FOUND = "list_sort(list_distinct(list_transform(regexp_extract_all(lower(passage), '{}'), lambda x: replace(x, '-', ''))))"
_TEMPLATE_VALUES = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(licences.TEMPLATES))

ORACLES: dict[str, str] = {
    "op2_license_scan": f"""
        WITH f AS (
            SELECT doc_id, coalesce(text, '') AS text, {FILE_PATH.replace(" div ", " // ").replace("as string", "AS VARCHAR")} AS path FROM documents
        ), d AS (
            SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licences._LICENCE_FILE}') AS named FROM f
        ), parts AS (
            SELECT DISTINCT text, named, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{licences._GAP}'), CASE WHEN named THEN [text] ELSE [] END)) AS passage FROM d
        ), t AS (
            SELECT k, licence, term, count(*) AS n FROM (SELECT k, licence, unnest(regexp_extract_all(lower(body), '{licences._TERM}')) AS term FROM (VALUES {_TEMPLATE_VALUES}) v(k, licence, body)) GROUP BY ALL
        ), idf AS (
            SELECT term, ln((1 + (SELECT count(DISTINCT k) FROM t)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1
        ), tw AS (
            SELECT k, licence, term, (1 + ln(n)) * idf AS w, sqrt(sum(((1 + ln(n)) * idf) ** 2) OVER (PARTITION BY k)) AS t_norm FROM t JOIN idf USING (term)
        ), pt AS (
            SELECT passage, term, count(*) AS n FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '{licences._TERM}')) AS term FROM (SELECT DISTINCT passage FROM parts)) GROUP BY ALL
        ), w AS (
            SELECT passage, term, (1 + ln(n)) * coalesce(idf, ln(1 + (SELECT count(DISTINCT k) FROM t)) + 1) AS w FROM pt LEFT JOIN idf USING (term)
        ), norms AS (
            SELECT passage, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1
        ), said AS (
            SELECT passage, {_FOUND.format(licences.MARKS)} AS marks, {_FOUND.format(licences.VERSION)} AS versions, regexp_matches(lower(passage), '{licences.DENIAL}') AS denies FROM norms
        ), told AS (
            SELECT * FROM (VALUES {_TOLD_VALUES}) v(k, t_marks, t_versions, t_denies)
        ), scores AS (
            SELECT passage, licence, round(sum(w.w * tw.w / t_norm) / any_value(norm), 6) AS similarity FROM w JOIN tw USING (term) JOIN norms USING (passage) JOIN said USING (passage) JOIN told USING (k)
            WHERE marks = t_marks AND (len(t_versions) = 0 OR versions = t_versions) AND (t_denies OR NOT denies) GROUP BY passage, licence, k
        ), own AS (
            SELECT text, named, licence, similarity FROM parts JOIN scores USING (passage) WHERE similarity >= {licences.LEAST}
            QUALIFY row_number() OVER (PARTITION BY text, named ORDER BY similarity DESC, licence) = 1
        ), licensed AS (
            SELECT dir AS ancestor, arg_min(licence, path) AS licence, arg_min(similarity, path) AS similarity FROM d JOIN own USING (text, named) WHERE d.named GROUP BY 1
        ), up AS (
            SELECT dir, ancestor, licence, similarity FROM (SELECT DISTINCT dir FROM d) JOIN licensed ON dir = ancestor OR starts_with(dir, ancestor || '/')
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(ancestor) DESC) = 1
        )
        SELECT doc_id, d.path, coalesce(own.licence, up.licence) AS licence, coalesce(own.similarity, up.similarity) AS similarity,
               CASE WHEN own.licence IS NOT NULL THEN 'own' ELSE ancestor END AS licence_origin
        FROM d LEFT JOIN own ON own.text = d.text AND own.named = d.named LEFT JOIN up ON up.dir = d.dir
    """,
    "op4_warc_archive": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, replace(replace(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), ' ', '%20') AS url FROM pages
        ), d AS (
            SELECT page_id, url, html, 'HTTP/1.1 200 OK@Content-Type: text/html; charset=utf-8@Content-Length: ' || strlen(html) || '@@' AS http, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
        ), g AS (
            SELECT payload_digest, max(page_id) AS largest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
        ), r AS (
            SELECT d.*, CASE WHEN g.largest = d.page_id THEN NULL ELSE g.largest END AS refers_to FROM d LEFT JOIN g USING (payload_digest)
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
               sha256(replace('WARC/1.1@WARC-Type: ' || CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END || '@WARC-Record-ID: <urn:x-page:' || page_id || '>@WARC-Date: 1970-01-01T00:00:00Z@WARC-Target-URI: ', '@', chr(13) || chr(10))
                   || url || replace('@WARC-Payload-Digest: sha1:' || payload_digest || '@WARC-Payload-Length: ' || payload_bytes || '@' || CASE WHEN refers_to IS NULL THEN '' ELSE
                   'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest@WARC-Refers-To: <urn:x-page:' || refers_to || '>@' END || 'Content-Type: application/http;msgtype=response@Content-Length: '
                   || (strlen(http) + 2 * (length(http) - length(replace(http, '@', ''))) - (length(http) - length(replace(http, '@', ''))) + CASE WHEN refers_to IS NULL THEN payload_bytes ELSE 0 END) || '@@' || http, '@', chr(13) || chr(10))
                   || CASE WHEN refers_to IS NULL THEN html ELSE '' END) AS record_sha256
        FROM r
    """,
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op13_conversation_trie": f"""
        WITH own AS (
            SELECT conv_id, list(sha256(length(role) || ':' || role || text)[1:{trie.DIGEST}] ORDER BY turn IS NOT NULL, turn, sha256(length(role) || ':' || role || text)) AS d,
                   list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY turn IS NOT NULL, turn, sha256(length(role) || ':' || role || text)) AS w
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
        ), hashed AS (
            -- the CRC-32 of the decimal id: each byte is followed by eight shifts
            SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')])),
                lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), CAST(4294967295 AS BIGINT)) % 4 AS h FROM own
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.d, [])[1:c.h], c.d[c.h + 1:]) AS d, list_concat(coalesce(b.w, [])[1:c.h], c.w[c.h + 1:]) AS w
            FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
        ), member AS (
            SELECT conv_id, k AS depth, array_to_string(d[1:k], '') AS key, array_to_string(d[1:k - 1], '') AS above, CASE WHEN k = 0 THEN 0 ELSE w[k] END AS words, k = len(d) AS ends FROM rebuilt, unnest(range(len(d) + 1)) r(k)
        ), node AS (
            SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM member GROUP BY depth, key
        ), family AS (
            SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node c WHERE c.depth = n.depth + 1 AND c.above = n.key) AS n_children
            FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.key = n.above
        ), below AS (
            SELECT substr(key, 1, {trie.DIGEST} * k) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM family, unnest(range(depth + 1)) r(k) GROUP BY 1
        )
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM family JOIN below USING (key)
    """,
}
