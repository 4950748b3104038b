"""The training-data operators as queries over the tables of a scale-factor folder, and SQL for them where it can be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import conversation_report
from .common import read
from .divergence import divergence
from .embedding_dedup import near_vectors
from .imatch import edit_report
from .language_id import languages
from .line_dedup import line_report
from .mixing import mix_documents
from .ngram_join import ngram_jaccard_components
from .packing import pack_documents
from .secret_scan import secret_report
from .suffix_dedup import remove_repeats
from .url_filters import filter_pages
from .whitening import whitening_report

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), word_tokenizer_path())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_tokens", "probability", "weight")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return conversation_report(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(read(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), length=100)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(read(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(read(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
            FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM sets
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
        FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
    """,
    "op4_line_dedup": r"""
        WITH docs AS (
            SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l, text IS NULL AS none
            FROM documents WHERE doc_id IS NOT NULL),
        lines AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS x FROM docs),
        pairs AS (SELECT a.doc_id, a.p, a.x AS x, b.x AS y FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
        firsts AS (SELECT x, y, min(struct_pack(d := doc_id, p := p)) AS f FROM pairs GROUP BY x, y),
        late AS (SELECT q.doc_id, q.p FROM pairs q JOIN firsts f ON q.x = f.x AND q.y = f.y WHERE struct_pack(d := q.doc_id, p := q.p) <> f.f),
        gone AS (SELECT doc_id, p FROM late UNION SELECT doc_id, p + 1 FROM late),
        marked AS (SELECT l.doc_id, l.p, l.x, g.p IS NOT NULL AS out FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p),
        edges AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked),
        sums AS (
            SELECT doc_id, count(*) AS n, count(*) FILTER (out) AS r, count(*) FILTER (opens) AS k,
                coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT out), '') AS kept
            FROM edges GROUP BY doc_id)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_lines, coalesce(s.r, 0) AS n_removed, coalesce(s.k, 0) AS n_runs, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM docs d LEFT JOIN sums s ON s.doc_id = d.doc_id
    """,
    "op7_url_filters": r"""
        WITH hosts AS (
            SELECT page_id, lower(regexp_replace(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:]*)', 1), ''), '\.+$', '')) AS host,
                DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched
            FROM pages),
        names AS (
            SELECT DISTINCT unnest([host, CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END]) AS rule
            FROM hosts WHERE host <> ''),
        rules AS (
            SELECT rule, CAST('0x' || substr(md5(rule), 1, 2) AS BIGINT) AS h, CAST(CAST('0x' || substr(md5(rule), 3, 3) AS BIGINT) % 200 AS INTEGER) AS day
            FROM names),
        listed AS (
            SELECT rule, ['adult', 'malware', 'spam', 'gambling'][h % 4 + 1] AS category, DATE '2024-01-01' + day AS since,
                CASE WHEN h % 3 >= 1 THEN DATE '2024-01-01' + (day + 60) END AS until
            FROM rules WHERE h < 128
            UNION ALL
            SELECT rule, ['adult', 'malware', 'spam', 'gambling'][h % 4 + 1], DATE '2024-01-01' + (day + 120), NULL
            FROM rules WHERE h < 128 AND h % 3 = 2),
        met AS (
            SELECT h.page_id, r.category
            FROM hosts h JOIN listed r ON (h.host = r.rule OR ends_with(h.host, '.' || r.rule)) AND h.fetched >= r.since AND (r.until IS NULL OR h.fetched < r.until)),
        sums AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(category))), ',') AS c FROM met GROUP BY page_id)
        SELECT h.page_id, h.host, CAST(h.fetched AS VARCHAR) AS fetched, coalesce(s.n, 0) AS n_rules, coalesce(s.c, '') AS categories, s.n IS NOT NULL AS blocked
        FROM hosts h LEFT JOIN sums s ON s.page_id = h.page_id
    """,
    "op11_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        terms AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        sizes AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
        counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
        totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
        shares AS (
            SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
                1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (t.n + 5 * s.v) AS p
            FROM totals t JOIN sizes s ON s.lang = t.lang JOIN kept k ON k.lang = t.lang
            LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        whole AS (
            SELECT s.lang, s.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(s.n) + 5)) // (any_value(w.n) + 5 * any_value(z.v)) AS q
            FROM shares s JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) w ON w.lang = s.lang JOIN sizes z ON z.lang = s.lang
            GROUP BY s.lang, s.term),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
            GROUP BY a.lang, a.source, b.source),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        over AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - w.q AS value FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND s.p > w.q),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
