"""The queries of this package, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .exact_dedup import exact_groups
from .jaccard import jaccard_components
from .language import identify_language
from .line_dedup import line_dedup
from .mixing import mix
from .quality import quality
from .sharding import histogram_shards
from .toxicity import toxicity
from .vectors import near_vectors

#: The folder of the vocabularies; None: the one of the module public_tokenizers.
TOKENIZERS: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> tuple[str, str]:
    """The path of a vocabulary and the pattern that splits texts for it."""
    import public_tokenizers

    return (f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"), 16)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_vectors": op5_vectors,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_jaccard": op8_jaccard,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op5_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        n AS (
            SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM v
            WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
            WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.9),
        reach AS (
            SELECT vec_id AS u, vec_id AS w FROM v
            UNION
            SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
        least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u)
        SELECT u AS vec_id, (SELECT count(*) FROM links l WHERE l.u = least.u) AS n_links, component_id, u = component_id AS kept
        FROM least
    """,
    "op6_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        places AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM docs),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM places),
        common AS (
            SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.largest AS gone FROM keyed k LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS grams
            FROM w WHERE len(words) > 0),
        g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
        c AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT u, v FROM c JOIN s x ON x.doc_id = u JOIN s y ON y.doc_id = v
            WHERE 100 * common >= 80 * (len(x.grams) + len(y.grams) - common)),
        both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (
            SELECT doc_id AS u, doc_id AS v FROM documents
            UNION
            SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
        SELECT d.doc_id, coalesce(any_value(len(s.grams)), 0) AS n_shingles, min(r.v) AS component_id
        FROM documents d JOIN reach r ON r.u = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
}
