"""Registered queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from celltide.llm import bpe, chosen_path, fixity, lattice, length_strata, line_spread, mixing, permutation_index, pii, token_alignment, toxicity, tree_concat, url_graph

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Vocabulary of the registered tokenising query and pipeline stage; the operator takes any rank file.
RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: Vocabularies of the queries that encode with a merge list and that align it with pieces.
VOCABULARY_FILE = "byte_bpe_50k.json"
PIECES_FILE = "piece_bpe_32k.model"


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: Rules of the registered URL query: verdict, host, start of the path.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: Pages of one archive file in the registered fixity query.
FILE_PAGES = 512


@query
def op1_bilstm_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(docs, pii.train_tagger(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query
def op2_link_graph(spark, sf_dir):
    judged = url_graph.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_cube_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


@query
def op4_lattice_links(spark, sf_dir):
    return lattice.link_vectors(table(spark, sf_dir, "embeddings"), similarity=0.98)


@query
def op5_merkle_fixity(spark, sf_dir):
    """The pages as WARC files in two replicas, of which the second has lost some records and some bytes.

    Every record comes back with its place and its status.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hurt = F.overlay("html", F.when(F.substring("html", 6, 1) == "#", "*").otherwise("#"), F.lit(6), F.lit(1))
    replicas = []
    for html in (F.col("html"), F.when(F.col("page_id") % 101 == 0, hurt).otherwise(F.col("html"))):
        record = fixity.record_bytes(F.col("url"), html)
        replicas.append(pages.select(
            "page_id", F.floor(F.col("page_id") / FILE_PAGES).cast("string").alias("file"),
            F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
        ))
    first = fixity.pack(replicas[0], ["page_id", "digest"])
    second = fixity.pack(replicas[1], ["page_id", "digest"]).filter("page_id IS NULL OR page_id % 103 <> 0")
    status = fixity.damaged(fixity.leaves(first), fixity.leaves(second)).withColumnsRenamed({"file": "_file", "offset": "_offset"})
    at = F.col("file").eqNullSafe(F.col("_file")) & (F.col("offset") == F.col("_offset"))
    return first.join(status, at, "left").select(
        "page_id", "file", "offset", "length", F.coalesce("status", F.lit("intact")).alias("status"),
    )


SQL["op5_merkle_fixity"] = """
WITH records AS (
    SELECT page_id, CAST(page_id // 512 AS VARCHAR) AS file, html,
        octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: '
            || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
            || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS length
    FROM pages
)
SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST(length AS BIGINT) AS length,
    CASE WHEN page_id % 103 = 0 THEN 'missing in b' WHEN page_id % 101 = 0 AND length(html) > 0 THEN 'differs' ELSE 'intact' END AS status
FROM records
"""


@query
def op6_line_spread(spark, sf_dir):
    cleaned = line_spread.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op7_permutation_index(spark, sf_dir):
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_merge_replay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN, ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_pattern_grammar(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op10_chosen_path(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chosen_path.classify(docs, size=4, similarity=0.8).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op11_tree_concat(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = tree_concat.encode_texts(docs, public_tokenizers.path(VOCABULARY_FILE), public_tokenizers.PATTERN, ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op13_length_strata(spark, sf_dir):
    index = length_strata.build_index(table(spark, sf_dir, "documents"))
    return length_strata.search(index, table(spark, sf_dir, "benchmark"), k=20)


SQL["op13_length_strata"] = r"""
WITH found AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), docs AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
postings AS (
    SELECT row, doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(100 - 25 + (25 * n * all_docs) // all_terms) AS m
    FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs), totals GROUP BY row, doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, totals GROUP BY term
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scores AS (
    SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_texts(docs, public_tokenizers.path(VOCABULARY_FILE), public_tokenizers.path(PIECES_FILE))
