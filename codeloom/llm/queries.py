"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import bpe, credentials, documented, handwritten, language, leakage, neighbours, spans, syntax
from codeloom.sources.tables import load, spread


def p1_found(spark, d):
    return neighbours.neighbour_pairs(spread(load(spark, d, "nodes").select("id", "embedding")))


def p3_found(spark, d):
    return credentials.find_credentials(spread(load(spark, d, "nodes").select("id", "code")))


def p3_redacted(spark, d):
    return credentials.redact(spread(load(spark, d, "nodes").select("id", "code")))


def p4_found(spark, d):
    return handwritten.foreign_files(spread(load(spark, d, "files"))).select("repository", "file_path").distinct()


def p4_kinds(spark, d):
    kinds = handwritten.foreign_files(spread(load(spark, d, "files")))
    return kinds.groupBy("repository", "kind").agg(F.count("*").alias("n_files"))


def p5_found(spark, d):
    return syntax.invalid_files(spread(load(spark, d, "files"))).select("repository", "file_path")


def p5_rates(spark, d):
    return syntax.invalid_rates(spread(load(spark, d, "files")))


def p6_found(spark, d):
    return documented.documented_functions(spread(load(spark, d, "nodes").drop("embedding"))).select("id").distinct()


def p6_pairs(spark, d):
    pairs = documented.documented_functions(spread(load(spark, d, "nodes").drop("embedding")))
    return pairs.dropDuplicates(["id"])


def p6_sources(spark, d):
    return documented.documented_sources(spread(load(spark, d, "files")))


def p7_found(spark, d):
    return spans.shared_pairs(spread(load(spark, d, "nodes").select("id", "code")))


def p7_shared(spark, d):
    return spans.shared_parts(spread(load(spark, d, "nodes").select("id", "code")))


def p7_classes(spark, d):
    return spans.shared_classes(spread(load(spark, d, "nodes").select("id", "code")))


def p8_ids(spark, d):
    import public_tokenizers as tokenizers

    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return bpe.encode_corpus(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def p9_found(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return leakage.leaked_documents(docs, load(spark, d, "eval_items"))


def p9_spans(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return leakage.leaked_spans(docs, load(spark, d, "eval_items"))


def p9_removals(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return leakage.removals(docs, load(spark, d, "eval_items"))


def p10_found(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text", "lang"))
    found = language.document_languages(docs).filter(F.col("verdict") != "right")
    return found.select("doc_id", "lang").distinct()


def p10_segments(spark, d):
    return language.document_segments(spread(load(spark, d, "documents").select("doc_id", "text", "lang")))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_kinds": p4_kinds, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_pairs": p6_pairs, "p6_sources": p6_sources, "p7_found": p7_found, "p7_shared": p7_shared, "p7_classes": p7_classes, "p8_ids": p8_ids, "p9_found": p9_found, "p9_spans": p9_spans, "p9_removals": p9_removals, "p10_found": p10_found, "p10_segments": p10_segments}

ORACLE: dict[str, str] = {
    "p9_found": """
WITH dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw),
iw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_spans": """
WITH dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM dw),
dg AS (SELECT doc_id, p - 1 AS p, array_to_string(w[p:p + 11], ' ') AS g FROM dp),
iw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw),
h AS (SELECT DISTINCT doc_id, item_id, p FROM dg JOIN ig USING (g)),
n AS (SELECT *, CASE WHEN p <= lag(p) OVER k + 12 THEN 0 ELSE 1 END AS new FROM h WINDOW k AS (PARTITION BY doc_id, item_id ORDER BY p)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS part FROM n)
SELECT doc_id, item_id, min(p) AS first_word, max(p) + 12 - min(p) AS n_words FROM i GROUP BY doc_id, item_id, part""",
}
