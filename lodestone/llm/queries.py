"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from . import html, langid, merkle, mixing, nearest, ngram_join, packing, pii, prefix_trie, quality, secrets, suffix_dedup, topk
from .common import table


def vocabulary() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def op1_suffix_dedup(spark, sf):
    return suffix_dedup.dedup(table(spark, sf, "documents"))


def op2_personal_data(spark, sf):
    return pii.digest(pii.spans(pii.extract(table(spark, sf, "documents"))))


def op3_source_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    labelled = mixing.labelled_documents(docs, table(spark, sf, "labels"))
    return mixing.rates(docs, labelled, mixing.TARGETS).drop("mark", "row")


def op4_ngram_jaccard(spark, sf):
    return ngram_join.join(table(spark, sf, "documents"))


def op5_secret_scan(spark, sf):
    return secrets.digest(secrets.scan(table(spark, sf, "documents")))


def op6_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary())


def op7_quality_classifier(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_nearest_neighbours(spark, sf):
    return nearest.embeddings_nearest(table(spark, sf, "embeddings"))


def op9_main_text(spark, sf):
    return html.extract(table(spark, sf, "pages"))


def op10_exact_topk(spark, sf):
    return topk.embeddings_top(table(spark, sf, "embeddings"))


def op11_prefix_trie(spark, sf):
    return prefix_trie.nodes(table(spark, sf, "conversations"))


def op12_merkle_manifest(spark, sf):
    return merkle.prove(table(spark, sf, "documents"))


def op13_language_id(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


_TOPK_SQL = """
    WITH v AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.row, q.vec_id AS query_id, c.vec_id, greatest(-9223372036854775807, least(9223372036854775807,
            list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1]::HUGEINT * x[2]::HUGEINT))))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row AND len(q.v) = len(c.v))
    SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 20"""


def queries():
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    import corpus_pipeline  # it imports this module

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op5_secret_scan": secrets.sql(), "op10_exact_topk": _TOPK_SQL, "op11_prefix_trie": prefix_trie.sql(),
            "op12_merkle_manifest": merkle.sql()}
