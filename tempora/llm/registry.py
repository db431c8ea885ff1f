"""The queries of this subpackage, for __spark_entry__.py."""

from . import ann, bpe, conversations, jaccard, language, merkle, mtree, packing, quality, substrings, token_counts, toxicity, warc

def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": _pipeline,
    "op1_mtree": mtree.op1_mtree,
    "op2_bpe": bpe.op2_bpe,
    "op3_language_id": language.op3_language_id,
    "op4_ann": ann.op4_ann,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_substrings": substrings.op7_substrings,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle": merkle.op11_merkle,
    "op12_conversations": conversations.op12_conversations,
    "op13_quality": quality.op13_quality,
}
ORACLES: dict[str, str] = {
    "op1_mtree": mtree.ORACLE,
    "op13_quality": quality.ORACLE,
    "op9_warc": """
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
        g AS (SELECT digest, max(page_id) AS keeper FROM p WHERE size >= 1000 GROUP BY digest)
        SELECT p.page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
            CASE WHEN g.keeper IS NOT NULL AND p.page_id IS DISTINCT FROM g.keeper THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN g.keeper IS NOT NULL AND p.page_id IS DISTINCT FROM g.keeper THEN g.keeper END AS refers_to
        FROM p LEFT JOIN g ON p.digest = g.digest AND p.size >= 1000
    """,
}
