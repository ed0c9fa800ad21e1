"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from roadgrain.llm import embeddings, html_text, line_dedup, merkle, mixing, ngram_join, packing, phrases, quality, secrets, sharding, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_packing": packing.query,
    "op3_sharding": sharding.query,
    "op4_line_dedup": line_dedup.query,
    "op5_ngram_join": ngram_join.query,
    "op6_mixing": mixing.query,
    "op7_secrets": secrets.query,
    "op8_quality": quality.query,
    "op9_embeddings": embeddings.query,
    "op10_html_text": html_text.query,
    "op11_merkle": merkle.query,
    "op12_warc": warc.query,
    "op13_phrases": phrases.query,
}
ORACLE_SQL: dict[str, str] = {"op5_ngram_join": ngram_join.oracle(), "op6_mixing": mixing.oracle(), "op8_quality": quality.oracle(), "op9_embeddings": embeddings.oracle(), "op11_merkle": merkle.oracle(), "op12_warc": warc.oracle(), "op13_phrases": phrases.oracle()}
