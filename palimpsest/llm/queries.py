"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from palimpsest.llm import ann, byte_bpe, decontaminate, language_id, quality, sharding, simhash, token_counts, token_files, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        url_filters.op1_url_filters,
        sharding.op2_sharding,
        ann.op3_ann,
        quality.op4_quality,
        byte_bpe.op5_byte_bpe,
        language_id.op6_language_id,
        token_files.op7_token_files,
        decontaminate.op8_decontamination,
        token_counts.op9_token_counts,
        simhash.op10_simhash,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_url_filters": url_filters.ORACLE_SQL}
