"""The queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import quality, ranked, reputation
from lintlake.llm.alignment import op11_token_alignment
from lintlake.llm.decontam import op10_benchmark_overlaps
from lintlake.llm.langid import op1_language_id
from lintlake.llm.lm import op3_lm_scores
from lintlake.llm.packing import op2_packed_sequences
from lintlake.llm.render import op6_html_text
from lintlake.llm.secretscan import op5_secret_scan
from lintlake.llm.simhash import op8_simhash_components
from lintlake.llm.substrings import op7_suffix_dedup
from lintlake.llm.tokencounts import op12_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_packed_sequences, op3_lm_scores, quality.op4_quality_rules, op5_secret_scan, op6_html_text,
        op7_suffix_dedup, op8_simhash_components, reputation.op9_url_reputation, op10_benchmark_overlaps,
        op11_token_alignment, op12_token_counts, ranked.op13_ranked_search,
    )
}

SQL: dict[str, str] = {
    "op4_quality_rules": quality.SQL, "op9_url_reputation": reputation.SQL, "op13_ranked_search": ranked.SQL,
}
