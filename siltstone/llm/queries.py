"""The queries of the training-data operators, and SQL for those that SQL can express.

op11, op12 and op13 have SQL. op1 and op8 need tokenizers, op2 and op3 compare sets and vectors across all rows (too slow
on whole tables), op4 and op10 fit models, op5, op6, op7 and op9 need digests or automata that DuckDB lacks.
tests/llm holds those against brute force, libraries, other parsers, round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.ann import op3_one_bit_ann
from siltstone.llm.bpe import op8_byte_bpe
from siltstone.llm.centroids import OP12_SQL, op12_simplex_clusters
from siltstone.llm.exactdup import OP13_SQL, op13_exact_dedup
from siltstone.llm.html_text import op9_html_layout
from siltstone.llm.lexical import OP11_SQL, op11_dual_tree_search
from siltstone.llm.licenses import op6_license_scan
from siltstone.llm.neardup import op2_minhash_forest
from siltstone.llm.packing import op1_best_fit_packing
from siltstone.llm.quality import op4_quality_rules
from siltstone.llm.sharding import op7_rendezvous_sharding
from siltstone.llm.toxicity import op10_toxicity
from siltstone.llm.warc import op5_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_minhash_forest,
        op3_one_bit_ann,
        op4_quality_rules,
        op5_warc_derivatives,
        op6_license_scan,
        op7_rendezvous_sharding,
        op8_byte_bpe,
        op9_html_layout,
        op10_toxicity,
        op11_dual_tree_search,
        op12_simplex_clusters,
        op13_exact_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_dual_tree_search": OP11_SQL, "op12_simplex_clusters": OP12_SQL, "op13_exact_dedup": OP13_SQL}
