"""Registered queries of this subpackage."""

from __future__ import annotations

from .byte_bpe import op3_merge_replay_bpe
from .concat_cut import op11_concatenate_and_cut
from .context_tree import op10_context_tree_scores
from .embedding_dedup import op9_quantised_embedding_dedup
from .lemp_search import ORACLE_SQL as RANKING_SQL
from .lemp_search import op12_norm_bucket_search
from .ngram_join import op5_partition_signature_join
from .packing import op1_best_fit_packing
from .pii import op2_pii_checked_spans
from .quality import op7_weak_quality_rules
from .repair_files import op4_repair_token_files
from .secret_scan import op6_assignment_secrets
from .toxicity import op8_nearest_toxicity
from .whitening import op13_jacobi_davidson_whitening

LLM_QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing,
    op2_pii_checked_spans,
    op3_merge_replay_bpe,
    op4_repair_token_files,
    op5_partition_signature_join,
    op6_assignment_secrets,
    op7_weak_quality_rules,
    op8_nearest_toxicity,
    op9_quantised_embedding_dedup,
    op10_context_tree_scores,
    op11_concatenate_and_cut,
    op12_norm_bucket_search,
    op13_jacobi_davidson_whitening,
)}
LLM_ORACLES: dict[str, str] = {"op12_norm_bucket_search": RANKING_SQL}
