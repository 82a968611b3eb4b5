"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from terrafold.llm import oracles
from terrafold.llm.alignment import op13_bitset_alignment
from terrafold.llm.bpe import op4_forced_boundary_bpe
from terrafold.llm.bwt_dedup import op8_bwt_merge_dedup
from terrafold.llm.decontaminate import op7_suffix_automaton
from terrafold.llm.filter_audit import op11_filter_interaction_audit
from terrafold.llm.imatch import op9_imatch_fingerprints
from terrafold.llm.jaccard_join import op5_heavy_light_jaccard
from terrafold.llm.kd_sharding import op2_kd_sharding
from terrafold.llm.line_dedup import op12_bloom_line_dedup
from terrafold.llm.pii import op3_bootstrapped_pii
from terrafold.llm.substring_dedup import op6_substring_dedup
from terrafold.llm.token_count import op1_overlap_token_counts
from terrafold.llm.toxicity import op10_factorization_toxicity

_ALL = (
    op1_overlap_token_counts,
    op2_kd_sharding,
    op3_bootstrapped_pii,
    op4_forced_boundary_bpe,
    op5_heavy_light_jaccard,
    op6_substring_dedup,
    op7_suffix_automaton,
    op8_bwt_merge_dedup,
    op9_imatch_fingerprints,
    op10_factorization_toxicity,
    op11_filter_interaction_audit,
    op12_bloom_line_dedup,
    op13_bitset_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {
    "op5_heavy_light_jaccard": oracles.JACCARD,
    "op6_substring_dedup": oracles.SUBSTRING,
    "op7_suffix_automaton": oracles.CONTAMINATION,
    "op8_bwt_merge_dedup": oracles.BYTES,
    "op11_filter_interaction_audit": oracles.AUDIT,
    "op12_bloom_line_dedup": oracles.LINES,
}
