"""The queries of the operators, by name, and SQL where SQL can express one."""

from tabia.llm.chosen_path import op8_chosen_path_join
from tabia.llm.collocations import ORACLE_OP13, op13_phrase_collocations
from tabia.llm.context_tree import op5_context_tree
from tabia.llm.feistel_shards import op4_feistel_shards
from tabia.llm.gru_toxicity import op7_gru_toxicity
from tabia.llm.html_extract import op2_html_extraction
from tabia.llm.importance_rules import op9_importance_quality
from tabia.llm.latent_retrieval import op6_latent_decontamination
from tabia.llm.line_runs import ORACLE_OP10, op10_line_runs
from tabia.llm.merkle_manifest import ORACLE_OP11, op11_merkle_manifest
from tabia.llm.nbest_pieces import op3_nbest_pieces
from tabia.llm.source_mixing import ORACLE_OP12, op12_source_mixing
from tabia.llm.token_counts import op1_token_attribution

QUERIES = {
    query.__name__: query
    for query in (
        op1_token_attribution,
        op2_html_extraction,
        op3_nbest_pieces,
        op4_feistel_shards,
        op5_context_tree,
        op6_latent_decontamination,
        op7_gru_toxicity,
        op8_chosen_path_join,
        op9_importance_quality,
        op10_line_runs,
        op11_merkle_manifest,
        op12_source_mixing,
        op13_phrase_collocations,
    )
}

ORACLES = {
    "op10_line_runs": ORACLE_OP10,
    "op11_merkle_manifest": ORACLE_OP11,
    "op12_source_mixing": ORACLE_OP12,
    "op13_phrase_collocations": ORACLE_OP13,
}
