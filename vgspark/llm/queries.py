"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversations import OP11_SQL, op11_conversation_repair
from .decontaminate import op5_decontamination
from .hamming import OP6_SQL, op6_hamming_topk
from .lines import OP3_SQL, op3_line_dedup
from .mixing import op1_mixing
from .partenum import OP12_SQL, op12_ngram_jaccard
from .pitman_yor import op7_pitman_yor
from .secrets import op9_secrets
from .simhash import op4_simhash
from .suffixes import op10_suffix_dedup
from .surrogates import op2_surrogates
from .toxicity import op8_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_surrogates": op2_surrogates,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_hamming_topk": op6_hamming_topk,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ngram_jaccard": op12_ngram_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op6_hamming_topk": OP6_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_ngram_jaccard": OP12_SQL,
}
