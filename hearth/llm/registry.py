"""The subpackage's queries and their SQL."""

from hearth.llm.q_chat import OP8_SQL, op8_chat_format
from hearth.llm.q_colloc import OP11_SQL, op11_collocations
from hearth.llm.q_decontam import OP5_SQL, op5_decontaminate
from hearth.llm.q_fagin import OP13_SQL, op13_hard_negatives
from hearth.llm.q_shard import op3_shard
from hearth.llm.q_simhash import op1_simhash
from hearth.llm.q_bpe import op7_bpe
from hearth.llm.q_repeats import OP9_SQL, op9_repeats
from hearth.llm.q_quality import op6_quality
from hearth.llm.q_pii import op10_pii
from hearth.llm.q_ann import op4_ann
from hearth.llm.q_licence import op2_licences
from hearth.llm.q_lempel import op12_fingerprints

QUERIES = {
    "op2_licences": op2_licences,
    "op4_ann": op4_ann,
    "op10_pii": op10_pii,
    "op6_quality": op6_quality,
    "op9_repeats": op9_repeats,
    "op7_bpe": op7_bpe,
    "op1_simhash": op1_simhash,
    "op3_shard": op3_shard,
    "op5_decontaminate": op5_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op11_collocations": op11_collocations,
    "op12_fingerprints": op12_fingerprints,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op5_decontaminate": OP5_SQL, "op8_chat_format": OP8_SQL, "op9_repeats": OP9_SQL, "op11_collocations": OP11_SQL, "op13_hard_negatives": OP13_SQL}
