"""The queries and SQL of this package."""

from __future__ import annotations

from tessera.llm.ann import op7_ann
from tessera.llm.chat import OP4_SQL, op4_chat_format
from tessera.llm.chosenpath import op11_chosen_path
from tessera.llm.decontaminate import op5_decontaminate
from tessera.llm.lines import op6_line_dedup
from tessera.llm.manifest import OP13_SQL, op13_merkle
from tessera.llm.pii import op9_pii
from tessera.llm.quantize import OP12_SQL, op12_vector_codes
from tessera.llm.sentencepieces import op3_sentencepiece
from tessera.llm.simhash import op2_simhash
from tessera.llm.substrings import op1_substrings
from tessera.llm.tokenfiles import op8_token_files
from tessera.llm.toxicity import op10_toxicity

QUERIES = {"op1_substrings": op1_substrings, "op2_simhash": op2_simhash, "op3_sentencepiece": op3_sentencepiece, "op4_chat_format": op4_chat_format, "op5_decontaminate": op5_decontaminate, "op6_line_dedup": op6_line_dedup, "op7_ann": op7_ann, "op8_token_files": op8_token_files, "op9_pii": op9_pii, "op10_toxicity": op10_toxicity, "op11_chosen_path": op11_chosen_path, "op12_vector_codes": op12_vector_codes, "op13_merkle": op13_merkle}
ORACLE_SQL: dict[str, str] = {"op4_chat_format": OP4_SQL, "op12_vector_codes": OP12_SQL, "op13_merkle": OP13_SQL}
