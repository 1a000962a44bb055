"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm.ann import op9_ann
from corpusloom.llm.byte_bpe import op8_byte_bpe
from corpusloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from corpusloom.llm.html_text import op6_html_text
from corpusloom.llm.langid import op7_langid
from corpusloom.llm.ngram_join import OP13_SQL, op13_ngram_join
from corpusloom.llm.packing import op10_packing
from corpusloom.llm.pii import op2_pii
from corpusloom.llm.simhash import op3_simhash
from corpusloom.llm.spelling import OP11_SQL, op11_spelling
from corpusloom.llm.suffix_dedup import op1_suffix_dedup
from corpusloom.llm.token_files import op5_token_files
from corpusloom.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_simhash, op4_exact_dedup, op5_token_files, op6_html_text, op7_langid, op8_byte_bpe, op9_ann, op10_packing, op11_spelling, op12_vector_codes, op13_ngram_join)}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op11_spelling": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_ngram_join": OP13_SQL}
