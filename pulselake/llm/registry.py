"""The opN_ queries and the SQL of those that SQL can express."""

from __future__ import annotations

from pulselake.llm import chat_format, decontaminate, ngram_join, prefix_trie, url_rules
from pulselake.llm.byte_bpe import op12_byte_bpe
from pulselake.llm.chat_format import op3_chat_format
from pulselake.llm.decontaminate import op9_benchmark_decontamination
from pulselake.llm.embedding_dedup import op1_embedding_near_dedup
from pulselake.llm.language_id import op2_language_id
from pulselake.llm.license_scan import op7_license_scan
from pulselake.llm.mixing import op5_mix_to_weights
from pulselake.llm.ngram_join import op10_ngram_jaccard_join
from pulselake.llm.pii import op6_pii
from pulselake.llm.prefix_trie import op13_prefix_trie
from pulselake.llm.quality import op8_quality
from pulselake.llm.url_rules import op4_url_rules
from pulselake.llm.whitening import op11_embedding_whitening

_ALL = (
    op1_embedding_near_dedup, op2_language_id, op3_chat_format, op4_url_rules, op5_mix_to_weights, op6_pii, op7_license_scan, op8_quality, op9_benchmark_decontamination,
    op10_ngram_jaccard_join, op11_embedding_whitening, op12_byte_bpe, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op4_url_rules": url_rules.ORACLE_SQL,
    "op9_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op10_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
