"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .conversation_trie import OP13_SQL, op13_prefix_trie
from .decontaminate import OP5_SQL, op5_decontamination
from .embedding_dedup import op2_embedding_dedup
from .line_dedup import OP4_SQL, op4_line_dedup
from .masked_lm import op10_masked_lm
from .ngram_join import op9_ngram_join
from .packing import op7_packing
from .quality import op8_quality_neighbours
from .secrets import op1_secret_scan
from .substring_dedup import op6_substring_dedup
from .toxicity import op11_toxicity
from .url_filter import op3_url_filter

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_embedding_dedup, op3_url_filter, op4_line_dedup, op5_decontamination, op6_substring_dedup,
    op7_packing, op8_quality_neighbours, op9_ngram_join, op10_masked_lm, op11_toxicity,
    op12_collocations, op13_prefix_trie)}
ORACLE = {"op4_line_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op12_collocations": OP12_SQL,
          "op13_prefix_trie": OP13_SQL}
