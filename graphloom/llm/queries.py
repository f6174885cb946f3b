"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from .graph_ann import op5_graph_ann
from .jaccard_join import OP1_SQL, op1_jaccard_join
from .language_id import op4_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .packing import op7_best_fit
from .quality_rules import OP10_SQL, op10_quality_rules
from .sentencepiece_bpe import op2_sentencepiece
from .suffix_dedup import op3_suffix_dedup
from .token_files import op6_token_files
from .warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_sentencepiece, op3_suffix_dedup, op4_language_id, op5_graph_ann,
        op6_token_files, op7_best_fit, op8_warc, op9_line_dedup, op10_quality_rules,
    )
}

#: The others have results that SQL cannot express; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op8_warc": OP8_SQL, "op9_line_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL}
