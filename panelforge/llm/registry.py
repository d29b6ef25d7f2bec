"""The corpus queries by name, and the SQL of those that SQL can express."""

from panelforge.llm import negatives, reputation
from panelforge.llm.balance import op12_mixture
from panelforge.llm.conversations import op13_repair
from panelforge.llm.jaccard import op4_ngram_jaccard
from panelforge.llm.language import op5_language
from panelforge.llm.lines import op6_lines
from panelforge.llm.mixing import op8_mixing
from panelforge.llm.neighbours import op9_neighbours
from panelforge.llm.packing import op2_packing
from panelforge.llm.passages import op1_passages
from panelforge.llm.quality import op3_quality
from panelforge.llm.tiling import op10_tiling

QUERIES = {
    "op1_passages": op1_passages,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_language": op5_language,
    "op6_lines": op6_lines,
    "op7_reputation": reputation.op7_reputation,
    "op8_mixing": op8_mixing,
    "op9_neighbours": op9_neighbours,
    "op10_tiling": op10_tiling,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_mixture": op12_mixture,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {"op7_reputation": reputation.SQL, "op11_hard_negatives": negatives.SQL}
