"""The queries of this folder and their SQL, for the registry at the repository's top."""

from .alignment import op13_alignment
from .bpe import op4_byte_bpe
from .collocations import op12_collocations
from .compression_quality import op5_compression_quality
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .jaccard_join import op7_jaccard_join
from .line_dedup import OP11_SQL, op11_line_dedup
from .mixing import op10_mixing
from .pii import op8_pii
from .quality_rules import OP9_SQL, op9_quality_rules
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op3_toxicity
from .warc_revisits import OP6_SQL, op6_warc_revisits

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_compression_quality": op5_compression_quality,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op6_warc_revisits": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_line_dedup": OP11_SQL,
}
