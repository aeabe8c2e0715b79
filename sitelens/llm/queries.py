"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_codec import op13_byte_bpe
from .embedding_dedup import op6_embedding_dedup
from .html_text import op3_html_extraction
from .lattice_lm import op1_lattice_lm
from .license_scan import op9_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .minhash_dedup import op5_minhash_dedup
from .mixing import OP8_SQL, op8_mixing
from .periodic_runs import op11_periodic_runs
from .permutation_index import op7_nearest_neighbours
from .piece_codec import op2_sentencepiece
from .quality import op4_quality
from .spelling_variants import op12_spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality": op4_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
}
