"""Queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .cotraining import op8_quality
from .language import op3_language
from .mixing import OP7_SQL, op7_mixing
from .ngram_join import OP10_SQL, op10_ngram_join
from .packing import op5_packing
from .perspectives import OP6_SQL, op6_perspectives
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .token_files import op1_token_files
from .transport import op4_transport_streams
from .vectors import op9_nearest

QUERIES = {"op1_token_files": op1_token_files, "op2_suffix_dedup": op2_suffix_dedup, "op3_language": op3_language, "op4_transport_streams": op4_transport_streams, "op5_packing": op5_packing, "op6_perspectives": op6_perspectives, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_nearest": op9_nearest, "op10_ngram_join": op10_ngram_join}
SQL: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op6_perspectives": OP6_SQL, "op7_mixing": OP7_SQL, "op10_ngram_join": OP10_SQL}
