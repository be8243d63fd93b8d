"""Column functions of the engine in one place."""

from ..operators.bands import adaptive_budget, band, cascade_k
from ..operators.dense import dot, unit
from ..operators.fusion import fused, structural
from ..operators.lexical import idf, name_tokens, word_tokens
from ..operators.manifest import canonical_json, object_or_text, row_key
from ..operators.wl import array_cosine, cosine
from ..sources.tables import one_of_text, quoted_term

__all__ = [
    "adaptive_budget", "array_cosine", "band", "canonical_json", "cascade_k", "cosine", "dot", "fused", "idf", "name_tokens",
    "object_or_text", "one_of_text", "quoted_term", "row_key", "structural", "unit", "word_tokens",
]
