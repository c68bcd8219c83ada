"""Column -> Column functions (all JVM-side built-ins)."""

from toxiscope.functions.text import (  # noqa: F401
    aggressive_clean, light_clean, no_clean, text_length, clip_length,
    word_tokens, vector_tokens, clean_tokens, word_ngrams, verdict, slug,
    split_to_lang, CLEANERS,
)
from toxiscope.functions.numeric import (  # noqa: F401
    ratio_round, sigmoid, finite_or_zero,
)
