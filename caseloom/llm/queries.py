"""All queries of the text operators."""

from . import (bpe, chat, exact, language, near, negatives, neighbours, packing, quality,  # noqa: F401
               spelling, substrings, token_counts, toxicity)  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
