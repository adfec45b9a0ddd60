"""Column-expression building blocks (no jobs, no Python per row)."""

from .dates import iso_to_local_midnight, parse_duration_us, parse_us_datetime
from .hashing import hash_key, hash_sql
from .mathx import (clip, dagostino_k2, finite_or_null, nonzero_or, safe_div, safe_ln,
                    sample_kurt, sample_skew, skew_kurt_exprs)
from .text import (CURRENCY_SYNONYMS, EVAL_CODES, LABELS, RANK_CODES, drop_first_word, lookup_label,
                   mentioned_currencies, parse_response, strip_ws, token_array, token_count,
                   truncate_chars, truncate_tokens, word_count)

__all__ = [n for n in dir() if not n.startswith("_")]
