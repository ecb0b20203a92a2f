"""Column functions shared by all operators."""

from .hashing import cache_id, uniform
from .numbers import cosine_schedule, plain_string, scientific_string
from .text import WHITESPACE, capitalise, computed_once, one_line, strip, word_list

__all__ = [
    "WHITESPACE",
    "cache_id",
    "capitalise",
    "computed_once",
    "cosine_schedule",
    "one_line",
    "plain_string",
    "scientific_string",
    "strip",
    "uniform",
    "word_list",
]
