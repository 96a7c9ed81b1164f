"""Column expressions for turning raw text into tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a whitespace split treats as separators (Unicode white space).
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# The same characters for Java's matcher, which gives up on an ordinary character after one comparison.
_SEPARATORS = f"[[^!-~]&&{WHITESPACE[:-1]}]+"
# Fixed value: punctuation deleted from tokens of partitioned corpora.
PUNCTUATION = ".,!?"
# Fixed value: runs of non-word characters followed by a blank, deleted from labelled texts.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+ "


def split_words(text: Column) -> Column:
    """Whitespace split without empty pieces."""
    return F.array_remove(F.split(text, _SEPARATORS), "")


def strip_characters(text: Column, chars: str = PUNCTUATION) -> Column:
    """Delete every occurrence of the given characters."""
    if len(chars) > 8:
        return F.translate(text, chars, "")
    # Most words have none of a few characters, and are then passed on as they are.
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def drop_non_word_runs(text: Column) -> Column:
    return F.regexp_replace(text, NON_WORD_RUN, "")
