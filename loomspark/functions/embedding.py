"""Vectors of texts without a model: words fall into cells by a hash. Any other embedder can take its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.regex import once, squeeze
from loomspark.functions.text import first_words

DIMENSIONS = 64
# What goes or changes before a text is embedded, in order.
EMBEDDING_STEPS = (
    (r"http\S+", " "), ("/url_reference", " "), ("/hash_reference", " "), ("/html_details_block", " "), ("/html_image_reference", " "), ("/inline_code", " inline_code "), ("/code_block_attached", " code_block "), ("/diff_attached", " diff_block "),
    ("(?i)A GitHub user is mentioned", " "), ("(?i)based on the quotation:", " "),
)


def embedding_text(text: Column, most_words: int = 120) -> Column:
    out = F.coalesce(text, F.lit(""))
    for p, tag in EMBEDDING_STEPS:
        out = F.regexp_replace(out, p, tag)
    return first_words(squeeze(out), most_words)


def short_text(text: Column, most_words: int = 60) -> Column:
    """Without URLs and commands, and not more words than that."""
    return first_words(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"http\S+", " "), r"(?U)/\w+", " "), most_words)


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """How many words fall into each cell; the cell is the first four hex digits of the word's MD5. Each word is hashed once."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dimensions)
    return once(cells, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(own, lambda c: c == i)).cast("double")))
