"""Patterns of the other dialect as Spark expressions."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: What the other dialect strips: all Unicode white space.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    """Single blanks stay as they are, so only other runs cost a replacement."""
    return strip(F.regexp_replace(text, rf"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*", " "))


def has_any(text: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    """One alternation, so that the text is scanned once."""
    return text.rlike(f"(?{'i' if ignore_case else ''}Uds)" + "|".join(f"(?:{p})" for p in patterns))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whole-text match with any pattern."""
    return text.rlike(r"(?Uds)\A(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z")


_WIDER_SPACE, _WIDER = r"\s\x0b\x1c-\x1f\x{85}\pZ", {r"\s": r"\s\x0b\x1c-\x1f\x{85}\pZ", r"\d": r"\p{Nd}", r"\w": r"\pL\pM\pN\p{Pc}\x{200c}\x{200d}"}
#: Letters beyond ASCII that a pattern without regard to case takes for i, s and k.
_FOLDED = "(?-i:[\u0130\u0131\u017f\u212a])"


def superset(pattern: str) -> str:
    """A pattern of linear time (RE2) that is found wherever the given one is, in the text itself or in its squeezed form: without look-arounds, with
    any white space for a blank, and without word boundaries where they may be beside other than ASCII."""
    lines = bool(re.match(r"\(\?[a-z]*m", pattern))
    pattern = re.sub(r"\(\?<?[!=](?:\[[^\]]*\]|[^()\[\]])*\)", "", pattern)
    if re.search(r"\\[dw]", pattern):
        pattern = pattern.replace(r"\b", "")
    ends = {"^": "^" if lines else rf"\A[{_WIDER_SPACE}]*", "$": "$" if lines else rf"[{_WIDER_SPACE}]*\z", " ": f"[{_WIDER_SPACE}]+"}
    out = []
    for part in re.findall(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|.", pattern, re.S):
        if part[0] == "[" and part[1] != "^":
            own = re.sub(r"\\[sdw]", lambda m: _WIDER[m[0]], part)
            out.append(f"(?:{own}|[{_WIDER_SPACE}]+)" if " " in part else own)
        else:
            out.append(f"[{_WIDER[part]}]" if part in _WIDER else ends.get(part, part))
    return "".join(out)


def _searched(texts: pa.Array, patterns: Iterable[str], ignore_case: bool) -> list[pa.Array]:
    """Whether each pattern is found in each text; texts that a batch repeats are searched once."""
    coded = texts.dictionary_encode()
    return [pc.match_substring_regex(coded.dictionary, p, ignore_case=ignore_case).take(coded.indices) for p in patterns]


def may_match(text: Column, lists: dict[str, Iterable[str]], ignore_case: bool = True) -> Column:
    """A struct that tells for each list of patterns whether any of them can be found in the text at all: one linear pass a list over Arrow batches, which
    leaves few texts to has_any(). False is certain; a null text has null."""
    own = {name: "(?s)" + "|".join([*(f"(?:{superset(p)})" for p in patterns), *[_FOLDED] * (ignore_case or any(p.startswith("(?i") for p in patterns))]) for name, patterns in lists.items()}

    @F.arrow_udf("struct<" + ", ".join(f"{name}: boolean" for name in own) + ">")
    def search(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_searched(texts, own.values(), ignore_case), list(own))

    return search(text)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed a single time for each row, however often or deep in other lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
