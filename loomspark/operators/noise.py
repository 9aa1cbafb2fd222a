"""Noise levels of cleaned comments: hard_noise, operational_noise, or neither."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark import constants as C
from loomspark.functions.regex import SPACE, has_any, matches_any, may_match, squeeze, strip


def _low(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def residue(text: Column) -> Column:
    """What is left of a text without placeholders."""
    out = text
    for p in C.PLACEHOLDERS_TO_REMOVE:
        out = F.replace(out, F.lit(p), F.lit(" "))
    for p in (*C.GENERIC_USER_PLACEHOLDERS, *C.LOW_VALUE_VISUAL_PATTERNS):
        out = F.regexp_replace(out, p, " ")
    return squeeze(out)


def only_commands(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"\A/[a-zA-Z0-9_-]+((?U)\s+[a-zA-Z0-9_.-]+)?\z"))


def _hard(t: Column) -> Column:
    """Few texts can have a phrase or a placeholder; the others are not searched again, and their residue is the squeezed text."""
    marked = t.rlike(r"\A(?:" + "|".join(C.AUTOMATED_PREFIX_MARKERS) + ")")
    may = may_match(t, {"phrase": C.HARD_PHRASE_PATTERNS, "gone": (*C.PLACEHOLDERS_TO_REMOVE, *C.GENERIC_USER_PLACEHOLDERS, *C.LOW_VALUE_VISUAL_PATTERNS)}, False)
    phrase = F.when(may["phrase"], has_any(t, C.HARD_PHRASE_PATTERNS, False)).otherwise(False)
    short = F.when(may["gone"], F.length(residue(t)) <= 3).otherwise(t.rlike(rf"(?s)\A(?:.{{0,3}}|.{SPACE}+.)\z"))
    commands = F.when(t.startswith("/"), only_commands(t)).otherwise(False)
    return marked | matches_any(t, C.HARD_EXACT_PATTERNS) | commands | phrase | short


def _operational(t: Column) -> Column:
    return matches_any(t, (*C.OPERATIONAL_EXACT_PATTERNS, *C.OPERATIONAL_PHRASE_PATTERNS))


def is_hard(text: Column) -> Column:
    return _hard(_low(text))


def is_operational(text: Column) -> Column:
    t = _low(text)
    return ~_hard(t) & _operational(t)


def noise_level(text: Column, neither: str = "useful") -> Column:
    """neither: 'useful' in the offline profile, 'none' in the online one."""
    t = _low(text)
    return F.when(_hard(t), "hard_noise").when(_operational(t), "operational_noise").otherwise(neither)


# Why a comment has its level.
REASONS = {
    "hard_noise": "Ruido estructural, automático, placeholder o comentario sin contenido interpretable",
    "operational_noise": "Ruido operacional: interacción humana mínima de PR/revisión sin suficiente valor sociotécnico causal",
    "useful": "Contenido útil: comentario con valor técnico, comunicacional, organizacional o sociotécnico para análisis causal",
}


def noise_reason(level: Column) -> Column:
    """In words; empty for a level without one."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))[level], F.lit(""))
