"""Comment text: signals and the cleaners that plain expressions can say. A null text has no signals and cleans to ''."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.regex import may_match, strip

# Signals, tags and patterns that results depend on.
SIGNALS = {
    "has_wip_signal": r"\bWIP\b",
    "has_review_signal": r"\b(PTAL|review required|please review|can you review|could you review|take a look|can you check|could you check|pinging)\b",
    "has_agreement_signal": r"(?<!\w)\+1(?!\w)|\bIIUC\b",
    "has_uncertainty_signal": r"\b(I am not sure|I'm not sure|not sure|maybe|perhaps|I think|IIUC|do you mean|could it be)\b",
    "has_frustration_signal": r"\b(frustrating|exhausting|annoying|painful|blocked|stuck|this is hard|this is difficult)\b",
    "has_help_request_signal": r"\b(can you help|could you help|need help|any help|could someone help|help me understand)\b",
    "has_urgency_signal": r"\b(asap|urgent|urgently|blocking|time-sensitive|high priority)\b",
    "has_politeness_signal": r"\b(thanks|thank you|please|appreciate it|much appreciated|sorry)\b",
    "has_disagreement_signal": r"\b(I disagree|I don't think|this is not correct|I don't agree|not convinced|I'm not convinced|I think this is wrong)\b",
}
USER_MENTION, TEAM_MENTION = r"(?<!\w)@([A-Za-z0-9_.-]+)\b", r"(?<!\w)@([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
COMMANDS = "assign|unassign|cc|sig|wg|label|remove-label|milestone|priority|remove-priority|kind|remove-kind|triage|test|retest|retest-required|ok-to-test|skip|approve|lgtm|hold|close|reopen"
DIFF_SIGNS = (r"^\s*diff --git\b", r"^\s*@@\s*-\d+(?:,\d+)?\s+\+\d+(?:,\d+)?\s*@@", r"^\s*---\s+[ab]/.+", r"^\s*\+\+\+\s+[ab]/.+", r"^\s*index\s+[0-9a-f]+\.\.[0-9a-f]+\s+\d+")
HTML_STEPS = (
    (r"(?is)<details\b.*?>.*?</details>", " /html_details_block "),
    (r"(?is)<img\b[^>]*>", " /html_image_reference "),
    (r"(?i)The committers listed above are authorized under a signed CLA\.[^\n]*", " /automated_cla_check "),
    (r"""(?is)<a\b[^>]*href\s*=\s*["']?[^"'>\s]+[^>]*>\s*</a>""", "/html_link_reference"),
    (r"""(?is)<a\b[^>]*href\s*=\s*["']?[^"'>\s]+[^>]*>\s*(.*?)\s*</a>""", r"\1 /html_link_reference"),
    (r"(?is)<!--\s*.*?\s*-->", " /html_meta_comment "),
    (r"(?im)^\s*Visible:\s*\d+%\s*-\s*\d+%\s*$", "/visual_artifact_reference"),
    (r"(?is)</?(?:details|summary|sub|sup|br|hr|p|div|span|table|tr|td|th|thead|tbody|img|a|ul|li|ol)\b[^>]*>", " "),
    (r"[ \t]+", " "),
    (r" *\n *", "\n"),
)
#: What a raw text refers to or holds; found in any of the patterns. Blanks within the pattern of "Caused by:" were lost where results come from.
FLAGS = {
    "has_issue_ref": (r"(?<![\w/])#\d+\b", r"\b[\w.-]+/[\w.-]+#\d+\b"),
    "has_hash_reference": (r"(?i)\b[0-9a-f]{40}\b", r"(?im)^\s*index\s+[0-9a-f]+\.\.[0-9a-f]+\s+\d+\s*$"),
    "has_log_reference": (r"""(?im)^\s*(?:\[[^\]]+\]\s*)?(?:INFO|DEBUG|WARN|WARNING|ERROR|TRACE|FATAL)\b.*$""", r"(?im)^\s*at\s+.+$", r"""(?im)^\s*File\s+"[^"]+",\s+line\s+\d+.*$""", r"(?im)^\s*Causedby:.*$"),
    "has_benchmark_reference": (r"(?i)\b\d+(?:\.\d+)?\s*(?:ns/op|µs/op|us/op|ms/op|s/op)\b", r"(?i)\b\d+(?:\.\d+)?\s*(?:ops/sec|op/s|iter/s|iterations/s)\b", r"(?i)\b(?:benchmark|throughput|latency)\b"),
    "has_raw_url": (r"""(?i)\b(?:https?://|www\.)[^\s<>()\[\]{}"']""", r"""(?i)\bhttps?:/[^\s<>()\[\]{}"']"""),
    "has_markdown_link": (r"\[[^\]]+\]\((?:https?://|www\.)[^\s)]+\)", r"\[[^\]]+\]\(https?:/[^\s)]+\)"),
    "has_html_markup": (r"(?is)<details\b.*?>.*?</details>", r"(?is)<!--.*?-->", r"(?is)</?(?:details|summary|sub|sup|br|hr|p|div|span|table|tr|td|th|thead|tbody|img|a|ul|li|ol)\b[^>]*>"),
    "has_visual_artifact": (r"(?im)^\s*Visible:\s*\d+%\s*-\s*\d+%\s*$",),
    "has_ci_status_line": (r"(?im)^\s*(?:CI|V8 CI|CITGM):\s*.+$",),
    "has_codecov_report": (r"(?im)^\s*Codecov\b.*$",),
    "has_coverage_report": (r"(?im)^\s*Coveralls\b.*$",),
}


def flags(text: Column) -> dict[str, Column]:
    """Eleven flags of what a text refers to; a null has none. A linear pass tells which of them a text can have at all."""
    may = may_match(text, FLAGS, False)
    return {name: F.when(may[name], text.rlike("(?Ud)" + "|".join(f"(?:{p})" for p in patterns))).otherwise(False) for name, patterns in FLAGS.items()}


def signals(text: Column) -> dict[str, Column]:
    """Nine social signals."""
    return {name: F.coalesce(text.rlike(f"(?iUd){p}"), F.lit(False)) for name, p in SIGNALS.items()}


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_breaks(text: Column) -> Column:
    out = F.regexp_replace(_filled(text), "\r\n|\r", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "\t", " "), " +", " ")
    return F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{3,}", "\n\n")


def clean_inline_code(text: Column) -> Column:
    return F.regexp_replace(_filled(text), "`([^`\n]+)`", "/inline_code")


def replace_diffs(text: Column) -> Column:
    """A text with two or more signs of a diff is nothing but a diff."""
    signs = sum((F.coalesce(text.rlike(f"(?Udm){p}"), F.lit(False)).cast("int") for p in DIFF_SIGNS), F.lit(0))
    return F.when(signs >= 2, F.lit("/Diff_attached.")).otherwise(_filled(text))


def replace_references(text: Column) -> Column:
    """Issues and hashes, in this order."""
    out = _filled(text)
    for p, tag in ((r"\b[\w.-]+/[\w.-]+#\d+\b", "/repo_issue_reference"), (r"(?<![\w/])#\d+\b", "/issue_reference"), (r"(?im)^\s*index\s+[0-9a-f]+\.\.[0-9a-f]+\s+\d+\s*$", "/hash_reference"), (r"(?i)\b[0-9a-f]{40}\b", "/hash_reference"), (r"(?i)\b[0-9a-f]{7,12}\b", "/hash_reference")):
        out = F.regexp_replace(out, f"(?Ud){p}", tag)
    return strip(F.regexp_replace(out, "[ \t]+", " "))


def replace_raw_urls(text: Column) -> Column:
    """A URL becomes a tag; punctuation at its end stays."""
    out = F.regexp_replace(_filled(text), r"""(?iUd)\b(?:https?:/{1,2}|www\.)[^\s<>()\[\]{}"']*?([.,;:!?]*)(?=[\s<>()\[\]{}"']|\z)""", " /url_reference$1 ")
    return strip(F.regexp_replace(out, "[ \t]+", " "))


def replace_html(text: Column) -> Column:
    """Details, images, links (their words stay, line breaks in them too), comments, artifacts, then plain tags."""
    out = _filled(text)
    for p, tag in HTML_STEPS:
        out = F.regexp_replace(out, p, tag.replace("\\1", "$1"))
    return strip(out)


def count_team_mentions(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_count(text, F.lit(f"(?Ud){TEAM_MENTION}"))).otherwise(0)


def count_user_mentions(text: Column) -> Column:
    """Mentions of users that are not part of a team's."""
    return F.when(text.contains("@"), F.regexp_count(F.regexp_replace(text, f"(?Ud){TEAM_MENTION}", " "), F.lit(f"(?Ud){USER_MENTION}"))).otherwise(0)


def slash_commands(text: Column) -> Column:
    """The look-behind comes after the slash, which few places have."""
    return F.regexp_extract_all(_filled(text), F.lit(rf"(?Udm)(/(?<!\S/)(?:{COMMANDS}))\b"), F.lit(1))


def anonymize_mentions(text: Column) -> Column:
    out = F.regexp_replace(_filled(text), f"(?Ud){TEAM_MENTION}", "a team from a GitHub organization")
    return F.regexp_replace(out, f"(?Ud){USER_MENTION}", "a GitHub user")


def first_words(text: Column, n: int) -> Column:
    """Only the beginning that has them is split."""
    beginning = F.regexp_extract(_filled(text), rf"(?U)\A(?:\s*+\S++){{0,{n}}}", 0)
    return F.array_join(F.filter(F.split(beginning, r"(?U)\s+"), lambda w: w != ""), " ")


_KEPT, _BLANK = b"abcdefghijklmnopqrstuvwxyz0123456789", b" \t\n\x0b\f\r"
_OTHERS = bytes(c for c in range(256) if c not in _KEPT + _BLANK)
_TO_BLANKS = bytes(c if c in _KEPT + b"-" else 32 for c in range(256))


def _bytewise(text: Column, change: Callable[[bytes], bytes]) -> Column:
    """change() of each text's UTF-8, which gives ASCII; a match a word costs a regular expression far more."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else change(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())

    return run(text)


def normalize_name(text: Column) -> Column:
    """Lower case, only letters, digits and single blanks."""

    def change(raw: bytes) -> bytes:
        left = raw.translate(None, _OTHERS)
        words = b" ".join(left.split())
        return (b" " if left[:1] in _BLANK and left else b"") + words + (b" " if left[-1:] in _BLANK and words else b"")

    return _bytewise(strip(F.lower(_filled(text))), change)


def plain_words(text: Column) -> Column:
    """Lower-case words of letters, digits and hyphens, single blanks between them."""
    return _bytewise(F.lower(_filled(text)), lambda raw: b" ".join(raw.translate(_TO_BLANKS).split()))


def local_name(uri: Column) -> Column:
    """What follows `#`, else the last part of the path."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def list_cell(cell: Column) -> Column:
    """The strings of a list as it is printed (`['a', "b"]`); anything else is an empty list."""
    inner = F.regexp_extract(F.trim(_filled(cell)), r"(?s)\A\[(.*)\]\z", 1)
    items = F.regexp_extract_all(inner, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    return F.transform(items, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def any_cell(cell: Column) -> Column:
    """As list_cell(), but a text that is no list and no word for nothing is a list of itself."""
    own = strip(_filled(cell))
    return F.when(F.lower(own).isin("", "nan", "none", "[]"), F.array().cast("array<string>")).when(own.rlike(r"(?s)\A\[.*\]\z"), list_cell(own)).otherwise(F.array(own))


def bullet_cell(cell: Column) -> Column:
    """The lines of a cell without bullets and blanks around them, blank ones left out."""
    lines = F.transform(F.split(_filled(cell), "\n"), lambda x: strip(F.replace(strip(x), F.lit("•"), F.lit(""))))
    return F.filter(lines, lambda x: x != "")


def visible_list(items: Column) -> Column:
    """A list as lines of a cell: stripped, without nulls and blank ones."""
    return F.array_join(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != ""), "\n")


def for_model(text: Column) -> Column:
    """A comment as a model is asked about it: at most one blank line in a row, stripped."""
    return strip(F.when(text.contains("\n\n\n"), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(_filled(text)))


def query_text(text: Column, most_words: int = 60) -> Column:
    """The first words as they are."""
    return first_words(text, most_words)
