"""The whole cleaning of a comment: what needs a line's context, a lookup or Unicode normal forms.

The steps are plain functions of a text, composed in STEPS; `cleaned` and its kin run them over Arrow batches. Each is total:
a null or blank text gives '' (or 0, or no items), and no input raises, so one bad row never fails a job.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import COMMANDS, DIFF_SIGNS, TEAM_MENTION, USER_MENTION

register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

# Tags, sentences, names and patterns that results depend on.
CODE, DIFF, ERROR_LOG, BOT, URL, LINK = "/Code_block_attached.", "/Diff_attached.", "/Error_log_attached.", "/automated_bot_message", "/url_reference", "/html_link_reference"
LANGUAGES = (
    "python", "py", "javascript", "js", "typescript", "ts", "java", "c", "cpp", "c++", "csharp", "cs", "go", "ruby", "rb", "php", "swift", "kotlin", "scala", "rust",
    "r", "sql", "bash", "shell", "sh", "zsh", "powershell", "ps1", "html", "css", "scss", "sass", "xml", "json", "yaml", "yml", "dockerfile", "makefile", "gradle",
)
MENTIONED = {
    ("user", False): "A GitHub user is mentioned.",
    ("user", True): "Multiple GitHub users are mentioned.",
    ("team", False): "A team from a GitHub organization is mentioned.",
    ("team", True): "Multiple teams from GitHub organizations are mentioned.",
}
ASKED = {
    ("user", False): "A GitHub user is asked to review or check this.",
    ("user", True): "Multiple GitHub users are asked to review or check this.",
    ("team", False): "A team from a GitHub organization is asked to review or check the comment.",
    ("team", True): "Multiple teams from GitHub organizations are asked to review or check the comment.",
}
REVIEW_CUES = "please review|can you review|could you review|please take a look|take a look|can you check|could you check|check this|ptal"
REQUESTS = "please|can you|could you|would you|take a look|check|review|have a look"
PROPOSALS = "would it make sense to|does it make sense to|maybe we should|perhaps we should|it might make sense to"
QUESTIONS = "would|could|can|should|do|does|is|are|what|why|how"
WORKFLOW = {
    "/assign": "/workflow_coordination", "/unassign": "/workflow_coordination", "/cc": "/workflow_coordination", "/sig": "/workflow_coordination",
    "/wg": "/workflow_coordination", "/label": "/workflow_coordination", "/remove-label": "/workflow_coordination", "/milestone": "/workflow_coordination",
    "/priority": "/workflow_coordination", "/remove-priority": "/workflow_coordination", "/kind": "/workflow_coordination", "/remove-kind": "/workflow_coordination",
    "/triage": "/workflow_coordination", "/test": "/workflow_ci", "/retest": "/workflow_ci", "/retest-required": "/workflow_ci",
    "/ok-to-test": "/workflow_ci", "/skip": "/workflow_ci", "/approve": "/workflow_review", "/lgtm": "/workflow_review",
    "/hold": "/workflow_blocking", "/close": "/workflow_blocking", "/reopen": "/workflow_blocking",
}
BOTS = r"(?i)\[bot\]|ci[\-_]robot|triage[\-_]robot|dependabot|renovate|greenkeeper|codecov|coveralls|mergify|stale\[bot\]|allcontributors|nodejs-github-bot|welcome[\-_]bot|onboarding[\-_]bot|approval[\-_]bot|review[\-_]bot|flaky[\-_]bot|retest[\-_]bot"
BOT_KINDS = (
    ("triage_bot", r"(?i)triage[\-_]robot|triage[\-_]bot"),
    ("approval_notifier", r"(?i)approval[\-_]bot|review[\-_]bot|mergify"),
    ("retest_flaky_bot", r"(?i)flaky[\-_]bot|retest[\-_]bot|ci[\-_]robot|codecov|coveralls"),
    ("onboarding_bot", r"(?i)welcome[\-_]bot|onboarding[\-_]bot|allcontributors"),
)
CI_LINE, COVERAGE_LINE = r"(?i)\s*(?:CI|V8 CI|CITGM):\s*.+$", r"(?i)\s*(?:Codecov|Coveralls)\b.*$"
# blanks within some alternatives were lost where results come from, so these only match what has none
ERROR_SIGNS = r"(?im)^(?:ERROR|FAIL|FAILED|FATAL)[:\s]|Traceback\(mostrecentcalllast\)|={6,}\s*\n(?:FAIL|ERROR):|FAILED\(errors=\d+|\b\d+\s+(?:test|tests)\s+failed\b|panic:\s+runtime\s+error|^\s*[A-Za-z_][A-Za-z0-9_]*Error:|^\s*Exception:|^\s*Causedby:|\bexitcode\s+\d+\b"
ERROR_SIGNS_FIXED = ERROR_SIGNS.replace("mostrecentcalllast", "most recent call last").replace(r"Traceback\(", r"Traceback \(").replace(r"FAILED\(", r"FAILED \(").replace("Causedby", "Caused by").replace("exitcode", "exit code")
LOG_LINE = r"""(?im)^\s*(?:\[[^\]]+\]\s*)?(?:INFO|DEBUG|WARN|WARNING|ERROR|TRACE|FATAL)\b.*$|^\s*at\s+.+$|^\s*File\s+"[^"]+",\s+line\s+\d+.*$|^\s*Causedby:.*$"""
BENCHMARK_LINE = r"(?im)^\s*.*(?:\b\d+(?:\.\d+)?\s*(?:ns/op|µs/op|us/op|ms/op|s/op)\b|\b\d+(?:\.\d+)?\s*(?:ops/sec|op/s|iter/s|iterations/s)\b|\bbenchmark\b|\bthroughput\b|\blatency\b).*$"
COMMIT_LINE = r"(?i)\bLine\s+\d+\s+in\s+\[?/hash_reference\]?\([^)]+\)"
BARE_CODE_LINE = r"""(?m)^\s*["']?\s*(?:(?:private|public|protected|readonly|const|let|var|def|class|return|import|from)\b|[A-Za-z_][A-Za-z0-9_]*\s*[:=]\s*[^,\n]+|.*//.*).*$"""
LINKS = (r"\[([^\]]+)\]\((?:https?://[^\s)]+|www\.[^\s)]+)\)", r"\[([^\]]+)\]\(https?:/[^\s)]+\)", r"\[([^\]]+)\]\([^)\s]+\)")
RAW_URLS = (r"""(?i)\b(?:https?://|www\.)[^\s<>()\[\]{}"']+""", r"""(?i)\bhttps?:/[^\s<>()\[\]{}"']+""")
HTML = (
    (r"(?is)<details\b.*?>.*?</details>", " /html_details_block "),
    (r"(?is)<img\b[^>]*>", " /html_image_reference "),
    (r"(?is)The committers listed above are authorized under a signed CLA\..*?(?=\n|$)", " /automated_cla_check "),
    (r"""(?is)<a\b[^>]*href\s*=\s*["']?[^"'>\s]+[^>]*>(.*?)</a>""", None),
    (r"(?is)<!--\s*.*?\s*-->", " /html_meta_comment "),
    (r"(?im)^\s*Visible:\s*\d+%\s*-\s*\d+%\s*$", "/visual_artifact_reference"),
    (r"(?is)</?(?:details|summary|sub|sup|br|hr|p|div|span|table|tr|td|th|thead|tbody|img|a|ul|li|ol)\b[^>]*>", " "),
    (r"[ \t]+", " "),
    (r" *\n *", "\n"),
)
REFERENCES = ((r"\b[\w.-]+/[\w.-]+#\d+\b", "/repo_issue_reference"), (r"(?<![\w/])#\d+\b", "/issue_reference"), (r"(?im)^\s*index\s+[0-9a-f]+\.\.[0-9a-f]+\s+\d+\s*$", "/hash_reference"), (r"(?i)\b[0-9a-f]{40}\b", "/hash_reference"), (r"(?i)\b[0-9a-f]{7,12}\b", "/hash_reference"), (r"[ \t]+", " "))
EMOJI = {
    "😂": "/emoji_risa", "🤣": "/emoji_risa", "😄": "/emoji_risa", "😆": "/emoji_risa", "😁": "/emoji_risa", "😹": "/emoji_risa",
    "🙂": "/emoji_sonrisa", "😊": "/emoji_sonrisa", "☺️": "/emoji_sonrisa", "😇": "/emoji_sonrisa", "😍": "/emoji_amor", "🥰": "/emoji_amor",
    "😘": "/emoji_amor", "💚": "/emoji_amor", "❤️": "/emoji_amor", "❤": "/emoji_amor", "🎉": "/emoji_celebra", "🎊": "/emoji_celebra",
    "🏅": "/emoji_celebra", "🎁": "/emoji_celebra", "👏": "/emoji_celebra", "✨": "/emoji_celebra", "👍": "/emoji_aprobacion", "✅": "/emoji_aprobacion",
    "👎": "/emoji_rechaza", "❌": "/emoji_rechaza", "😢": "/emoji_tristeza", "😞": "/emoji_tristeza", "😡": "/emoji_rabia", "👹": "/emoji_asco",
    "🤔": "/emoji_confusion", "😕": "/emoji_confusion", "😐": "/emoji_confusion", "🤦": "/emoji_confusion", "🤦\u200d♀️": "/emoji_confusion", "😌": "/emoji_calma",
    "🙇": "/emoji_calma", "😉": "/emoji_sarcasmo", "😅": "/emoji_sarcasmo", "👀": "/emoji_atencion", "👋": "/emoji_aprobacion", "🙏": "/emoji_esperanza",
}
#: Which tag speaks for a cluster of several emoji; a smile never does.
CLUSTER_ORDER = (
    "/emoji_amor", "/emoji_risa", "/emoji_celebra", "/emoji_aprobacion", "/emoji_rechaza", "/emoji_tristeza", "/emoji_rabia", "/emoji_asco",
    "/emoji_miedo", "/emoji_sorpresa", "/emoji_confusion", "/emoji_sarcasmo", "/emoji_calma", "/emoji_intenso", "/emoji_atencion", "/emoji_esperanza",
)
EMOTICONS = (
    (r":-D|:D|=D|xD|XD|XDD|:\'D", "/emoji_risa"), (r":-\)|:\)|=\)|\^\^", "/emoji_sonrisa"), (r"<3", "/emoji_amor"), (r":-\(|:\(|:\'\(|T_T|;_;", "/emoji_tristeza"), (r">:\(|D:<", "/emoji_rabia"), (r":-O|:O|O_O|o_O", "/emoji_sorpresa"),
    (r":-/|:/|:\\\\|o\.O|O\.o", "/emoji_confusion"), (r";-\)|;\)|:-P|:P|:-p|:p|XP", "/emoji_sarcasmo"),
)
SHORTCODES = ((r"(?i):eyes:", "/emoji_atencion"),)
FLAG = "[\U0001f1e6-\U0001f1ff]{2}"
_PICTURE = "[\U0001f300-\U0001faff\u2600-\u27bf]\ufe0f?[\U0001f3fb-\U0001f3ff]?"
CLUSTER = f"{FLAG}|{_PICTURE}(?:\u200d{_PICTURE})*"

# -- what the steps are made of

_KNOWN = re.compile("|".join(sorted(EMOJI, key=len, reverse=True)))
_NAME = r"@[A-Za-z0-9_.-]+"
_SEVERAL = rf"(?:{_NAME}\s*(?:,|\band\b)?\s*){{2,}}"
_FENCE = re.compile(r"```([A-Za-z0-9_+\-]*)\s*\n(.*?)\n\s*```", re.S)
_QUOTED_FENCE = re.compile(r"^\s*>\s*```[A-Za-z0-9_+\-]*[ \t]*\n(?:^\s*>\s?.*\n)*?^\s*>\s*```", re.M)


def _low(text: str) -> str:
    """In lower case, with the letters that patterns without regard to case take for i, s and k."""
    if not text.isascii():
        for letter, plain in _FOLDS:
            text = text.replace(letter, plain)
    return text.lower()


_FOLDS = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))
#: What a text must have, in lower case, for a pattern to be found in it at all; looking for that costs far less than the pattern.
NEEDED: dict[str, tuple[str, ...]] = {
    BOTS: ("bot", "renovate", "greenkeeper", "codecov", "coveralls", "mergify", "allcontributors"),
    ERROR_SIGNS: ("error", "fail", "fatal", "traceback", "panic:", "exception:", "causedby", "exitcode"),
    ERROR_SIGNS_FIXED: ("error", "fail", "fatal", "traceback", "panic:", "exception:", "caused", "exit"),
    BENCHMARK_LINE: ("/op", "/s", "benchmark", "throughput", "latency"),
    COMMIT_LINE: ("hash_reference",),
    TEAM_MENTION: ("@",),
    USER_MENTION: ("@",),
    **{p: ("](",) for p in LINKS},
    **dict(zip(RAW_URLS, (("http", "www."), ("http",)))),
    **dict(zip((p for p, _ in HTML), (("<",), ("<",), ("the committers",), ("<",), ("<",), ("visible:",), ("<",), ("  ", "\t"), (" \n", "\n ")))),
    **dict(zip((p for p, _ in REFERENCES), (("#",), ("#",), ("index",)))),
    **dict(zip(DIFF_SIGNS, (("diff",), ("@@",), ("---",), ("+++",), ("index",)))),
    **dict(zip((p for p, _ in EMOTICONS), (("d",), (")", "^^"), ("<3",), ("(", "t_t", ";_;"), (">:(", "d:<"), ("o",), (":", "o.o"), (";", ":", "xp")))),
    **{p: (":",) for p, _ in SHORTCODES},
    "\r\n|\r": ("\r",),
    r"\n{3,}": ("\n\n\n",),
}


def _can(pattern: str, text: str, low: str | None = None) -> bool:
    needed = NEEDED.get(pattern)
    if needed is None:
        return True
    low = _low(text) if low is None else low
    return any(x in low for x in needed)


def _replaced(text: str, steps) -> str:
    low = None
    for pattern, tag in steps:
        if pattern in NEEDED and low is None:
            low = _low(text)
        if _can(pattern, text, low):
            text, before = re.sub(pattern, tag, text), text
            low = low if text == before else None
    return text


def _by_line(text: str, kinds) -> str:
    """A line that starts like a kind becomes its tag; others stay."""
    return "\n".join(next((tag for pattern, tag in kinds if re.match(pattern, line.strip())), line) for line in text.splitlines())


def _labelled(words: str, tag: str) -> str:
    return " ".join([*words.split(), tag])


# -- links, markup, references


def links(text: str) -> str:
    text = _replaced(text, ((pattern, lambda m: _labelled(m[1], URL)) for pattern in LINKS))
    text = _replaced(text, ((pattern, lambda m: f" {URL}{m[0][len(m[0].rstrip('.,;:!?)]}')) :]} ") for pattern in RAW_URLS))
    return _replaced(text, ((r"[ \t]+", " "),)).strip()


def markup(text: str) -> str:
    return _replaced(text, ((p, tag if tag is not None else (lambda m: _labelled(m[1], LINK))) for p, tag in HTML)).strip()


def ci_reports(text: str) -> str:
    return _by_line(text, ((CI_LINE, "/ci_status_reference"), (COVERAGE_LINE, "/coverage_report_reference")))


def references(text: str) -> str:
    kinds = ((BENCHMARK_LINE, "/benchmark_reference"), (LOG_LINE, "/log_reference"))
    return _replaced(_by_line(text, kinds[not _can(BENCHMARK_LINE, text) :]), REFERENCES).strip()


def breaks(text: str) -> str:
    return _replaced(text, (("\r\n|\r", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")))


# -- bots


def bot_kind(author: str | None, text: str | None) -> str:
    """'' for people; the first kind that name or words tell, else other_bot."""
    both = f"{author or ''} {text or ''}"
    return next((kind for kind, p in BOT_KINDS if re.search(p, both)), "other_bot") if _can(BOTS, both) and re.search(BOTS, both) else ""


def mark_bot(text: str, author: str | None = "") -> str:
    """A bot's text is marked, unless all its lines are reports."""
    if not bot_kind(author, text):
        return text
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    reports = lines and all(re.match(CI_LINE, x) or re.match(COVERAGE_LINE, x) for x in lines)
    return text.strip() if reports else f"{BOT} {text.strip()}".strip()


# -- code


def is_diff(text: str) -> bool:
    low = _low(text)
    return sum(_can(p, text, low) and bool(re.search(f"(?m){p}", text)) for p in DIFF_SIGNS) >= 2


def fence_tag(language: str | None, body: str, errors: str = ERROR_SIGNS) -> str:
    named = (language or "").strip().lower()
    if named == "diff" or is_diff(body):
        return DIFF
    return ERROR_LOG if named not in LANGUAGES and _can(errors, body) and re.search(errors, body) else CODE


def fences(text: str) -> str:
    """Each fenced block, quoted ones first, becomes a line with its kind."""
    tagged = lambda m: f"\n{fence_tag(m[1], m[2])}\n"

    def unquoted(m: re.Match) -> str:
        block = "\n".join(re.sub(r"^\s*>\s?", "", line) for line in m[0].splitlines())
        inner = _FENCE.search(block)
        return tagged(inner) if inner else block

    return _FENCE.sub(tagged, _QUOTED_FENCE.sub(unquoted, text)) if "```" in text else text


def code(text: str, errors: str = ERROR_SIGNS) -> str:
    """Inline code, fences; then a text that is a diff or has signs of an error is nothing else."""
    text = fences(re.sub("`([^`\n]+)`", "/inline_code", text))
    text = DIFF if is_diff(text) else text
    return breaks(ERROR_LOG if _can(errors, text) and re.search(errors, text) else text).strip()


# -- quotes


def quotes(text: str | None) -> tuple[list[str], str]:
    """What is quoted, and the text with quotes told in words. A quoted fence runs to its closing line; if unquoted text comes first, that line ends it and is lost."""
    found: list[str] = []
    out: list[str] = []
    open_fence: list[str] = []
    depth = 0

    def close() -> None:
        block = fences("\n".join(open_fence).strip()).strip() or CODE
        open_fence.clear()
        tell(block, depth, "" if depth == 1 else None)

    def tell(said: str, deep: int, mark: str | None = None) -> None:
        mark = ("'" if '"' in said else '"') if mark is None else mark
        found.append(said)
        out.append(f"based on the quotation: {mark}{said}{mark}" if deep == 1 else f"(citing: {mark}{said}{mark})")

    for line in (text or "").splitlines():
        prefix = re.match(r"\s*>[>\s]*", line)
        said = re.sub(r"\A(?:\s*>\s?)+", "", line).rstrip()
        if open_fence:
            if prefix:
                open_fence.append(said)
            if not prefix or said.strip().startswith("```"):
                close()
        elif not prefix:
            out.append(line)
        elif said.strip().startswith("```"):
            open_fence, depth = [said.strip()], prefix[0].count(">")
        elif said.strip():
            tell(anonymous(said.strip()), prefix[0].count(">"))
        else:
            out.append("")
    if open_fence:
        close()
    return found, "\n".join(out).strip()


# -- workflow


def commands(text: str | None) -> list[str]:
    return re.findall(rf"(?m)(?<!\S)(/(?:{COMMANDS}))\b", text or "")


def command_kinds(text: str | None) -> list[str]:
    return sorted({WORKFLOW[c] for c in commands(text)})


def only_commands(text: str | None) -> bool:
    return bool(re.fullmatch(rf"\s*(?:/(?:{COMMANDS})(?:\s+[@\w.\-/]+)*\s*)+", (text or "").strip()))


def plain_cc(text: str) -> str:
    """A text that only tells whom to copy is coordination; such a beginning goes."""
    m = re.match(r"(?im)\s*cc\s+@?[\w.\-]+(?:\s+@?[\w.\-]+)*(.*)$", text.strip())
    if not m:
        return text
    return re.sub(r"^[,;:.-]+\s*", "", m[1].strip()) or "/workflow_coordination"


def workflow(text: str) -> str:
    kinds = command_kinds(text)
    rest = plain_cc(text.strip())
    if rest == "/workflow_coordination" or not kinds:
        return rest
    if not only_commands(text):
        rest = _replaced(rest, ((rf"(?<!\S)/(?:{COMMANDS})\b", ""), (r"[ \t]+", " "))).strip()
        rest = _replaced(rest, ((r"^[,;:.-]+\s*", ""), (r"\s+([,;:.!?])", r"\1")))
        if rest:
            return rest
    return " ".join(kinds)


# -- emotion


def cluster_tag(cluster: str) -> str:
    if re.fullmatch(FLAG, cluster):
        return "/emoji_flag_reference"
    if cluster in EMOJI:
        return EMOJI[cluster]
    inside = {tag for emoji, tag in EMOJI.items() if emoji in cluster}
    return next((tag for tag in CLUSTER_ORDER if tag in inside), "/emoji_other")


def emotions(text: str) -> str:
    """Emoji and emoticons as tags, all white space single blanks."""
    text = _replaced(unicodedata.normalize("NFKC", text), ((p, f" {tag} ") for p, tag in SHORTCODES))
    plain = text.isascii()  # has no emoji
    text = text if plain else _KNOWN.sub(lambda m: f" {EMOJI[m[0]]} ", text)
    text = _replaced(text, ((p, f" {tag} ") for p, tag in EMOTICONS))
    return " ".join((text if plain else re.sub(CLUSTER, lambda m: f" {cluster_tag(m[0])} ", text)).split())


def _emotion_hits(text: str | None) -> list[str]:
    norm = unicodedata.normalize("NFKC", text or "")
    low = _low(norm)
    plain = [tag for p, tag in (*SHORTCODES, *EMOTICONS) if _can(p, norm, low) for _ in re.finditer(p, norm)]
    return plain if norm.isascii() else plain + [cluster_tag(m[0]) for m in re.finditer(CLUSTER, norm)]


# -- mentions


def anonymous(text: str) -> str:
    return _replaced(text, ((COMMIT_LINE, "/commit_line_reference"), (TEAM_MENTION, "a team from a GitHub organization"), (USER_MENTION, "a GitHub user")))


def n_teams(text: str) -> int:
    return len(re.findall(TEAM_MENTION, text))


def n_users(text: str) -> int:
    """Mentions of users outside of teams' mentions."""
    return sum(not re.match(TEAM_MENTION, text[m.start() :]) for m in re.finditer(USER_MENTION, text))


def _starts(text: str, words: str) -> re.Match | None:
    return re.match(rf"(?i)\s*(?:{words})\b[\s,:-]*", text)


def addressed(rest: str, who: str, many: bool, review: bool) -> str:
    """What is said to those named first: opinion, review, proposal, question, request or statement."""
    rest = " ".join(re.sub(r"^[\s,;:.-]+", "", rest).split())
    said, asked = MENTIONED[who, many], ASKED[who, many]
    person = who == "user"
    whose = "their" if many else "that user's"
    without = lambda words: rest[m.end() :].strip() if person and (m := _starts(rest, words)) else rest
    if not rest:
        return said
    if person and re.fullmatch(r"(?i)what do you think|thoughts\??", rest):
        return f"{said} The message asks for {whose} opinion."
    if person and re.match(r"(?is)(?:i think|i believe|in my opinion|imo)\b.*\b(?:what do you think\??|thoughts\??)\s*$", rest):
        main = re.match(r"(?is)(.*?)[,;:\s-]*(?:what do you think\??|thoughts\??)\s*$", rest)
        return f"{said} {main[1].strip()} The message then asks for {whose} opinion."
    if review:
        return f"{asked} {without(REVIEW_CUES)}".rstrip()
    if _starts(rest, PROPOSALS):
        first = "would it make sense to"
        return f"{said} It asks whether " + (f"it would make sense to {rest[len(first) :].strip()}" if person and rest.lower().startswith(first) else rest)
    if _starts(rest, QUESTIONS):
        return f"{said} It asks: {rest}"
    if _starts(rest, REQUESTS):
        return f"{asked} {without(REQUESTS)}".rstrip()
    return f"{said} {rest}"


def _leading(text: str) -> str | None:
    """The text in other words if it starts with mentions of one sort only."""
    teams, users, review = n_teams(text), n_users(text), bool(re.search(rf"(?i)\b(?:{REVIEW_CUES})\b", text))
    if teams and not users and (m := re.match(r"\s*(?:@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\s*)+(.+)$", text, re.S)):
        return addressed(m[1], "team", teams > 1, review)
    if users and not teams and (m := re.match(rf"\s*((?:{_NAME}\s*)+)(.*)$", text, re.S)):
        return addressed(m[2], "user", m[1].count("@") > 1, review)
    return None


def _alone(text: str) -> str | None:
    """The sentence for a text that has nothing but mentions."""
    if re.fullmatch(r"\s*(?:@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\s*)+", text):
        return MENTIONED["team", n_teams(text) > 1]
    if re.fullmatch(rf"\s*(?:{_NAME}\s*)+", text):
        return MENTIONED["user", n_users(text) != 1]
    return None


def _quoted(said: str) -> str:
    """A quote that a step before left behind."""
    if not said or (alone := _alone(said)):
        return alone if said else ""
    if n_teams(said) and not n_users(said) and (m := re.match(r"(?:@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\s*)+(.+)$", said, re.S)):
        rest = " ".join(re.sub(r"^[\s,;:.-]+", "", m[1]).split())
        return f"Based on the quotation, {MENTIONED['team', False]} {rest}".rstrip()
    return "Based on the quotation, " + (_leading(said) or anonymous(said))


def _then(first: str, rest: str) -> str:
    return f"{first} {rest.strip()}".rstrip()


def _greeting(m: re.Match, many: bool) -> str:
    opening, rest = f"{m[1].capitalize()}. {MENTIONED['user', many]}", anonymous(m[2].strip())
    return f"{opening} The comment thanks them for their work so far." if _starts(rest, "thank you") else _then(opening, rest)


#: Forms of address, in order: pattern and the sentence made of its match.
FORMS: tuple[tuple[re.Pattern, Callable[[re.Match], str]], ...] = (
    (re.compile(rf"(?i)(?:thanks|thank you)[,\s]+{_SEVERAL}[.!?]?\s*(.*)\Z"), lambda m: _then("The comment thanks multiple GitHub users.", m[1])),
    (re.compile(rf"(?i)(?:thanks|thank you)[,\s]+{_NAME}(?:\s*[.!?]?\s*|[.!?]?\s*(.*))\Z"), lambda m: _then("The comment thanks a GitHub user.", m[1] or "")),
    (re.compile(rf"(?is)(.*?\b(?:meeting|call|discussion|sync|chat)\s+with)\s+{_SEVERAL}(\s*[:.-]?)\s*(.*)\Z"), lambda m: _then(f"{m[1].strip()} multiple GitHub users{m[2].rstrip()}", m[3])),
    (re.compile(rf"(?is)(.*?\b(?:meeting|call|discussion|sync|chat)\s+with)\s+{_NAME}(\s*[:.-]?)\s*(.*)\Z"), lambda m: _then(f"{m[1].strip()} a GitHub user{m[2].rstrip()}", m[3])),
    (re.compile(rf"(?is)(Hi|Hello|Hey)\s+{_SEVERAL}[!?.]*\s*(.*)\Z"), lambda m: _greeting(m, True)),
    (re.compile(rf"(?is)(Hi|Hello|Hey)\s+{_NAME}[!?.]*\s*(.*)\Z"), lambda m: _greeting(m, False)),
)


def mentions(text: str | None) -> str:
    """One line or paragraph with its mentions told in words."""
    line = (text or "").strip()
    if "@" not in line and not line.startswith(">"):
        return anonymous(line)
    if m := re.match(r"(?:>\s*)+(.*)\Z", line):
        return _quoted(m[1].strip())
    if alone := _alone(line):
        return alone
    for pattern, make in FORMS:
        if m := pattern.match(line):
            return make(m)
    return _leading(line) or anonymous(line)


def mentions_by_line(text: str) -> str:
    return "\n".join(told for line in text.splitlines() if (told := mentions(line)) or not line.strip()).strip()


# -- the whole

STEPS: tuple[Callable[[str], str], ...] = (
    breaks, links, markup, ci_reports, references,
    lambda t: re.sub("`([^`\n]+)`", "/inline_code", t),
    lambda t: re.sub(BARE_CODE_LINE, "/inline_code", t),
    lambda t: re.sub(r"(?im)^\s*#{0,6}\s*suggestion\s*$", "/code_suggestion", t),
    code,
    lambda t: quotes(t)[1],
    lambda t: re.sub(r"(?is)\[APPROVALNOTIFIER\].*?\bAPPROVED\b(?:\*\*)?", "/approval_notification", t),
    lambda t: re.sub(rf"(?i)(?<!\w)/?cc\s+{_NAME}(?:\s+as well)?", MENTIONED["user", False], t),
    workflow, emotions, mentions_by_line, anonymous, breaks, str.strip,
)


def clean_comment(text: str | None, author: str | None = "") -> str:
    """All steps in their order; an author only tells bots."""
    if not (text or "").strip():
        return ""
    out = mark_bot(_replaced(text, ((COMMIT_LINE, "/commit_line_reference"),)), author)
    for step in STEPS:
        out = step(out)
    return out


# -- on columns


def _column(f: Callable, kind: str) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t if isinstance(t, str) else ""))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def cleaned(text: Column, author: Column | None = None) -> Column:
    def run(texts: pd.Series, authors: pd.Series) -> pd.Series:
        return pd.Series([clean_comment(t, a) for t, a in zip(texts, authors)], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "authors": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text, author if author is not None else F.lit(""))


def quoted(text: Column) -> Column:
    """What a comment quotes."""
    return _column(lambda t: quotes(t)[0], "array<string>")(text)


def emotion_types(text: Column) -> Column:
    return _column(lambda t: sorted(set(_emotion_hits(t))), "array<string>")(text)


def emotion_count(text: Column) -> Column:
    return _column(lambda t: len(_emotion_hits(t)), "int")(text)


def workflow_kinds(text: Column) -> Column:
    return _column(command_kinds, "array<string>")(text)


def bot(author: Column, text: Column) -> Column:
    """Native: the kind of bot, '' for people."""
    both = F.concat_ws(" ", F.coalesce(author, F.lit("")), F.coalesce(text, F.lit("")))
    out = F.when(~both.rlike(f"(?U){BOTS}"), "")
    for kind, p in BOT_KINDS:
        out = out.when(both.rlike(f"(?U){p}"), kind)
    return out.otherwise("other_bot")
