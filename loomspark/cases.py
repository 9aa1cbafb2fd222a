"""Literal cases: what a comment is cleaned to, derived by hand."""

from __future__ import annotations

CLEANED: tuple[tuple[str, str], ...] = (
    ("@naoki9911", "A GitHub user is mentioned."),
    ("@naoki9911 @lolita123", "Multiple GitHub users are mentioned."),
    ("@nodejs/tsc", "A team from a GitHub organization is mentioned."),
    ("/cc @bart0sh", "A GitHub user is mentioned."),
    ("/test", "/workflow_ci"),
    ("/test all\n/lgtm", "/workflow_ci /workflow_review"),
    ("/hold until it is fixed", "/workflow_blocking"),
    ("/hold, until it is fixed!", "until it is fixed!"),
    ("I agree with @alice on this implementation.", "I agree with a GitHub user on this implementation."),
    ("Visit https://example.com, please.", "Visit /url_reference, please."),
    ("See https://example.com).", "See /url_reference )."),
    ("[the documentation](https://docs.djangoproject.com/en/5.0/)", "the documentation /url_reference"),
    ("<!-- META -->", "/html_meta_comment"),
    ("Visible: 0% - 100%", "/visual_artifact_reference"),
    ('<a href="https://example.com/docs">documentation</a>', "documentation"),
    ("Looks good :)", "Looks good /emoji_sonrisa"),
    ("Thanks 👍", "Thanks /emoji_aprobacion"),
    ("so true 🇪🇸 🚀", "so true /emoji_flag_reference /emoji_other"),
    ("/lgtm > x", "Based on the quotation, x"),
    ("Hi @alice and @bob! thank you", "Hi. Multiple GitHub users are mentioned. The comment thanks them for their work so far."),
    ("HEY @bob, see @carl", "Hey. A GitHub user is mentioned. , see a GitHub user"),
    ("thanks @bob !", "The comment thanks a GitHub user."),
    ("thank you @bob, @carl and @dora for this", "The comment thanks multiple GitHub users. for this"),
    ("@bob can you check the build?", "A GitHub user is asked to review or check this. the build?"),
    ("@bob what do you think", "A GitHub user is mentioned. The message asks for that user's opinion."),
    ("@bob @carl I think it is fine, what do you think?", "Multiple GitHub users are mentioned. I think it is fine The message then asks for their opinion."),
    ("@bob would it make sense to split this", "A GitHub user is mentioned. It asks whether it would make sense to split this"),
    ("@bob please rebase", "A GitHub user is asked to review or check this. rebase"),
    ("@org/team is this right?", "A team from a GitHub organization is mentioned. It asks: is this right?"),
    ("@org/team please review the change", "A team from a GitHub organization is asked to review or check the comment. please review the change"),
    ("call with @a: done", "call with a GitHub user: done"),
    ("> hello @bob", 'based on the quotation: "hello a GitHub user"'),
    (">> deep", '(citing: "deep")'),
    ('> he said "no"', "based on the quotation: 'he said \"no\"'"),
    ("```python\nx = 1\n```", "/Code_block_attached."),
    ("fixed in abcdef1234", "fixed in /hash_reference"),
    ("see nodejs/node#123 and #45", "see /repo_issue_reference and /issue_reference"),
    ("CI: green", "/ci_status_reference"),
    ("Codecov Report", "/coverage_report_reference"),
    ("ERROR it broke", "/log_reference"),
    ("latency got worse", "/benchmark_reference"),
    ("3 tests failed today", "/Error_log_attached."),
    ("dependabot bumped it", "/automated_bot_message dependabot bumped it"),
    ("[APPROVALNOTIFIER] This PR is **APPROVED**", "/approval_notification"),
    ("### suggestion", "/code_suggestion"),
    ("return x", "/inline_code"),
    ("use `x` now", "use /inline_code now"),
    ("   ", ""),
    ("LGTM.", "LGTM."),
)

#: Comments with emotion, and the tags found in them.
EMOTIONS: tuple[tuple[str, int, str], ...] = (
    ("fine :) and :eyes:", 2, "/emoji_atencion,/emoji_sonrisa"),
    ("\U0001f44d\U0001f44d", 2, "/emoji_aprobacion"),
    ("\u2764\ufe0f\u200d\U0001f525", 1, "/emoji_amor"),
    ("none", 0, ""),
)
