"""Closed vocabularies and rule lists."""

from __future__ import annotations

# Results depend on these exact words.
TERMINAL_JOB_STATUSES = ("succeeded", "failed", "stopped")
RECLAIMABLE_STATUSES = ("pending", "retrying", "stale")
ATTENTION_STATUSES = ("running", "retrying", "stale", "failed")
COMPLETED_FILE_STATUSES = ("success", "succeeded", "done", "completed")
FAILED_FILE_STATUSES = ("failed", "error")
SKIPPED_FILE_STATUSES = ("skipped",)
DEGRADED_PAGE_STATUSES = ("success_fallback_image",)
STAGE_LABELS = (
    "layout", "recognition", "primary_inference", "postprocess", "text_fallback", "image_fallback", "single_stage_ocr",
    "output", "other",
)
FAILURE_LABELS = (
    "none", "process_killed", "process_failed", "input_missing", "api_timeout", "model_unreachable",
    "model_output_invalid", "model_auth_failed", "model_rate_limited", "model_unavailable", "model_error",
    "resource_exhausted", "output_unwritable", "input_invalid", "artifact_missing", "input_changed", "parser_failed",
    "operator_stopped", "unknown", "other",
)

# Error texts are held against these rules in this order, the first that holds decides. A rule is a
# category and groups of fragments; it holds if of every group some fragment is in the lower-cased text.
FAILURE_RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("process_killed", (("sigkill", "signal 9", "killed", "terminated by signal"),)),
    ("resource_exhausted", (("cuda out of memory", "outofmemoryerror", "out of memory", "cannot allocate memory", "memoryerror"),)),
    ("input_missing", (("input file missing",),)),
    ("input_missing", (("input path",), ("does not exist",))),
    ("input_missing", (("no such file",), ("/input", ".pdf"))),
    ("api_timeout", (("timed out", "timeout"),)),
    ("model_unreachable", ((
        "connection refused", "connection reset", "connection aborted", "connect error", "failed to connect",
        "ssl certificate verify failed", "sslerror", "tls handshake failed", "name or service not known",
        "temporary failure in name resolution", "network is unreachable", "no route to host", "model unreachable",
    ),)),
    ("model_output_invalid", ((
        "invalid model response", "model response json", "failed to parse model response", "model output invalid",
        "jsondecodeerror", "invalid json from model", "expecting value", "response schema",
    ),)),
    ("model_auth_failed", ((
        "401", "403", "unauthorized", "forbidden", "invalid api key", "authentication failed", "permission denied for model",
    ),)),
    ("model_rate_limited", (("429", "rate limit", "too many requests", "throttled"),)),
    ("model_unavailable", ((
        "502", "503", "bad gateway", "service unavailable", "temporarily unavailable", "model overloaded",
        "server overloaded", "upstream unavailable",
    ),)),
    ("model_error", (("http ", "httpstatuserror", "status code", "rate limit", "too many requests", "model server"),)),
    ("output_unwritable", ((
        "no space left on device", "disk quota exceeded", "read-only file system", "isadirectoryerror", "notadirectoryerror",
    ),)),
    ("output_unwritable", (("no such file or directory",), ("output", "/out", "artifact", ".md", ".json", ".ocr_status.json"))),
    ("output_unwritable", (("permission denied",), ("output", "/out", "writing", "artifact"))),
    ("input_invalid", (("permission denied",), ("input", "/in", "source", ".pdf"))),
    ("input_invalid", ((
        "cannot open broken document", "failed to open file", "malformed pdf", "corrupt pdf", "filedataerror",
        "requires a password", "password protected", "encrypted pdf",
    ),)),
    ("artifact_missing", (("artifact_missing", "declared ocr artifacts are missing"),)),
    ("input_changed", (("input file changed", "changed since manifest snapshot"),)),
)

# Fragments of messages after which a call is worth repeating.
TRANSIENT_FRAGMENTS = (
    "timeout", "temporarily", "try again", "connection", "rate limit", "overloaded", "unavailable", "backlog",
    "empty response", "server busy",
)

# Letters that count for a language; on equal counts the earlier one of LANGUAGE_ORDER wins.
LANGUAGE_LETTERS = {
    "Chinese": "一-龥",
    "English": "A-Za-z",
    "French": "àâçéèêëîïôûùüÿñæœ",
    "German": "äöüßÄÖÜ",
    "Spanish": "áéíóúüñÁÉÍÓÚÜÑ",
    "Russian": "А-Яа-яЁё",
    "Japanese": "ぁ-ゔァ-ヴ一-龥々〆〤",
    "Arabic": "؀-ۿ",
    "Korean": "가-힣",
    "Thai": "ก-๛",
    "Turkish": "çğıöşüÇĞİÖŞÜ",
    "Portuguese": "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ",
    "Italian": "àèéìíòóùÀÈÉÌÍÒÓÙ",
    "Hungarian": "áéíóöőúüűÁÉÍÓÖŐÚÜŰ",
    "Czech": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ",
    "Swedish": "åäöÅÄÖ",
    "Serbian": "А-Яа-яЇїЂђЈјЉљЊњЋћЌќЏџ",
    "Vietnamese": "àáâãèéêìíòóôõùúýăđĩũơưẠ-ỹ",
    "Malay": "A-Za-z",
    "Indonesian": "A-Za-z",
    "Urdu": "؀-ۿ",
    "Persian": "؀-ۿ",
    "Afrikaans": "A-Za-z",
}
LANGUAGE_ORDER = (
    "Chinese", "English", "Japanese", "Korean", "Russian", "Spanish", "French", "German", "Portuguese", "Italian",
    "Hungarian", "Czech", "Swedish", "Serbian", "Turkish", "Vietnamese", "Thai", "Arabic", "Urdu", "Persian", "Malay",
    "Indonesian", "Afrikaans",
)

# Of the author-block score.
AUTHOR_STOP_WORDS = (
    "a", "an", "the", "in", "of", "for", "and", "is", "are", "was", "were", "on", "at", "to", "it", "as", "by", "with", "from",
)
AUTHOR_INSTITUTIONS = (
    "医院", "大学", "学院", "研究所", "中心", "附属", "人民医院", "医科大学", "研究院", "邮编", "通信作者", "重点实验室",
    "University", "Institute", "College", "Hospital", "Center", "Department", "School", "Laboratory", "Inc.", "Ltd.",
    "Correspondence", "email", "e-mail", "Oncology", "Medicine", "Received", "Accepted",
)
AUTHOR_DEGREES = ("MD", "PhD", "PHD", "MPH", "MLIS", "MBA")

# Patterns by which text blocks go on over a break, and the letters and marks around them.
NEW_PARAGRAPH = r"\s*(#+|　　|[■●◆➢]|[(\[（【].*?[)\]）】]|\d+[.、)\s]|[a-zA-Z][.)\s]|[一二三四五六七八九十百千]+[、.)\s]|[①-⑳])"
CONTENTS_ENTRY = r"[.…]{4,}"
SENTENCE_ENDS = "。？！.?!"
CLOSERS = "\"'”’』)）\\]"
PATH_CATEGORIES = ("Picture", "Page-header", "Page-footer", "Section-header", "Footnote")

# Patterns of Markdown marks, in the order in which they go.
PLAIN_STEPS = (
    (r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"[#*_>]", " "),
)
# Patterns of LaTeX in text, and of what stands before a document's body.
LATEX = r"(?s)\$\$.*?\$\$|\$[^$\n]+?\$|\\[a-zA-Z]+|\\\[.*?\\\]|\\\(.*?\\\)"
LATEX_PREAMBLE = (r"\\documentclass\{[^}]+\}", r"\\usepackage\{[^}]+\}", r"\\usepackage\[[^\]]*\]\{[^}]+\}", r"\\begin\{document\}", r"\\end\{document\}")

# Forms of profile ids, revisions and digests, and what names of theirs must not hold.
PROFILE_ID = r"[A-Za-z0-9][A-Za-z0-9_.+-]{0,127}"
REVISION = r"[A-Za-z0-9][A-Za-z0-9_.@+-]{0,254}"
DIGEST = r"sha256:[0-9a-fA-F]{64}"
VERSION = r"v?\d+(?:\.\d+){1,3}(?:[-+][A-Za-z0-9.-]+)?"
SECRET_MARKERS = ("api_key", "apikey", "authorization", "bearer", "client_secret", "credential", "password", "secret", "token")
CUSTOMER_MARKERS = ("customer", "tenant")
PRIVATE_SUFFIXES = (".corp", ".internal", ".intra", ".lan", ".local", ".private", ".svc")
