"""Text functions that SQL can't express, over Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import values

REPEATS, KEPT, UNIT, SEQUENCE = 10, 5, 24, 4


def collapsed_units(text: str) -> str:
    """Units of up to 24 characters that repeat ten times or more in a row repeat five times."""
    for size in range(1, min(UNIT, len(text) // REPEATS) + 1):
        pattern, before = re.compile(rf"(?s)(.{{{size}}})\1{{{REPEATS - 1},}}"), None
        while before != text:
            before, text = text, pattern.sub(lambda m: m[1] * KEPT, text)
    return text


def collapsed(text: str | None) -> str | None:
    """As `collapsed_units`, in the text and in each token; then sequences of up to four tokens alike."""
    if not text:
        return text
    parts = re.findall(r"\s*\S+", collapsed_units(text))
    tail = re.search(r"\s*$", collapsed_units(text))[0] if parts else collapsed_units(text)
    spaces = [p[: len(p) - len(p.lstrip())] for p in parts]
    tokens = [collapsed_units(p.strip()) for p in parts]
    for size in range(min(SEQUENCE, len(tokens)), 0, -1):
        i = 0
        while len(tokens) >= REPEATS and i + size <= len(tokens):
            run = 1
            while tokens[i + run * size : i + (run + 1) * size] == tokens[i : i + size]:
                run += 1
            if run >= REPEATS:
                del tokens[i + KEPT * size : i + run * size], spaces[i + KEPT * size : i + run * size]
            else:
                i += 1
    return "".join(s + t for s, t in zip(spaces, tokens, strict=True)) + tail


def normalised(text: str | None) -> str | None:
    """Compatibility form, case folded, letters and digits only."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def unescaped(text: str | None, breaks: bool = False) -> str | None:
    r"""\uXXXX and \UXXXXXXXX as characters, and with `breaks` \n, \r and \t too, until nothing changes."""
    before = None
    while text is not None and before != text:
        before = text
        text = re.sub(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})", lambda m: chr(int(m[1] or m[2], 16)) if int(m[1] or m[2], 16) < 0x110000 else m[0], text)
        if breaks:
            text = text.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t")
    return text


def raised_citations(text: str | None) -> str | None:
    """Citation numbers in superscript digits as <sup>; a comma behind them stays outside."""
    figures = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    return None if text is None else re.sub(r"[⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:[,，\-–][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*", lambda m: f"<sup>{m[0].translate(figures)}</sup>", text)


def _udf(function) -> object:
    def over(column: Column) -> Column:
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(function, na_action="ignore")

        return run(column)

    return over


collapse_repeats, normalise, unescape, raise_citations = map(_udf, (collapsed, normalised, unescaped, raised_citations))


# What may open or close mathematics, and what stands for line ends outside of it.
_MARKS = re.compile(r"\\r\\n|\\[nr()\[\]]|\$+")
_CLOSERS = {r"\(": r"\)", r"\[": r"\]"}


def line_ends_outside_math(text: str) -> str:
    """`\\n`, `\\r` and `\\r\\n` written out become line ends, except inside `$...$`, `$$...$$`, `\\(...\\)` and
    `\\[...\\]`, which nest. A dollar behind an odd number of backslashes is text; what never closes lasts to the end."""
    awaited: list[str] = []

    def one(m: re.Match[str]) -> str:
        mark, start = m[0], m.start()
        if mark[0] == "$":
            slash = start
            while slash and text[slash - 1] == "\\":
                slash -= 1
            run = mark[(start - slash) % 2 :]
            if run and awaited and awaited[-1] == run:
                awaited.pop()
            elif run:
                awaited.append(run)
            return mark
        if mark in _CLOSERS:
            awaited.append(_CLOSERS[mark])
        elif awaited and awaited[-1] == mark:
            awaited.pop()
        elif not awaited and mark[1] in "nr":
            return "\n"
        return mark

    return _MARKS.sub(one, text)


def with_line_ends(text: Column) -> Column:
    """As `line_ends_outside_math`; texts without a backslash stay in the JVM. Null gives null."""

    @F.pandas_udf("string")
    def scanned(values: pd.Series) -> pd.Series:
        return values.map(line_ends_outside_math, na_action="ignore")

    return F.when(F.contains(text, F.lit("\\")), scanned(F.when(F.contains(text, F.lit("\\")), text))).otherwise(text)


def _without_secrets(value: object) -> object:
    if isinstance(value, dict):
        return {k: values.REDACTED if _is_secret(k) else _without_secrets(v) for k, v in value.items()}
    return [_without_secrets(v) for v in value] if isinstance(value, list) else value


def _is_secret(key: str) -> bool:
    name = key.lower().replace("-", "_")
    return name in values.SECRET_KEYS or name.endswith(values.SECRET_ENDINGS)


def redacted_json(config: Column) -> Column:
    """A JSON document with the values of secret keys replaced at every depth; null for null and for what is no JSON."""

    def safe(text: str) -> str | None:
        try:
            return json.dumps(_without_secrets(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(safe, na_action="ignore")

    return replaced(config)


_TABLE_TAG = re.compile(r"(?is)<table(.*?</table>)?")


def _end_of(wanted: str, markdown: str, at: int) -> int | None:
    """Where a text ends that is found from a position on as it stands, or else whatever its white space is."""
    exact = markdown.find(wanted, at)
    if exact >= 0:
        return exact + len(wanted)
    loose = re.compile(r"\s+".join(map(re.escape, wanted.split()))).search(markdown, at)
    return loose.end() if loose else None


def _place(markdown: str, table: dict, at: int) -> tuple[int, str]:
    forms = [f for own in (table.get("html"), table.get("text")) if own and own.strip() for f in (own, own.strip())]
    caption = (table.get("caption") or "").strip()
    plain = caption.replace("*", "").strip()
    for how, texts in (("snippet", forms), ("html-tag", None), ("caption", (caption, plain, " ".join((plain or caption).split())))):
        if texts is None:
            tag = _TABLE_TAG.search(markdown, at)
            ends = [tag.end() if tag[1] else tag.start()] if tag else []
        else:
            ends = [end for end in (_end_of(t, markdown, at) for t in dict.fromkeys(texts) if t) if end is not None][:1]
        if ends:
            return ends[0], how
    return len(markdown), "append-end"


def table_places(markdown: str, tables: list[dict]) -> list[tuple[int, str]]:
    """Behind which character of a page's Markdown each of its tables (html, text, caption) ends, and how that was found.

    In the order of the tables, each one from where the one before was placed: by its HTML or text, exactly and then
    with any white space; behind the next table tag, or in front of one that never closes; behind its caption, also
    without stars; at the end. Null and blank fields are none.
    """
    out: list[tuple[int, str]] = []
    for table in tables:
        out.append(_place(markdown, table, out[-1][0] if out else 0))
    return out


def with_references(markdown: Column, tables: Column) -> Column:
    """Markdown with each table's reference behind the table; tables: array<struct<html, text, caption, reference>>.

    Null Markdown gives null, null tables none; a null reference moves the place on and adds nothing.
    """

    def one(text: str | None, listed: list[dict] | None) -> str | None:
        if text is None or listed is None:
            return text
        parts, before = [], 0
        for (end, _), table in zip(table_places(text, list(listed)), listed, strict=True):
            parts += [text[before:end], "\n\n" + table["reference"] if table["reference"] else ""]
            before = end
        return "".join([*parts, text[before:]])

    @F.pandas_udf("string")
    def placed(texts: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([one(t, s) for t, s in zip(texts, listed, strict=True)], dtype=object)

    return placed(markdown, tables)
