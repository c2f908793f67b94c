"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import vocab
from sheaf.functions.values import let


def any_fragment(text: Column, fragments: tuple[str, ...]) -> Column:
    """Whether a fragment is in the text."""
    out = F.lit(False)
    for part in fragments:
        out = out | F.contains(text, F.lit(part))
    return out


def failure_category(message: Column, explicit: Column | None = None, return_code: Column | None = None) -> Column:
    """The category of a failure: a given one, else one by return code, else the first rule that the message meets."""
    lowered, out = F.lower(message), None
    for category, groups in vocab.FAILURE_RULES:
        holds = F.lit(True)
        for fragments in groups:
            holds = holds & any_fragment(lowered, fragments)
        out = F.when(holds, category) if out is None else out.when(holds, category)
    out = out.when(F.startswith(lowered, F.lit("file extension ")), "input_invalid").otherwise("parser_failed")
    out = F.when(F.coalesce(lowered, F.lit("")) == "", "unknown").otherwise(out)
    if return_code is not None:
        killed = (return_code < 0) | return_code.isin(137, 143)
        out = F.when(killed, "process_killed").when(return_code > 0, "process_failed").otherwise(out)
    return out if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), out)


def api_error_category(error_type: Column, status_code: Column, message: Column, stage: Column) -> Column:
    lowered = F.lower(message)
    return (
        F.when(error_type.isin("APITimeoutError", "TimeoutError"), "timeout")
        .when((status_code == 429) | (error_type == "RateLimitError") | lowered.contains("rate limit"), "rate_limit")
        .when(status_code.isNotNull(), "http_status")
        .when(error_type.isin("APIConnectionError", "ConnectError", "ConnectionError"), "network")
        .when((stage == "model_output") | (error_type == "NonStandardModelOutputError"), "model_output")
        .when(error_type.isin("APIError", "OpenAIError"), "api_error")
        .when(lowered.contains("empty response") | lowered.contains("malformed layout output"), "model_output")
        .otherwise("unexpected")
    )


def is_transient(message: Column) -> Column:
    return any_fragment(F.lower(message), vocab.TRANSIENT_FRAGMENTS)


def plain_text(markdown: Column) -> Column:
    """Markdown without code, images, link targets, tags and marks; runs of white space are one space. Order matters."""
    for pattern, new in (*vocab.PLAIN_STEPS, (r"(?U)\s+", " ")):
        markdown = F.regexp_replace(markdown, pattern, new)
    return markdown


def word_total(markdown: Column) -> Column:
    """Han characters and runs of ASCII letters, digits and apostrophes of the plain text."""
    plain = plain_text(markdown)
    return F.coalesce(F.regexp_count(plain, F.lit(r"[\u4e00-\u9fff]")) + F.regexp_count(plain, F.lit(r"[A-Za-z0-9']+")), F.lit(0)).cast("long")


def estimated_words(actual: Column, sampled: Column, total: Column) -> Column:
    return F.when(sampled > 0, F.ceil(actual * total / sampled)).otherwise(F.lit(0))


def script_language(text: Column) -> Column:
    """The language with most letters of its own set; ties by fixed order; Others without any letter.

    The text is read twice: for its ASCII letters, and for what is not ASCII, usually little, in which the other sets
    are counted. A language with the letters of an earlier one never wins and isn't counted.
    """
    sets = [vocab.LANGUAGE_LETTERS[name] for name in vocab.LANGUAGE_ORDER]
    firsts = [(k, name) for k, name in enumerate(vocab.LANGUAGE_ORDER) if sets[k] not in sets[:k]]
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))

    def best_of(read: Column) -> Column:
        count = lambda name: read["n"] if vocab.LANGUAGE_LETTERS[name].isascii() else F.regexp_count(read["rest"], F.lit(f"[{vocab.LANGUAGE_LETTERS[name]}]"))
        counts = F.array(*(F.struct(count(name).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, name in firsts))
        none = F.struct(read["n"].alias("n"), F.lit(0).alias("k"), F.lit("English").alias("name"))
        best = F.when(F.coalesce(read["rest"], F.lit("")) == "", none).otherwise(F.array_max(counts))
        return F.when(best["n"] > 0, best["name"]).otherwise("Others")

    return let(F.struct(ascii_letters.alias("n"), F.regexp_replace(text, r"[\x00-\x7F]+", "").alias("rest")), best_of)


def has_table(text: Column) -> Column:
    """Three neighbouring lines from bar to bar, or an HTML table."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    run = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, line: F.when(line.rlike(r"^\s*\|.*\|\s*$"), F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))).otherwise(F.struct(F.lit(0).alias("now"), acc["most"].alias("most"))),
        lambda acc: acc["most"],
    )
    return (F.contains(text, F.lit("|")) & (run >= 3)) | text.rlike(r"(?is)<table\b.*?>.*?</table>")


def has_image(text: Column) -> Column:
    return text.rlike(r"!\[[^\]]*\]\([^)]+\)|(?i)<img\b[^>]*>")


def has_latex(text: Column) -> Column:
    return text.rlike(vocab.LATEX)


def without_preamble(latex: Column) -> Column:
    for pattern in vocab.LATEX_PREAMBLE:
        latex = F.regexp_replace(latex, "(?i)" + pattern, "")
    return latex


def caption_slug(caption: Column, page: Column, index: Column) -> Column:
    """A file name from a caption of 50 characters at most; page and image number without one."""
    safe = F.regexp_replace(caption, r"(\d+)\.(\d+)", "$1-$2")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"(?U)[^\w\s-]", ""), r"(?U)^\s+|\s+$", ""), r"(?U)[-\s]+", "_")
    named = F.concat(F.lit("page_"), page.cast("string"), F.lit("_"), F.left(safe, F.lit(50)))
    return F.when(F.coalesce(safe, F.lit("")) != "", named).otherwise(F.concat(F.lit("page_"), page.cast("string"), F.lit("_img_"), (index + 1).cast("string")))


def human_bytes(size: Column) -> Column:
    """Bytes of sizes such as `1.5 GB`; gigabytes where no unit stands; null if it isn't a size."""
    number = F.try_to_number(F.regexp_extract(size, r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("999999999999D999999")).cast("double")
    unit = F.upper(F.regexp_extract(size, r"^\s*\d+(?:\.\d+)?\s*([A-Za-z]*)\s*$", 1))
    power = F.when(unit.isin("B"), 0).when(unit.isin("K", "KB"), 1).when(unit.isin("M", "MB"), 2).when(unit.isin("G", "GB", ""), 3).when(unit.isin("T", "TB"), 4)
    return F.when(size.rlike(r"^\s*\d+(\.\d+)?\s*[A-Za-z]*\s*$"), F.floor(number * F.pow(F.lit(1024.0), power))).cast("long")


def joined_pair(left: Column, right: Column) -> Column:
    """Two text blocks as one: a hyphen before a letter goes, ASCII letters or digits on both sides get a space."""
    a, b = F.regexp_replace(left, r"(?U)\s+$", ""), F.regexp_replace(right, r"(?U)^\s+", "")
    hyphen = F.endswith(a, F.lit("-")) & (F.length(a) > 1) & b.rlike("^[a-zA-Z]")
    spaced = a.rlike("[a-zA-Z0-9]$") & b.rlike("^[a-zA-Z0-9]")
    return F.when(hyphen, F.concat(F.left(a, F.length(a) - 1), b)).when(spaced, F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))


def ends_sentence(text: Column) -> Column:
    """Whether the text ends a sentence, closing quotes and brackets aside; closers alone do, an empty text doesn't."""
    bare = F.regexp_replace(text, f"(?U)[{vocab.CLOSERS}\\s]+$", "")
    return F.when(text == "", False).otherwise((bare == "") | bare.rlike(f"[{vocab.SENTENCE_ENDS}]$"))


def goes_on(first: Column, second: Column) -> Column:
    """Whether a text block goes on in the next one."""
    a, b = F.regexp_replace(first, r"(?U)\s+$", ""), F.regexp_replace(second, r"(?U)^\s+", "")
    halts = (a == "") | (b == "") | a.rlike("[0-9]$") | ends_sentence(first) | (a.rlike("[a-zA-Z]$") & second.rlike("[一-龥]"))
    starts = second.rlike(f"^(?:{vocab.NEW_PARAGRAPH})") | b.rlike(r"^[-*•]") | first.rlike(vocab.CONTENTS_ENTRY) | second.rlike(vocab.CONTENTS_ENTRY)
    return F.coalesce(~halts & ~starts, F.lit(False))


def author_score(text: Column) -> Column:
    """How much a block looks like an author block (5: it does); ASCII letters decide what looks like a name.

    The text without tags, its lower case and its words are worked out once each; null and short texts score 0.
    """
    marks = F.regexp_count(text, F.lit("[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§′]")) + F.regexp_count(text, F.lit("<sup>"))
    known = [w.lower() for w in vocab.AUTHOR_INSTITUTIONS if w.isascii()]

    def times(of: Column, words: list[str]) -> Column:
        found = lambda acc, w: acc + F.floor((F.length(of) - F.length(F.replace(of, w, F.lit("")))) / F.length(w)).cast("int")
        return F.aggregate(F.array(*map(F.lit, words)), F.lit(0), found)

    def named(w: Column) -> Column:
        short = F.length(w).between(2, 4) & w.rlike("[一-龥]")
        shaped = w.rlike("^[A-Z][a-z-]+") | (w.rlike("^[A-Z][A-Z-]*[A-Z]$") & (F.length(w) < 15))
        return (F.length(w) > 1) & (short | (shaped & ~F.lower(w).isin(*known)))

    def scored(bare: Column, low: Column) -> Column:
        parts = F.transform(F.split(F.left(bare, F.lit(200)), r"[\s;()]+", -1), lambda w: F.regexp_replace(w, r"^,+|,+$", ""))
        places = times(low, known) + times(bare, [w for w in vocab.AUTHOR_INSTITUTIONS if not w.isascii()])
        return (
            F.when(text.rlike(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), 3).otherwise(0)
            + let(marks, lambda n: F.when(n >= 5, 4).when(n >= 2, 3).otherwise(0))
            + let(places, lambda n: F.when(n >= 3, 3).when(n >= 1, 1).otherwise(0))
            + F.when(bare.rlike(r"\b\d{5,}\b"), 2).otherwise(0)
            + F.when((F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))) / F.length(text) > 0.03, 1).otherwise(0)
            + let(F.size(F.filter(parts, named)), lambda n: F.when(n > 5, 3).when(n > 2, 2).otherwise(0))
            + F.when(F.regexp_count(text, F.lit(r"\b(" + "|".join(vocab.AUTHOR_DEGREES) + r")\b")) >= 2, 2).otherwise(0)
        )

    def judged(bare: Column, low: Column) -> Column:
        prose = let(F.split(low, r"[\s;(),]+", -1), lambda words: F.size(F.filter(words, lambda w: w.isin(*vocab.AUTHOR_STOP_WORDS))) / F.size(words) > 0.1)
        return F.when(prose, 0).otherwise(scored(bare, low))

    whole = let(F.regexp_replace(text, "<[^>]+>", ""), lambda bare: let(F.lower(bare), lambda low: judged(bare, low)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 20, 0).otherwise(whole)


def tokens_in_order(text: Column, tokens: Column) -> Column:
    """Whether all tokens stand in the text one behind the other."""

    def step(at: Column, token: Column) -> Column:
        found = F.call_function("locate", token, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(token)).otherwise(0)

    return F.aggregate(tokens, F.lit(1), step) > 0


def under_root(path: Column, root: Column) -> Column:
    """Whether the path is the root or lies below it, by whole segments."""
    base = F.regexp_replace(root, "/+$", "")
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def valid_relative_path(path: Column) -> Column:
    """A relative POSIX path to a PDF that never goes up."""
    segments = F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", "."))
    up = F.exists(segments, lambda p: p == "..")
    return F.coalesce(~F.contains(path, F.lit("\\")) & ~F.startswith(path, F.lit("/")) & ~up & F.endswith(F.lower(F.element_at(segments, -1)), F.lit(".pdf")), F.lit(False))
