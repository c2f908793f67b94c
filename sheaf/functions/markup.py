"""Markup, paths and times: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.functions.values import let


def single_braces(text: Column) -> Column:
    r"""Repeated escaped braces as one: \{\{ is \{."""
    return F.regexp_replace(text, r"(\\[{}])\1+", "$1")


def smart_joined(parts: Column) -> Column:
    """Parts as one text, with a space only between ASCII letters or digits."""
    step = lambda acc, x: F.when(acc.rlike("[A-Za-z0-9]$") & x.rlike("^[A-Za-z0-9]"), F.concat(acc, F.lit(" "), x)).otherwise(F.concat(acc, x))
    return F.aggregate(parts, F.lit(""), step)


def on_one_line(text: Column, category: Column) -> Column:
    """Lines of titles, headers, captions and text as one; a title keeps its marks in front; other kinds stay."""
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+", -1), lambda x: F.trim(x)), lambda x: x != "")
    plain = smart_joined(lines)
    marks = F.regexp_extract(text, r"^\s*(#+)\s", 1)
    titled = F.when(marks != "", F.concat(marks, F.lit(" "), F.regexp_replace(plain, r"^#+\s*", ""))).otherwise(plain)
    return F.when(category == "Title", titled).when(category.isin("Section-header", "Caption", "Text", "List-item", "Footnote"), plain).otherwise(text)


def formula_body(text: Column) -> Column:
    r"""What stands between the delimiters of a formula: $$, \[ \], \( \) or $."""
    out = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    for start, end in ((r"\$\$", r"\$\$"), (r"\\\[", r"\\\]"), (r"\\\(", r"\\\)"), (r"\$", r"\$")):
        out = F.regexp_replace(out, f"(?s)^{start}\\s*(.*?)\\s*{end}$", "$1")
    return out


def formula_block(text: Column) -> Column:
    r"""A formula as a block of its own, $$ on lines of their own around it.

    The first rule that holds decides: a lone $$ of a line goes; $$ or \[ \] around the whole give a block, unless more
    dollars stand inside; text with \[ \] in a line, with inline formulas or without LaTeX stays; other LaTeX becomes a
    block, without its preamble and without back quotes around it. White space at the ends always goes.
    """
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    inside = lambda x: strip(F.call_function("substring", x, F.lit(3), F.greatest(F.length(x) - 4, F.lit(0))))
    block = lambda x: F.concat(F.lit("$$\n"), x, F.lit("\n$$"))
    dollars = F.lit("$$")

    def paired(x: Column) -> Column:
        one_line = ~F.contains(x, F.lit("\n"))
        opens, closes = F.startswith(x, dollars), F.endswith(x, dollars)
        opened = F.when(opens & ~closes & one_line, F.regexp_replace(x, r"(?U)^\$\$\s*", ""))
        return opened.when(closes & ~opens & one_line, F.regexp_replace(x, r"(?U)\s*\$\$$", "")).otherwise(x)

    def decided(x: Column) -> Column:
        bare = F.when(F.contains(x, F.lit("usepackage")), T.without_preamble(x)).otherwise(x)
        unquoted = F.regexp_replace(bare, r"(?s)^`(.*)`$", "$1")
        return (
            F.when(F.startswith(x, dollars) & F.endswith(x, dollars), F.when(F.contains(inside(x), F.lit("$")), x).otherwise(block(inside(x))))
            .when(x.rlike(r"(?s)^\\\[.*\\\]$"), block(inside(x)))
            .when(x.rlike(r"\\\[.*\\\]") | x.rlike(r"\$[^$]+\$") | ~T.has_latex(x), x)
            .otherwise(block(unquoted))
        )

    return let(single_braces(strip(text)), lambda x: let(paired(x), decided))


def without_images(markdown: Column) -> Column:
    """Without image references; three or more line ends become two."""
    return F.regexp_replace(F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", ""), r"\n{3,}", "\n\n")


def without_fences(text: Column) -> Column:
    """What a fenced answer holds; other text as it is."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(text)


def valid_escapes(text: Column) -> Column:
    """JSON text with backslashes doubled that start no escape."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def compact_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r">\s+<", "><"), r"\s+", " "))


# Bytes of a file name and of a path, what is kept free of each, and characters that names can't hold.
NAME_MOST, PATH_MOST, NAME_FREE, PATH_FREE = 255, 4096, 4, 12
UNSAFE_IN_NAMES = r'[:*?"<>|]'


def safe_component(name: Column) -> Column:
    """A path component without characters that names can't hold; blank or null is `unnamed`."""
    bare = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    safe = F.regexp_replace(F.replace(bare, F.lit("/"), F.lit("_")), UNSAFE_IN_NAMES, "_")
    return F.when(F.coalesce(bare, F.lit("")) == "", "unnamed").otherwise(safe)


def local_path(key: Column, base_bytes: int = 0) -> Column:
    """An object key as a relative path below a folder whose own path has `base_bytes` bytes.

    Two dots and slashes in front go; parts are trimmed and made safe, blank ones are `unnamed`, single dots are no
    part. A file name or path too long for the system loses the end of its stem, and eight digits of the key's md5 tell
    it apart.
    """
    bare = F.regexp_replace(F.replace(F.coalesce(key, F.lit("")), F.lit(".."), F.lit("")), "^/+", "")
    safe = F.when(bare == "", "unnamed").otherwise(bare)

    def part(p: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), UNSAFE_IN_NAMES, "_")
        return F.when(cleaned == "", "unnamed").otherwise(cleaned)

    def shortened(k: Column, parts: Column) -> Column:
        name = F.element_at(parts, -1)
        suffix = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
        stem = F.left(name, F.length(name) - F.length(suffix))
        room = F.greatest(F.lit(8), F.lit(NAME_MOST - 8 - 2) - F.octet_length(suffix))
        fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(NAME_MOST)), lambda n: F.octet_length(F.left(stem, n)) <= room))
        cut = F.when(F.octet_length(stem) > room, F.regexp_replace(F.left(stem, fits), r"[_\-. ]+$", "")).otherwise(stem)
        new = F.concat(F.when(cut == "", "file").otherwise(cut), F.lit("_"), F.left(F.md5(k.cast("binary")), F.lit(8)), suffix)
        return F.array_append(F.slice(parts, F.lit(1), F.size(parts) - 1), new)

    def pathed(k: Column, parts: Column) -> Column:
        whole = F.array_join(F.filter(parts, lambda p: p != "."), "/")
        long = (F.octet_length(whole) + base_bytes > PATH_MOST - PATH_FREE) | (F.octet_length(F.element_at(parts, -1)) > NAME_MOST - NAME_FREE)
        return F.when(long, F.array_join(F.filter(shortened(k, parts), lambda p: p != "."), "/")).otherwise(whole)

    return let(safe, lambda k: let(F.transform(F.split(k, "/", -1), part), lambda parts: pathed(k, parts)))


def output_stem(key: Column) -> Column:
    """A name for what a key gives, the same in every run: its stem and eight digits of its md5."""
    stem = F.regexp_replace(F.element_at(F.split(key, "/", -1), -1), r"\.[^.]*$", "")
    return F.concat(safe_component(stem), F.lit("_"), F.left(F.md5(key.cast("binary")), F.lit(8)))


def bare_identifier(value: Column) -> Column:
    """An ISBN, DOI or ISSN without white space; an empty one is null."""
    return F.nullif(F.regexp_replace(value, r"(?U)\s+", ""), F.lit(""))


def tolerant_time(value: Column) -> Column:
    """ISO 8601 or RFC 2822 times in UTC; what is neither is null. No zone means UTC."""
    rfc = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(value.try_cast("timestamp"), rfc)


def kept_blocks(blocks: Column, dropped: list[str], least: float, most: int) -> Column:
    """Blocks (kind, bbox in thousandths) without dropped kinds and tiny ones, the first `most`."""
    area = lambda b: (b["bbox"][2] - b["bbox"][0]) * (b["bbox"][3] - b["bbox"][1]) / 1e6
    return F.slice(F.filter(blocks, lambda b: ~b["kind"].isin(*dropped) & (area(b) >= least)), 1, most)


def first_bad_cell(cells: Column) -> Column:
    """The number from 0 of the first cell without a category or with a box that isn't four numbers; null if all are good."""
    bad = F.transform(cells, lambda c: F.coalesce(c["category"], F.lit("")).eqNullSafe("") | ~F.coalesce(F.size(c["bbox"]) == 4, F.lit(False)) | F.exists(c["bbox"], lambda x: x.isNull()))
    return F.nullif(F.array_position(bad, True) - 1, F.lit(-1))


def page_dpi(width: Column, height: Column, dpi: int, most: int) -> Column:
    """The resolution at which a page in points has no more than `most` pixels."""
    pixels = width * height * (dpi / 72) ** 2
    return F.when(pixels > most, F.floor(dpi * F.sqrt(most / pixels))).otherwise(F.lit(dpi)).cast("int")


def hash_distance_limit(bits: int, similarity_pct: float) -> int:
    """How many bits two image hashes may differ in."""
    return int(bits * (1 - similarity_pct / 100))


def reading_order(votes: Column) -> Column:
    """Places in reading order from a matrix: votes[i][j] positive if i comes before j; ties by number."""
    wins = F.transform(votes, lambda row, i: F.struct(F.size(F.filter(row, lambda v: v > 0)).alias("w"), (-i).alias("i")))
    return F.transform(F.reverse(F.array_sort(wins)), lambda x: -x["i"])


def top_boxes(scores: Column, classes: int, most: int) -> Column:
    """The best entries of flattened box-by-class scores: array<struct<score, box, label>>, best first."""
    all_of = F.transform(scores, lambda s, k: F.struct((-s).alias("s"), k.alias("k")))
    best = F.slice(F.array_sort(all_of), 1, most)
    return F.transform(best, lambda x: F.struct((-x["s"]).alias("score"), F.floor(x["k"] / classes).cast("int").alias("box"), (x["k"] % classes).cast("int").alias("label")))
