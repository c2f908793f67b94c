"""Small rules over values: sizes, labels, configuration, pressure, retries, hashes, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import vocab

# Keys, and endings of keys, whose values are secret.
SECRET_KEYS = ("api_key", "authorization", "bearer_token", "token", "access_token", "secret", "password", "x_api_key")
SECRET_ENDINGS = ("_api_key", "_token", "_secret", "_password")
REDACTED = "[redacted]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole_number(value: Column) -> Column:
    """A count out of a string: negative ones and what is no whole number are 0."""
    return F.greatest(F.coalesce(F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("bigint")), F.lit(0)), F.lit(0)).cast("long")


def label_code(label: Column) -> Column:
    """The code in front of a label such as `E2-name`; empty if there is none."""
    return F.regexp_extract(F.trim(label), r"^([A-Za-z0-9/]+)", 1)


def split_list(text: Column) -> Column:
    """Parts between commas, semicolons and line ends of both scripts, without blanks, each once in order."""
    parts = F.transform(F.split(text, r"[,\n;，、]", -1), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def half_width(text: Column) -> Column:
    """Full-width ASCII and the wide space as their usual forms."""
    wide = "".join(chr(0xFF01 + k) for k in range(94)) + "　"
    return F.translate(text, wide, "".join(chr(0x21 + k) for k in range(94)) + " ")


def is_secret_key(key: Column) -> Column:
    """Whether a key, in lower case and with underscores, is a secret's."""
    name = F.translate(F.lower(key), "-", "_")
    return name.isin(*SECRET_KEYS) | F.exists(F.array(*map(F.lit, SECRET_ENDINGS)), lambda e: F.endswith(name, e))


def redacted(options: Column) -> Column:
    """A flat map with the values of secret keys replaced."""
    return F.transform_values(options, lambda k, v: F.when(is_secret_key(k), REDACTED).otherwise(v))


def without_password(url: Column) -> Column:
    return F.regexp_replace(url, r"://([^:/@]+):[^@]+@", "://$1:***@")


def has_suffix(name: Column, *suffixes: str) -> Column:
    """Whether a name ends in one of the suffixes, also of several parts, whatever the case."""
    return F.exists(F.array(*(F.lit("." + s.lower().lstrip(".")) for s in suffixes)), lambda s: F.endswith(F.lower(name), s))


def pressure(memory_pct: Column, free_memory: Column, disk_pct: Column, free_disk: Column) -> Column:
    """Reasons why a machine should take no more work: memory from 90 %, below 4 GiB, disk from 95 %, below 10 GiB."""
    return F.array_compact(F.array(
        F.when(memory_pct >= 90, "memory_percent"), F.when(free_memory < 4 * 2**30, "memory_available"),
        F.when(disk_pct >= 95, "disk_percent"), F.when(free_disk < 10 * 2**30, "disk_free"),
    ))


def exit_category(code: Column) -> Column:
    return F.when((code < 0) | code.isin(137, 143), "process_killed").when(code != 0, "process_failed")


def backoff(attempt: Column, delay: float, most: float = 30.0) -> Column:
    """Seconds before the next attempt, doubling up to five times."""
    return F.least(F.lit(delay) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(5))), F.lit(most))


def is_blank_page(grey: Column) -> Column:
    """Over 0.99 of the pixels above 240 and a variance below 0.001 of the range squared."""
    n = F.size(grey).cast("double")
    add = lambda acc, x: acc + x.cast("double")
    mean = F.aggregate(grey, F.lit(0.0), add) / n
    square = F.aggregate(grey, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n
    return (F.size(F.filter(grey, lambda x: x > 240)) / n > 0.99) & (square < 0.001 * 255 * 255)


def document_status(pages: Column) -> Column:
    """ok, failed or failed as empty, by pages: array<struct<page, status>>; any error or unknown status fails."""
    good = ("success", "success_fallback_text", "success_fallback_image", "skipped_blank")
    bad = F.exists(pages, lambda p: ~p["status"].isin(*good))
    filled = F.exists(pages, lambda p: p["status"].isin(*good[:3]))
    return F.when(bad, "failed").when(filled, "success").otherwise("failed_no_content")


def layout_lines(text: Column) -> Column:
    """Lines such as `001 002 998 999title` as array<struct<x1, y1, x2, y2, kind>>."""
    pattern = F.lit(r"(?m)^\s*(\d{3}) (\d{3}) (\d{3}) (\d{3})([a-z_]+)")
    parts = [F.regexp_extract_all(text, pattern, F.lit(k)) for k in range(1, 6)]
    zipped = F.arrays_zip(*(p.alias(f"p{k}") for k, p in enumerate(parts)))
    return F.transform(zipped, lambda z: F.struct(*(z[f"p{k}"].cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), z["p4"].alias("kind")))


def trimmed_front(cells: Column) -> Column:
    """Cells before the first one that announces a summary go, titles and section headers aside."""
    marks = r"(?i)\*\*\s*(摘要|abstract)\s*[：:]*\s*\*\*|[【\[]\s*(摘要|abstract)\s*[：:]*\s*[】\]]"
    anchor = F.array_position(F.transform(cells, lambda c: F.coalesce(c["text"], F.lit("")).rlike(marks)), True)
    return F.filter(cells, lambda c, k: (k + 1 >= anchor) | c["category"].isin("Title", "Section-header"))


def safe_identifier(value: Column, pattern: str = vocab.REVISION) -> Column:
    """Whether a name has the pattern's form and tells no secret, customer or address; null gives null.

    An address is localhost, a private name, four numbers up to 255, or a name with a point whose last part is letters
    alone, two or more, unless the whole is a version.
    """
    low = F.lower(value)
    holds = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))
    private = (low == "localhost") | F.exists(F.array(*map(F.lit, vocab.PRIVATE_SUFFIXES)), lambda e: F.endswith(low, e))
    numbers = value.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$") & ~F.endswith(value, F.lit("."))
    host = value.rlike(r"\.[A-Za-z]{2,}$") & ~value.rlike(f"^(?:{vocab.VERSION})$")
    return value.rlike(f"^(?:{pattern})\\z") & ~holds(vocab.SECRET_MARKERS) & ~holds(vocab.CUSTOMER_MARKERS) & ~private & ~numbers & ~host


def safe_provenance(profile_id: Column, revisions: Column, digests: Column) -> Column:
    """struct<profile_id, revisions, digests> of a profile whose names are all safe, digests in lower case; else null.

    revisions, digests: map<string, string>; null values are left out, null maps empty. A null profile id isn't safe.
    """
    kept = lambda m: F.map_filter(F.coalesce(m, F.expr("cast(map() AS map<string, string>)")), lambda _, v: v.isNotNull())
    good = F.coalesce(safe_identifier(profile_id, vocab.PROFILE_ID), F.lit(False))
    good = good & F.forall(F.map_values(kept(revisions)), lambda v: safe_identifier(v)) & F.forall(F.map_values(kept(digests)), lambda v: v.rlike(f"^{vocab.DIGEST}\\z"))
    return F.when(good, F.struct(profile_id.alias("profile_id"), kept(revisions).alias("revisions"), F.transform_values(kept(digests), lambda _, v: F.lower(v)).alias("digests")))
