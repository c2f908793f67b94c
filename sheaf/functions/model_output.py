"""Repair of layout answers of models, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "struct<bbox:array<double>,category:string,text:string>"
#: An answer this long is taken to be cut off.
LONG = 50_000
_START = '{"bbox":'
_OBJECT = r"\{[^{}]*\}"


def repaired(answer: Column) -> Column:
    """A JSON array out of an answer: missing commas between objects, a cut-off last object (unless it is the only
    one), repeated objects, brackets and a last comma are put right."""
    text = F.regexp_replace(answer, r'\}\s*\{(?!")|\}\s*\{', "},{")
    several = F.size(F.split(text, r'\{"bbox":', -1)) > 2
    cut_off = (F.length(text) > LONG) | ~F.endswith(F.rtrim(text), F.lit("]"))
    last = F.length(text) - F.call_function("locate", F.reverse(F.lit(_START)), F.reverse(text)) - len(_START) + 1
    text = F.when(cut_off & several, F.regexp_replace(F.left(text, last.cast("int")), r"[,\s]+$", "")).otherwise(text)
    objects = F.regexp_extract_all(text, F.lit(_OBJECT), F.lit(0))
    once = F.array_distinct(objects)
    text = F.when(F.size(once) < F.size(objects), F.concat(F.lit("["), F.array_join(once, ", "), F.lit("]"))).otherwise(F.trim(text))
    text = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text))
    return F.when(F.endswith(text, F.lit("]")), text).otherwise(F.concat(F.regexp_replace(text, r"[,\s]+$", ""), F.lit("]")))


def parsed_cells(answer: Column) -> Column:
    """The cells of an answer; if the whole isn't JSON, those of its objects that are; none gives an empty array."""
    whole = F.from_json(repaired(answer), f"array<{CELL}>", {"mode": "PERMISSIVE"})
    objects = F.transform(F.regexp_extract_all(answer, F.lit(_OBJECT), F.lit(0)), lambda o: F.from_json(o, CELL))
    good = F.filter(objects, lambda c: c["bbox"].isNotNull() | c["category"].isNotNull())
    is_json = F.try_parse_json(repaired(answer)).isNotNull()
    return F.coalesce(F.when(is_json, whole), good, F.array().cast(f"array<{CELL}>"))


def usable_cells(cells: Column) -> Column:
    """Cells with a box of four numbers stay, with one of three they lose it, with another they go; cells without a
    box stay if they have a category."""
    kept = F.filter(cells, lambda c: F.coalesce(F.size(c["bbox"]).isin(3, 4), F.lit(False)) | (c["bbox"].isNull() & c["category"].isNotNull()))
    return F.transform(kept, lambda c: F.when(F.size(c["bbox"]) == 3, c.withField("bbox", F.lit(None).cast("array<double>"))).otherwise(c))
