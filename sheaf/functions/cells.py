"""Rules over the cells of a page: array<struct<category, bbox, text>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import geometry as G
from sheaf.functions.values import let

# The categories that keywords may drop.
KEYWORD_CATEGORIES = ("Text", "List-item", "Section-header", "Footnote")


def without_keywords(cells: Column, keywords: Sequence[str], categories: Sequence[str] = KEYWORD_CATEGORIES) -> Column:
    """Cells of the categories go if their text holds a keyword, whatever the case; without keywords all stay."""
    if not keywords or not categories:
        return cells
    words = F.array(*(F.lit(k.lower()) for k in keywords))
    return F.filter(cells, lambda c: ~(F.coalesce(c["category"].isin(*categories), F.lit(False)) & F.coalesce(F.exists(words, lambda k: F.contains(F.lower(c["text"]), k)), F.lit(False))))


def without_furniture(cells: Column, keep_header: bool = False, keep_footer: bool = False, skip_footnote: bool = False) -> Column:
    """Page headers and footers go unless they are kept, footnotes only if they are skipped; cells without a category stay."""
    gone = [c for c, drop in (("Page-header", not keep_header), ("Page-footer", not keep_footer), ("Footnote", skip_footnote)) if drop]
    return F.filter(cells, lambda c: ~F.coalesce(c["category"].isin(*gone), F.lit(False))) if gone else cells


def figure_captions(cells: Column, category: str = "Picture") -> Column:
    """array<struct<figure, caption>> of positions from 0: each figure in reading order takes the free caption near it
    with the least score, at a tie the first; caption is null if none is near. No figures give an empty array."""
    numbered = F.transform(cells, lambda c, k: F.struct(k.cast("int").alias("k"), c["category"].alias("category"), c["bbox"].alias("bbox")))

    def matched(all_: Column) -> Column:
        captions = F.filter(all_, lambda c: c["category"] == "Caption")

        def take(acc: Column, f: Column) -> Column:
            free = F.filter(captions, lambda c: ~F.exists(acc, lambda m: F.coalesce(m["caption"] == c["k"], F.lit(False))) & G.is_close(f["bbox"], c["bbox"]))
            scored = F.transform(free, lambda c: F.struct(G.caption_score(f["bbox"], c["bbox"], f["k"], c["k"]).alias("score"), c["k"].alias("k")))
            return F.array_append(acc, F.struct(f["k"].alias("figure"), F.array_min(scored)["k"].alias("caption")))

        return F.aggregate(F.filter(all_, lambda c: c["category"] == category), F.expr("cast(array() AS array<struct<figure: int, caption: int>>)"), take)

    return let(numbered, matched)


def original_tables(filtered: Column, original: Column) -> Column:
    """For each filtered cell the position (from 0) of the first table of the original cells whose box rounds to the same
    whole numbers, halves to even; null for what is no table, has no box of four numbers or has no counterpart."""

    def key(c: Column) -> Column:
        whole = F.transform(c["bbox"], lambda v: F.bround(v, 0).cast("long"))
        return F.when((c["category"] == "Table") & (F.size(c["bbox"]) == 4) & ~F.exists(c["bbox"], lambda v: v.isNull()), F.array_join(F.transform(whole, lambda v: v.cast("string")), ","))

    return let(F.transform(original, lambda c: key(c)), lambda keys: F.transform(filtered, lambda c: F.nullif(F.array_position(keys, key(c)), F.lit(0)).cast("int") - 1))
