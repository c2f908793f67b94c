"""Near-duplicate lines by a deletion-neighbourhood join, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.scans import let, prefixes, xor
from sheaf.sources.scratch import written

#: Two lines are near if one insertion, deletion or substitution of a character turns one into the other.
EDITS = 1
#: Characters per block of a line; variants hash the block they change, and the rest of the line once per block.
BLOCK = 16
#: White space of lines.
BLANKS = " \t\n\x0b\x0c\r"
#: A table of lines up to this size is sent to all workers; a larger one is joined by a shuffle.
BROADCAST_BYTES, WANTED_ROW_BYTES = 32 << 20, 48


def _hash(*parts: Column | str) -> list[Column]:
    """Two 64-bit hashes of the parts: 128 bits together."""
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and text of every line; a null text has none. Lines end at line feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def normalised(line: Column) -> Column:
    """White space at both ends goes, other runs of it become one space, ASCII and other letters are lower-cased."""
    spaced = F.lit(False)
    for held in ("  ", *BLANKS[1:]):
        spaced = spaced | F.contains(line, F.lit(held))
    return F.lower(F.trim(F.when(spaced, F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(line)))


def _near_keys(line: Column, n: Column) -> Column:
    """Keys of which any two near lines share one: an edit leaves the first half or the second half as it is.

    Near lines differ by at most one in length, so each line stands for the pairs of lengths (n - 1, n) and (n, n + 1),
    each cut at one place from the front and one from the back.
    """
    keys = []
    for more in (0, 1):
        longer = n + more
        front = F.floor((longer - 1) / 2).cast("int")
        keys.append(F.xxhash64(longer, F.lit("front"), F.left(line, front)))
        keys.append(F.xxhash64(longer, F.lit("back"), F.right(line, longer - 1 - front)))
    return F.array_distinct(F.array(*keys))


def _blocks(line: Column, n: Column) -> Column:
    """The blocks of a line as array<struct<j, more, own, a1, a2, z1, z2>>: own characters (one of the next block too),
    and hashes of all that stands before (a) and behind (z) the block.

    Near lines are equal before the block that holds the edit and behind it. more is 0 in a line that loses a character
    in this block and 1 in one that is whole there, whose later characters stand one place nearer to the front; so what
    is behind is hashed in blocks of the line without its first character, or of the line. Running sums of block hashes
    give all parts in one pass.
    """
    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    sums = lambda blocks, seed: prefixes(F.transform(blocks, lambda b, i: F.xxhash64(F.lit(seed), i, b)), xor)

    def framed(whole: Column, one: tuple[Column, Column], other: tuple[Column, Column]) -> Column:
        def block(j: Column, more: int) -> Column:
            behind = one if more else other
            rest = [F.element_at(p, -1).bitwiseXOR(F.coalesce(F.get(p, j + 1), F.element_at(p, -1))) for p in behind]
            own = F.concat(F.coalesce(F.get(whole, j), F.lit("")), F.left(F.coalesce(F.get(whole, j + 1), F.lit("")), F.lit(1)))
            return F.struct(
                j.alias("j"), F.lit(more).alias("more"), own.alias("own"), F.get(one[0], j).alias("a1"), F.get(one[1], j).alias("a2"), rest[0].alias("z1"), rest[1].alias("z2")
            )

        last = F.size(whole)
        losing = F.transform(F.sequence(F.lit(0), last - 1), lambda j: block(j, 0))
        kept = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda j: block(j, 1))
        return F.concat(losing, kept)

    def summed(whole: Column) -> Column:
        shifted = cut(F.call_function("substring", line, F.lit(2)))
        four = F.struct(sums(whole, 1).alias("w1"), sums(whole, 2).alias("w2"), let(shifted, lambda b: sums(b, 1)).alias("s1"), let(shifted, lambda b: sums(b, 2)).alias("s2"))
        return let(four, lambda x: framed(whole, (x["w1"], x["w2"]), (x["s1"], x["s2"])))

    return let(cut(line), summed)


def _one_edit_apart(a: Column, b: Column) -> Column:
    """Whether the edit distance is EDITS: behind the first block that differs all is equal, and in it lies the edit."""
    pieces = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    same = F.zip_with(pieces(a), pieces(b), lambda x, y: x.eqNullSafe(y))

    def tested(start: Column) -> Column:
        shorter = F.least(F.length(a), F.length(b))
        rest = shorter - start - BLOCK  # behind the block in either line
        tail = lambda text: F.right(text, F.greatest(rest, F.lit(0)))
        head = lambda text: F.call_function("substring", text, start + 1, F.length(text) - start - F.greatest(rest, F.lit(0)))
        return (F.abs(F.length(a) - F.length(b)) <= EDITS) & (tail(a) == tail(b)) & (F.levenshtein(head(a), head(b), EDITS) >= 0)

    return let((F.array_position(same, False).cast("int") - 1) * BLOCK, tested)


def _frames(lines: DataFrame) -> DataFrame:
    """Each line (columns id, line, n; not empty) under each block: id, n (its length), frame and the block's columns.

    Near lines share the frame of the block that holds the edit: the hash of what stands before and behind it and of
    the longer line's length, which is the line's own or one more.
    """
    blocks = lines.select("id", "n", F.explode(_blocks(F.col("line"), F.col("n"))).alias("b")).select("id", "n", "b.*")
    return blocks.withColumn("frame", F.xxhash64(F.col("n") + F.col("more"), "j", "a1", "z1"))


def _variants(framed: DataFrame) -> DataFrame:
    """The deletion neighbourhood within the given frames: rows of k1, k2 (key), place, id.

    A line without its character at `place`, or, with place null, the whole line. A key joins the hashes of what stands
    before the block, of the block's own characters and of what stands behind it, so a variant costs a block's length
    and not the line's.
    """
    own, whole = F.col("own"), F.col("i") == 0
    last = F.when(F.col("more") == 1, 0).otherwise(F.least(F.lit(BLOCK), F.col("n") - F.col("j") * BLOCK))
    spread = framed.withColumn("i", F.explode(F.sequence(1 - F.col("more"), last.cast("int"))))
    cut = F.concat(F.left(own, F.col("i") - 1), F.call_function("substring", own, F.col("i") + 1))
    rest = F.when(whole, F.left(own, F.lit(BLOCK))).otherwise(cut)
    k1, k2 = F.xxhash64(F.lit(1), "j", "a1", rest, "z1"), F.xxhash64(F.lit(2), "j", "a2", rest, "z2")
    return spread.select(k1.alias("k1"), k2.alias("k2"), F.when(~whole, F.col("j") * BLOCK + F.col("i")).alias("place"), "id")


def near_lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, kept, first_doc_id, first_line_no, edits.

    Lines are compared as `normalised`. A line's first is the earliest line, by doc_id (null first) and line_no, that
    is equal (edits 0) or one edit away (edits 1), if it comes before the line; kept lines have none. Of two equal
    firsts the same holds, so what is dropped is always within one edit of an earlier line, kept or not. Lines under
    `min_chars` meet equal ones only; by default all lines meet. Repeated rows give repeated lines at the same place, all alike. Null texts and
    blank lines give no rows; other columns are ignored.

    Equal lines are one first. Of the rest only lines that share a half with another can be near one, and of these
    only blocks that share their frame hold the edit; there lines emit their deletion neighbourhood. In a group of equal
    variants every line meets the group's earliest, never the other members, so hot groups cost a row each; pairs found
    so are verified by their edit distance.
    """
    line = normalised(F.col("line"))
    place = F.struct("doc_id", "line_no").alias("place")
    every = lines_of(docs).where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "line_no", line.alias("line"))
    h1, h2 = _hash("line")
    half = F.when(F.length("line") >= min_chars, _near_keys(F.col("line"), F.length("line")))
    thin = written(every.select("doc_id", "line_no", h1.alias("h1"), h2.alias("h2"), half.alias("halves")), "lines")
    grouped = thin.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.any_value("halves").alias("halves"))
    distinct = written(grouped, "distinct")
    halves = distinct.where("halves IS NOT NULL").select("h1", "h2", "place", F.explode("halves").alias("half"))
    shared = written(halves.groupBy("half").agg(F.count("place").alias("n")).where("n > 1").select("half"), "halves")
    wanted = halves.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(F.any_value("place").alias("place"))
    near = _firsts(docs, written(wanted, "wanted"))
    answers = distinct.select("h1", "h2", "place").join(near, ["h1", "h2"], "left")
    answers = written(answers.select("h1", "h2", F.col("place").alias("equal"), F.col("first").alias("near")), "answers")
    told = thin.select("doc_id", "line_no", "h1", "h2").join(answers, ["h1", "h2"])
    here = F.struct("doc_id", "line_no")
    first = F.when(F.col("near").isNotNull() & (F.col("near") < F.col("equal")), F.col("near")).when(F.col("equal") < here, F.col("equal"))
    told = told.withColumn("first", first)
    return told.select(
        "doc_id", "line_no", F.col("first").isNull().alias("kept"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        F.when(F.col("first").isNotNull(), F.when(F.col("first") == F.col("equal"), 0).otherwise(EDITS)).alias("edits"),
    )


def _firsts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For lines that have an earlier line one edit away: h1, h2 and `first`, the place of the earliest."""
    at = wanted.select(F.col("place.doc_id").alias("_d"), F.col("place.line_no").alias("_n"), "h1", "h2")
    if at.count() * WANTED_ROW_BYTES <= BROADCAST_BYTES:
        at = F.broadcast(at)
    else:  # documents without a wanted line are never split and shuffled
        docs = docs.join(at.select(F.col("_d").alias("_wanted")).distinct(), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    found = lines_of(docs).join(at, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line_no") == F.col("_n")))
    texts = found.select("doc_id", "line_no", "h1", "h2", normalised(F.col("line")).alias("line"))
    h1, h2 = _hash("line")
    texts = texts.where((F.col("h1") == h1) & (F.col("h2") == h2)).dropDuplicates(["h1", "h2"])
    lines = written(texts.select(F.struct("h1", "h2", F.struct("doc_id", "line_no").alias("place")).alias("id"), "line", F.length("line").alias("n")), "texts")
    frames = _frames(lines)
    shared = written(frames.groupBy("frame").agg(F.count("id").alias("n")).where("n > 1").select("frame"), "frames")
    variants = written(_variants(frames.join(shared, "frame", "left_semi")), "variants")
    by_place = variants.groupBy("k1", "k2", "place").agg(F.min("id.place").alias("first"), F.count("id").alias("n"))
    groups = by_place.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("place").isNotNull(), F.col("first"))).alias("cut"),
        F.min(F.when(F.col("place").isNull(), F.col("first"))).alias("whole"),
        F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull() & (F.col("n") > 1), F.struct("place", "first")))).alias("same"),
        F.sum("n").alias("n"),
    ).where("n > 1")
    groups = written(groups.drop("n"), "groups")
    met = variants.join(groups, ["k1", "k2"])
    earlier = F.when(F.col("place").isNull(), F.col("cut")).otherwise(F.least("whole", F.try_element_at("same", F.col("place"))))
    pairs = met.select("id", earlier.alias("other")).where(F.col("other") < F.col("id.place")).distinct()
    pairs = written(pairs, "line-pairs")
    left = pairs.join(lines, "id")
    right = lines.select(F.col("id.place").alias("other"), F.col("line").alias("other_line"))
    verified = left.join(right, "other").where(_one_edit_apart(F.col("line"), F.col("other_line")))
    return verified.groupBy("id").agg(F.min("other").alias("first")).select("id.h1", "id.h2", "first")


def without_near_lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """The rows of `docs` with each text cut down to its kept and its blank lines, all other columns unchanged.

    Repeated rows of the same doc_id are cut alike. Texts are put together again from (position, line) pairs of one row.
    """
    dropped = near_lines(docs, min_chars).where("NOT kept").groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("numbers"))
    dropped = written(dropped.withColumnRenamed("doc_id", "_id"), "dropped")
    row = docs.select("doc_id", "text", F.struct("*").alias("row")).join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    numbers = F.coalesce("numbers", F.expr("cast(array() AS array<int>)"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(numbers, i))
    return row.select(F.col("row").withField("text", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n"))).alias("row")).select("row.*")
