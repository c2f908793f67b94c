"""Chat formatting over a prefix tree: shared turns are laid out once, depth first, with positions and attention."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.scans import let, prefixes, xor
from sheaf.operators.prefix import running_totals
from sheaf.sources.scratch import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The first character of a control string of this or another common template, wherever one begins.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
TURN = r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n"


class Forest(NamedTuple):
    """conversations: c (its number), conv_id, n_turns.

    steps: c, level, h1, h2: the node of each turn.
    nodes: h1, h2 (128 bits of hash of the turn and of all before it), depth, role, segment, n_tokens, start (of its
    tokens in the depth-first layout), position (of its first token in any conversation through it), attends (intervals
    [start, end) of the layout that its tokens see besides the earlier ones of the node itself), loss_start and
    loss_end (code points of the segment; null: no loss).
    """

    conversations: DataFrame
    steps: DataFrame
    nodes: DataFrame


def escaped(text: Column) -> Column:
    r"""A backslash doubles, and \_ parts a control string after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\_")


def unescaped(text: Column) -> Column:
    plain = lambda p: F.replace(F.replace(p, F.lit("\\_"), F.lit("")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _identified(turns: Column) -> Column:
    """array<struct<h1, h2, key>> by turn: two hashes of the turn and of all before it, and 16 bytes of its own."""
    own = lambda seed: F.transform(turns, lambda t, i: F.xxhash64(F.lit(seed), i, t["role"], t["text"]))

    def joined(one: Column, two: Column) -> Column:
        ends = lambda x: F.slice(prefixes(x, xor), F.lit(2), F.size(x))
        hexed = lambda x: F.lpad(F.hex(x), 16, "0")
        keys = F.zip_with(one, two, lambda a, b: F.unhex(F.concat(hexed(a), hexed(b))))
        return F.arrays_zip(ends(one).alias("h1"), ends(two).alias("h2"), keys.alias("key"))

    return let(own(1), lambda one: let(own(2), lambda two: joined(one, two)))


def build_forest(conversations: DataFrame) -> Forest:
    """Formats conversations (conv_id, turn, role, text) as a forest of shared turns.

    A conversation's rows come by turn, then role and text where turns tie, nulls first; null roles and texts count as
    empty. Rows with a null conv_id are one conversation. Conversations with the same first turns share their nodes, and
    equal ones all of them. Tokens are the UTF-8 bytes of the formatted text. A turn is
    OPEN role newline text CLOSE newline; control strings inside roles and texts are escaped, reversibly. The text of
    assistant turns is under the loss mask. Other columns are ignored; an empty table gives an empty forest.

    One conversation's turns are the most that a task gathers. Depth first is the order of (rank of the first
    conversation through a node, depth), with conversations ranked by the digests of their turns: a range sort and
    distributed prefix sums, so a tree that holds most conversations needs no task of its own. Nodes with one first
    conversation are neighbours in the layout, so ancestors are a few intervals, one for each place where the tree
    parts, and all of it grows with the rows and not with the square of a conversation's length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    numbered = grouped.withColumn("c", F.monotonically_increasing_id()).withColumn("ids", _identified(F.col("turns")))
    pathed = written(numbered, "conversations")
    convs = pathed.select("c", "conv_id", F.size("turns").cast("long").alias("n_turns"))
    steps = pathed.select("c", F.posexplode("ids").alias("level", "x")).select("c", (F.col("level") + 1).alias("level"), "x.h1", "x.h2")
    keys = pathed.select("c", F.array_join(F.transform("ids", lambda x: F.hex(x["key"])), "").alias("key"), F.lit(1).cast("long").alias("one"))
    ranks = written(running_totals(keys, ["key", "c"], {"rank": "one"}).select("c", "rank"), "ranks")
    ranked = written(steps.join(ranks, "c").select("c", "rank", "level", "h1", "h2"), "steps")
    firsts = ranked.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.min("level").alias("depth"))
    each = pathed.select(F.explode(F.arrays_zip("ids", "turns")).alias("x")).select("x.ids.h1", "x.ids.h2", "x.turns.role", "x.turns.text")
    unique = each.groupBy("h1", "h2").agg(F.any_value(F.struct("role", "text")).alias("t")).join(firsts, ["h1", "h2"])
    header = F.concat(F.lit(OPEN), F.replace(escaped(F.col("t.role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = unique.select("h1", "h2", "first", "depth", F.col("t.role").alias("role"), header.alias("header"), escaped(F.col("t.text")).alias("body"))
    loss = F.when(F.col("role") == "assistant", F.length("header"))
    segment = F.concat("header", "body", F.lit(CLOSE + "\n"))
    sized = parts.select("h1", "h2", "first", "depth", "role", segment.alias("segment"), F.octet_length(segment).cast("long").alias("n_tokens"), loss.alias("loss_start"), (loss + F.length("body")).alias("loss_end"))
    nodes = written(sized, "nodes")
    narrow = nodes.select("h1", "h2", "first", "depth", "n_tokens")
    laid = written(running_totals(narrow, ["first", "depth"], {"start": "n_tokens"}).select("h1", "h2", "first", "start", "n_tokens"), "laid")
    runs = ranked.join(laid, ["h1", "h2"]).groupBy("rank", "first").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    above = F.when(F.col("first") < F.col("rank"), F.struct("start", "end"))
    seen = written(runs, "runs").groupBy("rank").agg(F.sort_array(F.collect_list(above)).alias("above"), F.min(F.when(F.col("first") == F.col("rank"), F.col("start"))).alias("head"))
    placed = nodes.join(laid.select("h1", "h2", "start"), ["h1", "h2"]).join(seen.where("head IS NOT NULL"), F.col("first") == F.col("rank"))
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)")
    own = F.when(F.col("start") > F.col("head"), F.array(F.struct(F.col("head").alias("start"), F.col("start").alias("end")))).otherwise(none)
    placed = placed.withColumn("attends", F.concat("above", own)).drop("first", "rank", "above", "head")
    return Forest(convs, ranked.drop("rank"), placed.withColumn("position", seen_tokens(F.col("attends"))))


def seen_tokens(attends: Column) -> Column:
    """How many tokens the intervals hold."""
    return F.aggregate(attends, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def token_ids(nodes: DataFrame) -> DataFrame:
    """Adds token_ids (bytes of the segment) and position_ids of each node."""
    bytes_of = F.transform(F.sequence(F.lit(1), F.col("n_tokens").cast("int")), lambda k: F.call_function("conv", F.hex(F.call_function("substring", F.encode("segment", "utf-8"), k, F.lit(1))), F.lit(16), F.lit(10)).cast("int"))
    return nodes.withColumns({"token_ids": bytes_of, "position_ids": F.sequence("position", F.col("position") + F.col("n_tokens") - 1)})


def read_back(forest: Forest) -> DataFrame:
    """Each conversation as the forest has it: conv_id, formatted, turns (role and text, unescaped), loss (texts),
    n_positions (one more than the last position id), attended (tokens that its turns see before them, all together).

    The texts and positions come from the nodes alone.
    """
    nodes = forest.nodes.select("h1", "h2", F.struct("segment", "loss_start", "loss_end", "position", "n_tokens", seen_tokens(F.col("attends")).alias("seen")).alias("node"))
    whole = forest.steps.join(written(nodes, "segments"), ["h1", "h2"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("nodes"))
    whole = whole.join(forest.conversations.select("c", "conv_id"), "c").select("conv_id", F.transform("nodes", lambda n: n["node"]).alias("nodes"))
    under = F.filter("nodes", lambda n: n["loss_start"].isNotNull())
    masked = lambda n: unescaped(F.call_function("substring", n["segment"], n["loss_start"] + 1, n["loss_end"] - n["loss_start"]))
    last = F.element_at("nodes", -1)
    joined = whole.select(
        "conv_id", F.array_join(F.transform("nodes", lambda n: n["segment"]), "").alias("formatted"), F.transform(under, masked).alias("loss"),
        (last["position"] + last["n_tokens"]).alias("n_positions"), F.aggregate("nodes", F.lit(0).cast("long"), lambda acc, n: acc + n["seen"]).alias("attended"),
    )
    parsed = F.arrays_zip(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1)).alias("role"), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2)).alias("text"))
    plain = F.transform(parsed, lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))
    return joined.select("conv_id", "formatted", plain.alias("turns"), "loss", "n_positions", "attended")


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of `conversations` as `read_back` returns them."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss", "")
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_positions",
        "attended",
    )
