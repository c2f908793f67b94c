"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.scans import add, let, prefixes
from sheaf.sources.scratch import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are long enough: a shorter run holds no match at all, so dropping failing matches comes to the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from narrow to wide: the first whose alphabet covers a token is inferred.
ENCODINGS = (
    _DIGITS,
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _LOWER,
    _UPPER,
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "_-",
)
_WIDEST = _UPPER + _LOWER + _DIGITS + "+/_-"
#: Of the tokens that are ruled out as not random, the share of random ones that is allowed for.
FALSE_DISCOVERIES = 0.05
#: Lengths from which a new stratum of the false-discovery control begins, within each encoding.
STRATA = (20, 24, 32, 48, 96)
#: Steps per unit of the battery's statistic, and the largest value told apart.
STEPS, MOST = 4, 120

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _located(text: Column, pattern: str, inner: Column | None = None) -> Column:
    """Matches with their places in code points: array<struct<start, end, text, inner>>.

    The pieces between matches and the matches alternate, so running sums of their lengths are the places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(pieces.alias("a"), found.alias("b"), (found if inner is None else inner).alias("c"))
    matches = F.filter(zipped, lambda x: x["b"].isNotNull())  # one piece more than matches

    def placed(x: Column) -> Column:
        ends = prefixes(F.transform(x, lambda m: (F.length(m["a"]) + F.length(m["b"])).cast("long")), add)
        place = lambda m, end: F.struct((end - F.length(m["b"])).alias("start"), end.alias("end"), m["b"].alias("text"), m["c"].alias("inner"))
        return F.zip_with(x, F.slice(ends, F.lit(2), F.size(x)), place)

    return F.when(text.rlike(pattern), let(matches, placed))


def _spans(found: Column, kind: str) -> Column:
    of = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    return F.coalesce(of, F.expr(f"cast(array() AS {_SPANS})"))


def _alphabet(token: Column) -> Column:
    out = F.lit(_WIDEST)
    for letters in reversed(ENCODINGS):
        out = F.when(F.length(F.translate(token, letters, "")) == 0, letters).otherwise(out)
    return out


def _uniformity(token: Column, alphabet: Column) -> Column:
    """Pearson's chi-squared of symbol counts against equal shares, as a normal score (Wilson and Hilferty)."""
    n, k = F.length(token), F.length(alphabet)
    squares = F.aggregate(
        F.split(alphabet, ""),
        F.lit(0.0),
        lambda acc, c: acc + F.pow((n - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    free = (k - 1).cast("double")
    statistic = squares * k / n - n
    return (F.cbrt(statistic / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def _runs(token: Column, alphabet: Column) -> Column:
    """Runs of the lower and the upper half of the alphabet against their number in random order (Wald, Wolfowitz)."""
    half = (F.length(alphabet) / 2).cast("int")
    image = F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), F.length(alphabet) - half))
    bits = F.call_function("translate", token, alphabet, image)
    n = F.length(token).cast("double")
    ones = n - F.length(F.replace(bits, F.lit("1"), F.lit("")))
    turns = (2 * n - F.length(F.replace(bits, F.lit("01"), F.lit(""))) - F.length(F.replace(bits, F.lit("10"), F.lit("")))) / 2
    mean = 2 * ones * (n - ones) / n
    spread = F.sqrt(mean * (mean - 1) / (n - 1))
    return F.when(spread > 0, (turns - mean) / spread).otherwise(F.lit(99.0))


def _serial(token: Column, alphabet: Column) -> Column:
    """Correlation of neighbouring symbol values, as a normal score."""
    n = F.length(token).cast("double")
    values = F.transform(F.split(token, ""), lambda c: F.call_function("instr", alphabet, c).cast("double"))
    middle = (F.length(alphabet) + 1) / 2
    apart = F.transform(values, lambda v: v - middle)
    products = F.zip_with(F.slice(apart, 1, F.length(token) - 1), F.slice(apart, 2, F.length(token) - 1), lambda a, b: a * b)
    add = lambda acc, x: acc + x
    squares = F.aggregate(F.transform(apart, lambda v: v * v), F.lit(0.0), add)
    return F.when(squares > 0, F.aggregate(products, F.lit(0.0), add) / squares * F.sqrt(n)).otherwise(F.lit(99.0))


def p_value(statistic: float) -> float:
    """How often the battery's statistic is so large for a random token: the tail of chi-squared of three degrees."""
    return math.erfc(math.sqrt(statistic / 2)) + math.sqrt(2 * statistic / math.pi) * math.exp(-statistic / 2)


def _stratum(n: Column, alphabet: Column) -> Column:
    """A number for the encoding and the length of a token."""
    length, encoding = F.lit(0), F.lit(len(ENCODINGS))
    for k, least in enumerate(STRATA):
        length = F.when(n >= least, k).otherwise(length)
    for k, letters in reversed(list(enumerate(ENCODINGS))):
        encoding = F.when(alphabet == letters, k).otherwise(encoding)
    return encoding * len(STRATA) + length


def _candidates(found: Column) -> Column:
    """Tokens with their stratum and the step of the battery's statistic: the summed squares of its three scores."""

    def judged(m: Column, alphabet: Column) -> Column:
        square = lambda x: x * x
        battery = square(_uniformity(m["text"], alphabet)) + square(_runs(m["text"], alphabet)) + square(_serial(m["text"], alphabet))
        step = F.floor(F.least(F.lit(float(MOST)), battery) * STEPS).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), _stratum(F.length(m["text"]), alphabet).alias("stratum"), step.alias("step"))

    each = F.transform(found, lambda m: let(_alphabet(m["text"]), lambda a: judged(m, a)))
    return F.coalesce(each, F.expr("cast(array() AS array<struct<start:bigint,end:bigint,stratum:int,step:int>>)"))


def _limits(scanned: DataFrame) -> DataFrame:
    """For each stratum the least step that rules a token out as not random (Benjamini and Hochberg).

    Every token is one hypothesis, that it is random, and its p-value that of the battery. The rule holds in each
    stratum by itself, so what is ruled out among short tokens, where the battery sees little, takes nothing from long
    ones. Counts by step are enough, so one row per stratum and step is all that is gathered.
    """
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.step").agg(F.count("c").cast("double").alias("n"))
    up, whole = Window.partitionBy("stratum").orderBy(F.desc("step")), Window.partitionBy("stratum")
    ranked = counts.select("stratum", "step", F.sum("n").over(up).alias("out"), F.sum("n").over(whole).alias("tests"))
    chances = F.array(*(F.lit(p_value(k / STEPS)) for k in range(MOST * STEPS + 1)))
    ruled_out = ranked.where(F.col("tests") * F.get(chances, F.col("step")) <= FALSE_DISCOVERIES * F.col("out"))
    return ruled_out.groupBy("stratum").agg(F.min("step").alias("least"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, n_random, base_spans, added_spans, spans.

    base_spans holds what the three patterns find, leftmost and not overlapping within a kind, in code points, ends
    exclusive; spans holds these and the added ones, as kind:start:end by start and then kind, comma-joined. Added are
    tokens of 20 or more letters, digits and +/_- that the battery doesn't rule out as not random, under the
    false-discovery control of their encoding and length, and that overlap no base span. In short tokens of one kind of
    letters the battery sees little: a long word whose letters are spread evenly may be added. A null text is empty; whole texts of any length count; repeated rows each get
    their row; other columns are ignored. All of it is built-in functions; texts are read once.
    """
    text = F.coalesce("text", F.lit(""))
    assigned = F.filter(_located(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), lambda m: F.length(m["inner"]) >= 12)
    found = docs.select(
        "doc_id",
        _spans(assigned, "assign").alias("assign"),
        _spans(_located(text, ACCESS), "access").alias("access"),
        _spans(_located(text, HEX), "hex").alias("hex"),
        _candidates(_located(text, TOKEN)).alias("candidates"),
    )
    scanned = written(found, "scanned")
    limits = _limits(scanned).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("m"))
    base = F.concat("assign", "access", "hex")
    judged = scanned.select("*", base.alias("base_spans"), limits.scalar().alias("limits"))
    clear = lambda c: ~F.exists("base_spans", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
    real = F.filter("candidates", lambda c: (c["step"] < F.coalesce(F.try_element_at("limits", c["stratum"]), F.lit(math.inf))) & clear(c))
    added = judged.withColumn("added_spans", F.transform(real, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))))
    size = lambda c: F.size(c).cast("long")
    return added.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), size("added_spans").alias("n_random"),
        _joined(F.col("base_spans")).alias("base_spans"), _joined(F.col("added_spans")).alias("added_spans"), _joined(F.concat("base_spans", "added_spans")).alias("spans"),
    )
