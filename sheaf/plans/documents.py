"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.functions import vocab
from sheaf.functions.values import let
from sheaf.plans.registry import query, table
from sheaf.sources.scratch import is_small, partitions, written


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _failure_sql(message: str) -> str:
    """The rules as a CASE over a lower-cased SQL expression."""
    rules = "".join(
        " WHEN " + " AND ".join("(" + " OR ".join(f"contains({message}, {_quoted(x)})" for x in group) + ")" for group in groups) + f" THEN '{category}'"
        for category, groups in vocab.FAILURE_RULES
    )
    return f"CASE WHEN {message} = '' THEN 'unknown'{rules} WHEN starts_with({message}, 'file extension ') THEN 'input_invalid' ELSE 'parser_failed' END"


@query("failure_taxonomy", f"""
WITH m AS (
  SELECT text, doc_id FROM documents UNION ALL SELECT text, conv_id FROM conversations
  UNION ALL SELECT x, -1 FROM (VALUES ('CUDA out of memory'), ('Connection refused by host'), ('HTTP 503 Bad Gateway'), ('timed out'), (''), ('Permission denied: output/x')) v(x)
), c AS (SELECT {_failure_sql("lower(text)")} AS category, {" OR ".join(f"contains(lower(text), {_quoted(x)})" for x in vocab.TRANSIENT_FRAGMENTS)} AS transient FROM m)
SELECT category, transient, count(*) AS n FROM c GROUP BY ALL
""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.createDataFrame([(x,) for x in ("CUDA out of memory", "Connection refused by host", "HTTP 503 Bad Gateway", "timed out", "", "Permission denied: output/x")], "text string")
    messages = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "conversations").select("text")).union(probes)
    return messages.groupBy(T.failure_category(F.col("text")).alias("category"), T.is_transient(F.col("text")).alias("transient")).agg(F.count("text").alias("n"))


def _language_sql(text: str) -> str:
    counts = ", ".join(f"(len(regexp_extract_all({text}, '[{vocab.LANGUAGE_LETTERS[name]}]')), {-k}, '{name}')" for k, name in enumerate(vocab.LANGUAGE_ORDER))
    return f"list_max([{counts}])"


@query("lang_detect", f"""
WITH c AS (SELECT doc_id, {_language_sql("text")} AS best FROM documents)
SELECT doc_id, CASE WHEN best[1] > 0 THEN best[3] ELSE 'Others' END AS language FROM c
""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.script_language(F.col("text")).alias("language"))


@query("doc_features", r"""
WITH l AS (
  SELECT doc_id, i, regexp_matches(parts[i], '^\s*\|.*\|\s*$') AS bar
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), runs AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE bar),
t AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, island FROM runs GROUP BY ALL HAVING count(*) >= 3))
SELECT d.doc_id, t.doc_id IS NOT NULL OR regexp_matches(text, '(?is)<table\b.*?>.*?</table>') AS has_table,
       regexp_matches(text, '!\[[^\]]*\]\([^)]+\)|(?i)<img\b[^>]*>') AS has_image,
       regexp_matches(text, '(?s)\$\$.*?\$\$|\$[^$\n]+?\$|\\[a-zA-Z]+|\\\[.*?\\\]|\\\(.*?\\\)') AS has_latex,
       len(regexp_extract_all(text, '[一-龥]')) >= 5 AS enough_han
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
""")
def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.has_table(text).alias("has_table"), T.has_image(text).alias("has_image"), T.has_latex(text).alias("has_latex"), (F.regexp_count(text, F.lit("[一-龥]")) >= 5).alias("enough_han")
    )


_PLAIN = "text"
for _pattern, _new in (*vocab.PLAIN_STEPS, (r"\s+", " ")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_new.replace('$1', chr(92) + '1')}', 'g')"


@query("word_stats", f"""
WITH w AS (SELECT doc_id, n_chars, len(regexp_extract_all(p, '[一-鿿]')) + len(regexp_extract_all(p, '[A-Za-z0-9'']+')) AS words FROM (SELECT doc_id, n_chars, {_PLAIN} AS p FROM documents))
SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(ceil(words * 3 / 2.0) AS BIGINT) AS estimate FROM w
""")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", T.word_total(F.col("text")).alias("words"))
    return counted.select("doc_id", "words", T.estimated_words(F.col("words"), F.lit(2), F.lit(3)).cast("long").alias("estimate"))


@query("md_table_runs", r"""
WITH l AS (
  SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE contains(line, '|'))
SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS first_line, count(*) AS lines FROM runs GROUP BY doc_id, island
""")
def md_table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring lines with a bar, as islands of equal differences."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.contains("line", F.lit("|")))
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.select("doc_id", "i", island.alias("island")).groupBy("doc_id", "island").agg(F.min("i").alias("first_line"), F.count("i").alias("lines")).drop("island")


@query("dup_suppression", """
SELECT doc_id, source FROM documents
QUALIFY (count(*) OVER (PARTITION BY source, text) < 5 OR row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1)
    AND (n_chars IS NULL OR row_number() OVER (PARTITION BY lang, n_chars, left(text, 64) ORDER BY doc_id) = 1)
""")
def dup_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five or more rows with one category and text the first stays, and of several with one box the first.

    Sources stand in for categories, and (lang, n_chars, first characters) for boxes. Texts meet as 128 bits of hash.
    """
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.xxhash64("text").alias("h1"), F.md5(F.col("text").cast("binary")).alias("h2"), "lang", "n_chars", F.left("text", F.lit(64)).alias("begins")
    )
    texts, boxes = Window.partitionBy("source", "h1", "h2"), Window.partitionBy("lang", "n_chars", "begins")
    counted = rows.select("doc_id", "source", "n_chars", F.count("*").over(texts).alias("n"), F.row_number().over(texts.orderBy("doc_id")).alias("k"), F.row_number().over(boxes.orderBy("doc_id")).alias("b"))
    return counted.where("(n < 5 OR k = 1) AND (n_chars IS NULL OR b = 1)").select("doc_id", "source")


_AUTHORS = r"""
WITH b AS (SELECT doc_id, text, regexp_replace(text, '<[^>]+>', '', 'g') AS bare FROM documents),
w AS (
  SELECT *, regexp_split_to_array(lower(bare), '[\s;(),]+') AS words, [regexp_replace(x, '^,+|,+$', '', 'g') FOR x IN regexp_split_to_array(left(bare, 200), '[\s;()]+')] AS parts,
         length(regexp_replace(text, '[^¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§′]', '', 'g')) + len(regexp_extract_all(text, '<sup>')) AS marks,
         list_sum([(length(lower(bare)) - length(replace(lower(bare), k, ''))) // length(k) FOR k IN [ASCII]]) + list_sum([(length(bare) - length(replace(bare, k, ''))) // length(k) FOR k IN [OTHER]]) AS places FROM b
), n AS (
  SELECT *, len([x FOR x IN parts IF length(x) > 1 AND ((length(x) <= 4 AND regexp_matches(x, '[一-龥]')) OR (NOT list_contains([ASCII], lower(x)) AND (regexp_matches(x, '^[A-Z][a-z-]+') OR (length(x) < 15 AND regexp_matches(x, '^[A-Z][A-Z-]*[A-Z]$')))))]) AS names,
         len([x FOR x IN words IF list_contains([STOPS], x)]) AS stops FROM w
), s AS (
  SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 20 OR stops / len(words) > 0.1 THEN 0 ELSE
    CASE WHEN regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') THEN 3 ELSE 0 END + CASE WHEN marks >= 5 THEN 4 WHEN marks >= 2 THEN 3 ELSE 0 END + CASE WHEN places >= 3 THEN 3 WHEN places >= 1 THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(bare, '\b\d{5,}\b') THEN 2 ELSE 0 END + CASE WHEN (length(text) - length(replace(text, ',', ''))) / length(text) > 0.03 THEN 1 ELSE 0 END + CASE WHEN names > 5 THEN 3 WHEN names > 2 THEN 2 ELSE 0 END
    + CASE WHEN len(regexp_extract_all(text, '\b(DEGREES)\b')) >= 2 THEN 2 ELSE 0 END END AS score FROM n
)
SELECT doc_id, CAST(score AS INTEGER) AS score, score >= 5 AS is_author_block FROM s
"""
for _name, _words in {
    "ASCII": [w.lower() for w in vocab.AUTHOR_INSTITUTIONS if w.isascii()], "OTHER": [w for w in vocab.AUTHOR_INSTITUTIONS if not w.isascii()], "STOPS": vocab.AUTHOR_STOP_WORDS,
}.items():
    _AUTHORS = _AUTHORS.replace(f"[{_name}]", "[" + ", ".join(map(_quoted, _words)) + "]")


@query("author_block_score", _AUTHORS.replace("DEGREES", "|".join(vocab.AUTHOR_DEGREES)))
def author_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", T.author_score(F.col("text")).alias("score"))
    return scored.withColumn("is_author_block", F.col("score") >= 5)


_UNSAFE = {
    "url": r"(?i)\b(?:https?|ftp|s3)://\S+",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "internal_host": r"(?i)\b(?:localhost|[a-z0-9-]+\.(?:internal|local|corp|lan))\b",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._~+/-]{8,}",
    "assigned_secret": r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}


@query("unsafe_text_flags", "SELECT kind, id, flags FROM (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {key} AS id, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches({col}, '{p}') THEN '{name}' END''' for name, p in _UNSAFE.items())}], lambda x: x IS NOT NULL), ',') AS flags FROM {tab}"
    for kind, key, col, tab in (("document", "doc_id", "text", "documents"), ("page", "page_id", "html", "pages"))
) + ") WHERE flags <> ''")
def unsafe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def flagged(kind: str, key: str, text: str, tab: str) -> DataFrame:
        flags = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), name) for name, p in _UNSAFE.items())))
        return table(spark, sf_dir, tab).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.array_join(flags, ",").alias("flags"))

    return flagged("document", "doc_id", "text", "documents").union(flagged("page", "page_id", "html", "pages")).where("flags <> ''")


_TITLE = r"""regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"""


@query("slugify_names", rf"""
WITH t AS (SELECT page_id, {_TITLE} AS title FROM pages),
s AS (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(title, '(\d+)\.(\d+)', '\1-\2', 'g'), '[^\p{{L}}\p{{N}}_\s-]', '', 'g')), '[-\s]+', '_', 'g') AS slug FROM t),
n AS (SELECT page_id, CASE WHEN slug <> '' THEN 'page_' || page_id || '_' || left(slug, 50) ELSE 'page_' || page_id || '_img_' || (page_id + 1) END AS name, left(slug, 8) AS base FROM s)
SELECT page_id, name, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS unique_name FROM n WINDOW w AS (PARTITION BY base ORDER BY page_id)
""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names from titles, and short ones made unique by a running number."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    named = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), T.caption_slug(title, F.col("page_id"), F.col("page_id")).alias("name"))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("title", r"(\d+)\.(\d+)", "$1-$2"), r"(?U)[^\w\s-]", ""), r"(?U)^\s+|\s+$", ""), r"(?U)[-\s]+", "_")
    based = named.withColumn("base", F.left(slug, F.lit(8)))
    n = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    return based.select("page_id", "name", F.concat("base", F.when(n == 1, "").otherwise(F.concat(F.lit("_"), n.cast("string")))).alias("unique_name"))


@query("markdown_assembly", """
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '## ' || text WHEN 'system' THEN '> ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS markdown, count(*) AS pages
FROM conversations WHERE text <> '' GROUP BY 1
""")
def markdown_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each document in order, each in the form of its kind."""
    body = F.when(F.col("role") == "user", F.concat(F.lit("## "), "text")).when(F.col("role") == "system", F.concat(F.lit("> "), "text")).otherwise(F.col("text"))
    pages = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", F.struct("turn", body.alias("body")).alias("p"))
    whole = pages.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("conv_id", F.array_join(F.col("p.body"), "\n\n").alias("markdown"), F.size("p").cast("long").alias("pages"))


_MERGE_PROBES = (
    (-1, 0, "an exam-"), (-1, 1, "ple goes on, and"), (-1, 2, "stops."), (-1, 3, "Next"), (-1, 4, "1. listed"), (-1, 5, "wide 中"), (-1, 6, "文 words (so)"), (-1, 7, "and 7"), (-1, 8, "x"), (-1, 9, "- y"), (-1, 10, "no end,"), (-1, 11, "(a) z"), (-1, 12, "entry ..... "), (-1, 13, "end”"),
)


_MERGE = rf"""
WITH every AS (SELECT conv_id, turn, text FROM (SOURCE)),
n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM every),
s AS (SELECT *, regexp_replace(text, '\s+$', '') AS a, regexp_replace(following, '^\s+', '') AS b, regexp_replace(text, '[{vocab.CLOSERS.replace("'", "''")}\s]+$', '') AS bare FROM n)
SELECT conv_id, turn, length(CASE WHEN ends_with(a, '-') AND length(a) > 1 AND regexp_matches(b, '^[a-zA-Z]') THEN left(a, length(a) - 1) || b
       WHEN regexp_matches(a, '[a-zA-Z0-9]$') AND regexp_matches(b, '^[a-zA-Z0-9]') THEN a || ' ' || b ELSE a || b END) AS merged_chars
FROM s WHERE a <> '' AND b <> '' AND NOT regexp_matches(a, '[0-9]$') AND bare <> '' AND NOT regexp_matches(bare, '[{vocab.SENTENCE_ENDS}]$')
  AND NOT (regexp_matches(a, '[a-zA-Z]$') AND regexp_matches(following, '[一-龥]')) AND NOT regexp_matches(following, '^(?:{vocab.NEW_PARAGRAPH})') AND NOT regexp_matches(b, '^[-*•]')
  AND NOT regexp_matches(text, '{vocab.CONTENTS_ENTRY}') AND NOT regexp_matches(following, '{vocab.CONTENTS_ENTRY}')
"""


def _merged(turns: DataFrame) -> DataFrame:
    """Neighbouring pages of which the first goes on in the second, and the length of the two as one."""
    follow = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", "text", follow.alias("follow")).where(T.goes_on(F.col("text"), F.col("follow")))
    return pairs.select("conv_id", "turn", F.length(T.joined_pair(F.col("text"), F.col("follow"))).cast("long").alias("merged_chars"))


@query("text_merge_candidates", _MERGE.replace("SOURCE", "SELECT * FROM conversations"))
def text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(table(spark, sf_dir, "conversations"))


@query("text_merge_rules", _MERGE.replace("SOURCE", "SELECT conv_id, turn, text FROM (VALUES " + ", ".join(f"({c}, {t}, {_quoted(x)})" for c, t, x in _MERGE_PROBES) + ") v(conv_id, turn, text) UNION ALL SELECT doc_id, k, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)"))
def text_merge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules on probes of every kind and on the lines of all documents."""
    probes = spark.createDataFrame(_MERGE_PROBES, "conv_id long, turn long, text string")
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n", -1)).alias("turn", "text"))
    return _merged(probes.union(lines.select("conv_id", (F.col("turn") + 1).cast("long").alias("turn"), "text")))


@query("fixture_check", """
WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
d AS (SELECT doc_id, text FROM documents)
SELECT doc_id, item_id, contains(text, w[1]) AND contains(text, w[2]) AS has_fields,
       contains(text, w[1]) AND contains(substr(text, instr(text, w[1]) + length(w[1])), w[2]) AS in_order
FROM d, b WHERE contains(text, w[1]) AND len(w) >= 2
""")
def fixture_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required tokens of each fixture in each output, and whether they come in order; fixtures are a small fixed set.

    Every output is compared with the fixtures as one array, in one pass and without a join; fixtures with the same first
    token are looked up once, and only those that an output holds become rows.
    """
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.split("text", " ", -1), 1, 2).alias("w")).where(F.size("w") == 2)
    alike = wanted.groupBy(F.col("w")[0].alias("first")).agg(F.collect_list(F.struct("item_id", "w")).alias("items"))
    fixtures = alike.agg(F.collect_list(F.struct("first", "items"))).scalar()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fixtures.alias("all"))
    docs = docs.select("doc_id", "text", F.filter("all", lambda x: F.contains("text", x["first"])).alias("held"))
    docs = docs.select("doc_id", "text", F.explode(F.flatten("held.items")).alias("x"))
    has = lambda k: F.contains("text", F.col("x.w")[k])
    return docs.select("doc_id", "x.item_id", (has(0) & has(1)).alias("has_fields"), T.tokens_in_order(F.col("text"), F.col("x.w")).alias("in_order"))


@query("path_eligibility", """
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages),
r AS (SELECT n_nationkey AS pos, '/' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS root FROM nation JOIN pages ON page_id = n_nationkey * 3)
SELECT page_id, path, min(pos) AS first_check, arg_min(root, pos) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1, 2
""")
def path_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first root that holds each path. Every beginning of a path that ends at a segment is looked up by equality."""
    pages = table(spark, sf_dir, "pages")
    paths = pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "/").alias("path"))
    roots = table(spark, sf_dir, "nation").join(pages, F.col("page_id") == F.col("n_nationkey") * 3)
    roots = roots.select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)).alias("root"))
    parts = F.split("path", "/", -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return paths.withColumn("root", F.explode(F.array_distinct(starts))).join(roots, "root").groupBy("page_id", "path").agg(F.min("pos").alias("first_check"), F.min_by("root", "pos").alias("root"))


@query("output_audit", """
WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY 1),
a AS (
  SELECT CASE WHEN d.n_chars IS NULL OR d.n_chars <> length(d.text) THEN 'bad_row' WHEN f.first <> d.doc_id THEN 'duplicate_path' WHEN l.doc_id IS NULL THEN 'sidecar_missing'
              WHEN l.quality = 0 AND l.toxic = 1 THEN 'failed_pages' WHEN l.quality = 0 THEN 'freshness_mismatch' ELSE 'ok' END AS reason, d.doc_id
  FROM documents d JOIN f ON f.text = d.text LEFT JOIN labels l ON l.doc_id = d.doc_id
)
SELECT reason, count(*) AS n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS samples FROM a GROUP BY 1
""")
def output_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output gets the first reason that holds; samples are the least five ids, found by a ranked limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h1"), F.md5(F.col("text").cast("binary")).alias("h2"), (F.col("n_chars").isNull() | (F.col("n_chars") != F.length("text"))).alias("bad"))
    first = docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    joined = docs.join(first, ["h1", "h2"]).join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    reason = (
        F.when(F.col("bad"), "bad_row").when(F.col("first") != F.col("doc_id"), "duplicate_path").when(F.col("labelled").isNull(), "sidecar_missing")
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), "failed_pages").when(F.col("quality") == 0, "freshness_mismatch").otherwise("ok")
    )
    told = joined.select("doc_id", reason.alias("reason"))
    counts = told.groupBy("reason").agg(F.count("doc_id").alias("n"))
    least = told.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("doc_id"))).where("k <= 5")
    samples = least.groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(samples, "reason")


@query("resume_antijoin", """
SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
  AND NOT EXISTS (SELECT 1 FROM documents e JOIN labels l ON l.doc_id = e.doc_id AND l.quality = 1 WHERE e.text = d.text)
""")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do: not done under its id, and not under its checksum; an unknown checksum is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("sum"))
    done = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return docs.join(done.select("doc_id"), "doc_id", "left_anti").join(done.select("sum").distinct(), "sum", "left_anti").select("doc_id")


@query("index_record", f"""
WITH d AS (SELECT d.*, l.quality, {_language_sql("text")} AS best FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, source || '/' || doc_id || '.md' AS origin, md5(text) AS checksum, CASE WHEN best[1] > 0 THEN best[3] ELSE 'Others' END AS language,
       coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unlabelled') AS label, strlen(text) AS size_bytes
FROM d
""")
def index_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat corpus record of each document."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    return joined.select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("origin"), F.md5(F.col("text").cast("binary")).alias("checksum"),
        T.script_language(F.col("text")).alias("language"), label.alias("label"), F.octet_length("text").cast("long").alias("size_bytes"),
    )


@query("taxonomy_lookup", """
WITH dim AS (SELECT p_brand AS label, split_part(p_type, ' ', 1) AS code, row_number() OVER (ORDER BY p_partkey) AS pos FROM part),
by_label AS (SELECT label, min(pos) AS pos FROM dim GROUP BY 1), by_code AS (SELECT code, min(pos) AS pos FROM dim GROUP BY 1),
q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'none' END AS label, split_part(p_type, ' ', 1) AS code FROM part)
SELECT p_partkey, coalesce(a.label, d.label) AS matched, a.label IS NOT NULL AS exact
FROM q LEFT JOIN by_label a USING (label) LEFT JOIN by_code b ON b.code = q.code LEFT JOIN dim d ON d.pos = b.pos
""")
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the full label, else by its code; of labels with one code the first registered wins."""
    part = table(spark, sf_dir, "part")
    code = F.split_part("p_type", F.lit(" "), F.lit(1))
    by_label = part.select(F.col("p_brand").alias("label")).distinct().withColumn("known", F.col("label"))
    by_code = part.groupBy(code.alias("code")).agg(F.min_by("p_brand", "p_partkey").alias("first"))
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("none").alias("label"), code.alias("code"))
    joined = asked.join(by_label, "label", "left").join(by_code, "code", "left")
    return joined.select("p_partkey", F.coalesce("known", "first").alias("matched"), F.col("known").isNotNull().alias("exact"))


#: Hash functions of a signature, and the prime that bounds them: function k is (h * _factor(k) + k) modulo PRIME.
SEEDS, PRIME = 64, 2**31 - 1


def _factor(seed: int) -> int:
    return seed * 2654435761 % PRIME


@query("minhash_label_match", rf"""
WITH lab AS (SELECT trim(p_type) AS label, min(p_partkey) AS pos FROM part WHERE trim(p_type) <> '' GROUP BY 1),
texts AS (SELECT 'd' || p_partkey AS id, p_name AS t FROM part WHERE trim(p_name) <> '' UNION ALL SELECT 'l' || label, label FROM lab),
norm AS (SELECT id, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS t FROM texts),
sh AS (SELECT DISTINCT id, substr(t, i, 3) AS s FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM norm)),
h AS (SELECT id, CAST('0x' || left(md5(s), 12) AS BIGINT) % {PRIME} AS h FROM sh),
sig AS (SELECT id, seed, min((h * (seed * 2654435761 % {PRIME}) + seed) % {PRIME}) AS m FROM h, (SELECT unnest(range(1, {SEEDS} + 1)) AS seed) GROUP BY ALL),
sc AS (SELECT d.id AS doc, substr(l.id, 2) AS label, count(*) AS agree FROM sig d JOIN sig l USING (seed, m) WHERE d.id LIKE 'd%' AND l.id LIKE 'l%' GROUP BY ALL),
best AS (SELECT doc, label, agree FROM sc JOIN lab USING (label) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY agree DESC, pos) = 1)
SELECT p_partkey, coalesce(best.label, (SELECT arg_min(label, pos) FROM lab)) AS label, coalesce(agree, 0) AS agree
FROM part LEFT JOIN best ON doc = 'd' || p_partkey WHERE trim(p_name) <> ''
""")
def minhash_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that agrees with each text on most of 64 hash minima; ties, and texts that agree with none, get the
    label that comes first.

    Texts that are the same without what is no letter or digit are signed once, as are labels. Every shingle is hashed
    once, and the 64 functions are arithmetic on that, kept as 64 minima of one aggregate. Signatures meet by (seed,
    minimum), an equi join, so labels that agree nowhere are never compared.
    """
    bare = F.regexp_replace(F.lower("t"), r"(?U)[^\w]+", "").alias("bare")

    def signed(texts: DataFrame) -> DataFrame:
        """bare, seed, m, of distinct bare texts, which are dealt out by number: their bytes say little of their work."""
        shingles = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda k: F.array_join(F.slice(c, k, F.lit(3)), ""))
        cut = texts.repartition(partitions(spark), "bare").select("bare", F.explode(let(F.split("bare", "", -1), shingles)).alias("s"))
        hashed = cut.select("bare", (F.call_function("conv", F.left(F.md5(F.col("s").cast("binary")), F.lit(12)), F.lit(16), F.lit(10)).cast("long") % PRIME).alias("h"))
        minima = hashed.groupBy("bare").agg(*(F.min((F.col("h") * _factor(k) + k) % PRIME).alias(f"m{k}") for k in range(1, SEEDS + 1)))
        return minima.select("bare", F.posexplode(F.array(*(f"m{k}" for k in range(1, SEEDS + 1)))).alias("seed", "m"))

    part = table(spark, sf_dir, "part")
    asked = part.where("trim(p_name) <> ''").select("p_partkey", F.col("p_name").alias("t")).select("p_partkey", bare)
    labels = part.where("trim(p_type) <> ''").groupBy(F.trim("p_type").alias("t")).agg(F.min("p_partkey").alias("pos"))
    labels = labels.select("pos", F.col("t").alias("label"), bare).groupBy("bare").agg(F.min(F.struct("pos", "label")).alias("l"))  # of labels signed alike the first wins
    labels = written(labels, "labels")
    known = labels.join(signed(labels.select("bare")), "bare").select("seed", "m", "l")
    if is_small(labels, (F.octet_length("l.label") + 50) * SEEDS):
        known = F.broadcast(known)
    found = signed(asked.select("bare").distinct()).join(known, ["seed", "m"]).groupBy("bare", "l").agg(F.count("seed").alias("agree"))
    best = found.groupBy("bare").agg(F.min(F.struct(-F.col("agree"), "l.pos", "l.label")).alias("b"))
    first = labels.agg(F.min("l")["label"].alias("first")).scalar()
    named = asked.join(best, "bare", "left")
    return named.select("p_partkey", F.coalesce("b.label", first).alias("label"), F.coalesce(-F.col("b.col1"), F.lit(0)).cast("long").alias("agree"))


@query("html_links", r"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b[^>]*href')) AS links, len(regexp_extract_all(html, '(?i)<img\b')) AS images,
       regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_count("html", F.lit(r"(?i)<a\b[^>]*href")).cast("long").alias("links"), F.regexp_count("html", F.lit(r"(?i)<img\b")).cast("long").alias("images"),
        F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"),
    )


@query("log_scrape", r"""
SELECT event_id, CAST(regexp_extract(line, 'k=(\d+)', 1) AS BIGINT) AS k, len(regexp_extract_all(line, 'r')) AS hits FROM
  (SELECT event_id, event_type || ' k=' || json_extract_string(props, '$.k') || ' done' AS line FROM events)
""")
def log_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and counts from log lines; what isn't a number is null."""
    line = F.concat("event_type", F.lit(" k="), F.get_json_object("props", "$.k"), F.lit(" done"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).select(
        "event_id", F.regexp_extract("line", r"k=(\d+)", 1).try_cast("long").alias("k"), F.regexp_count("line", F.lit("r")).cast("long").alias("hits")
    )


@query("path_validity", r"""
SELECT url, NOT contains(p, '\') AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..')
       AND ends_with(lower(list_last(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')))), '.pdf') AS valid
FROM (SELECT url, CASE WHEN page_id % 4 = 0 THEN '../' WHEN page_id % 4 = 1 THEN '/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '' END AS p FROM pages)
""")
def path_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("page_id") % 4 == 0, "../").when(F.col("page_id") % 4 == 1, "/").otherwise("")
    path = F.concat(start, F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(""))
    return table(spark, sf_dir, "pages").select("url", T.valid_relative_path(path).alias("valid"))
