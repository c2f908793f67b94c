"""Queries that apply text, path, box, fold and decision rules to the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import geometry as G
from sheaf.functions import markup as M
from sheaf.functions import text as T
from sheaf.functions import values as V
from sheaf.operators import folds, policy
from sheaf.plans.registry import query, table

# Forms that the tables lack, put around their texts by id.
_WRAPPED = r"""
SELECT conv_id, turn, CASE (conv_id + turn) % 11
  WHEN 0 THEN '$$ ' || t || ' $$' WHEN 1 THEN '\[' || t || '\]' WHEN 2 THEN '\( ' || t || ' \)' WHEN 3 THEN '$' || t || '$'
  WHEN 4 THEN '![alt](pic.png)' || chr(10) || chr(10) || chr(10) || chr(10) || t WHEN 5 THEN '```json' || chr(10) || t || chr(10) || '```'
  WHEN 6 THEN '\{\{\{' || t || '\}\}' WHEN 7 THEN ' <p>' || chr(10) || '  <b>' || t || '</b>  </p> ' WHEN 8 THEN '\usepackage{x} `\alpha`' || t WHEN 9 THEN '$$' || t ELSE t END AS t
FROM (SELECT conv_id, turn, left(text, 200) AS t FROM conversations)
"""


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.left("text", F.lit(200)), (F.col("conv_id") + F.col("turn")) % 11
    around = {0: ("$$ ", " $$"), 1: (r"\[", r"\]"), 2: (r"\( ", r" \)"), 3: ("$", "$"), 4: ("![alt](pic.png)\n\n\n\n", ""), 5: ("```json\n", "\n```"), 6: (r"\{\{\{", r"\}\}"), 7: (" <p>\n  <b>", "</b>  </p> "), 8: (r"\usepackage{x} `\alpha`", ""), 9: ("$$", "")}
    out = t
    for n, (a, b) in around.items():
        out = F.when(k == n, F.concat(F.lit(a), t, F.lit(b))).otherwise(out)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("t"))


@query("markup_rules", rf"""
WITH w AS ({_WRAPPED}), s AS (SELECT conv_id, turn, t, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b FROM w)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t, '(\\\{{)+', '\\{{', 'g'), '(\\\}})+', '\\}}', 'g')) AS braces,
  md5(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS images,
  md5(CASE WHEN regexp_extract(t, '(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$', 1) <> '' THEN regexp_extract(t, '(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$', 1) ELSE t END) AS fences,
  md5(trim(regexp_replace(regexp_replace(t, '>\s+<', '><', 'g'), '\s+', ' ', 'g'))) AS html,
  md5(CASE WHEN starts_with(b, '$$') AND ends_with(b, '$$') AND length(b) >= 4 THEN regexp_replace(b[3:-3], '^\s+|\s+$', '', 'g') WHEN starts_with(b, '\[') AND ends_with(b, '\]') THEN regexp_replace(b[3:-3], '^\s+|\s+$', '', 'g')
       WHEN starts_with(b, '\(') AND ends_with(b, '\)') THEN regexp_replace(b[3:-3], '^\s+|\s+$', '', 'g') WHEN starts_with(b, '$') AND ends_with(b, '$') AND length(b) > 1 THEN regexp_replace(b[2:-2], '^\s+|\s+$', '', 'g') ELSE b END) AS body,
  nullif(regexp_replace(left(t, 9), '\s+', '', 'g'), '') AS identifier
FROM s
""")
def markup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces, images, fences, HTML, formula bodies and identifiers; texts as their md5."""
    t, md5 = F.col("t"), lambda c: F.md5(c.cast("binary"))
    return _wrapped(spark, sf_dir).select(
        "conv_id", "turn", md5(M.single_braces(t)).alias("braces"), md5(M.without_images(t)).alias("images"), md5(M.without_fences(t)).alias("fences"),
        md5(M.compact_html(t)).alias("html"), md5(M.formula_body(t)).alias("body"), M.bare_identifier(F.left(t, F.lit(9))).alias("identifier"),
    )


@query("formula_blocks", rf"""
WITH w AS ({_WRAPPED}), s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(\\\{{)+', '\\{{', 'g'), '(\\\}})+', '\\}}', 'g') AS t FROM w),
p AS (SELECT conv_id, turn, CASE WHEN contains(t, chr(10)) THEN t WHEN starts_with(t, '$$') AND NOT ends_with(t, '$$') THEN regexp_replace(t[3:], '^\s+', '') WHEN ends_with(t, '$$') AND NOT starts_with(t, '$$') THEN regexp_replace(t[:-3], '\s+$', '') ELSE t END AS t FROM s),
q AS (SELECT *, regexp_replace(t[3:-3], '^\s+|\s+$', '', 'g') AS inside, CASE WHEN contains(t, 'usepackage') THEN regexp_replace(t, '\\usepackage\{{[^}}]+\}}', '', 'g') ELSE t END AS bare FROM p)
SELECT conv_id, turn, CASE
  WHEN starts_with(t, '$$') AND ends_with(t, '$$') THEN CASE WHEN contains(inside, '$') THEN t ELSE '$$' || chr(10) || inside || chr(10) || '$$' END
  WHEN starts_with(t, '\[') AND ends_with(t, '\]') THEN '$$' || chr(10) || inside || chr(10) || '$$'
  WHEN regexp_matches(t, '\\\[.*\\\]') OR regexp_matches(t, '\$[^$]+\$') THEN t
  WHEN NOT regexp_matches(t, '(?s)\$\$.*?\$\$|\$[^$\n]+?\$|\\[a-zA-Z]+|\\\[.*?\\\]|\\\(.*?\\\)') THEN t
  ELSE '$$' || chr(10) || bare || chr(10) || '$$' END AS block FROM q
""")
def formula_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("conv_id", "turn", M.formula_block(F.col("t")).alias("block"))


@query("line_joins", r"""
WITH l AS (SELECT conv_id, turn, role, list_filter([trim(x) FOR x IN regexp_split_to_array(text, '[\r\n]+')], lambda x: x <> '') AS parts FROM conversations),
j AS (SELECT *, list_reduce(list_prepend('', parts), lambda a, x: a || CASE WHEN regexp_matches(a, '[A-Za-z0-9]$') AND regexp_matches(x, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || x) AS plain FROM l)
SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN regexp_replace(plain, '^#+\s*', '') ELSE plain END) AS joined FROM j
""")
def line_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text as one, of user turns as of titles."""
    category = F.when(F.col("role") == "user", "Title").otherwise("Text")
    marked = F.when(F.col("role") == "user", F.regexp_replace("text", r"^\s*#+\s", "")).otherwise(F.col("text"))
    one = M.on_one_line(marked, category)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(one, F.lit(r"^#+\s*"), F.when(F.col("role") == "user", F.lit("")).otherwise(F.regexp_extract(one, r"^#+\s*", 0))).cast("binary")).alias("joined"))


@query("key_paths", r"""
WITH k AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '../' || url WHEN 2 THEN '//' || url || '/' WHEN 3 THEN url || '/ a?b /c.pdf' WHEN 4 THEN url || '//x..pdf' ELSE url END AS key FROM pages),
s AS (SELECT page_id, key, CASE WHEN regexp_replace(replace(key, '..', ''), '^/+', '') = '' THEN 'unnamed' ELSE regexp_replace(replace(key, '..', ''), '^/+', '') END AS safe FROM k)
SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_replace(trim(x), '[:*?"<>|]', '_', 'g') = '' THEN 'unnamed' ELSE regexp_replace(trim(x), '[:*?"<>|]', '_', 'g') END FOR x IN string_split(safe, '/')], lambda x: x <> '.'), '/') AS path,
  CASE WHEN trim(key) = '' THEN 'unnamed' ELSE regexp_replace(replace(trim(key), '/', '_'), '[:*?"<>|]', '_', 'g') END AS component FROM s
""")
def key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id") % 6, F.col("url")
    key = F.when(n == 0, "").when(n == 1, F.concat(F.lit("../"), url)).when(n == 2, F.concat(F.lit("//"), url, F.lit("/"))).when(n == 3, F.concat(url, F.lit("/ a?b /c.pdf"))).when(n == 4, F.concat(url, F.lit("//x..pdf"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", M.local_path(key).alias("path"), M.safe_component(key).alias("component"))


@query("tolerant_times", """
WITH s AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%a, %-d %b %Y %H:%M:%S +0000') ELSE 'soon ' || event_id END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM s
""")
def tolerant_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id") % 4, F.col("ts")
    mail = F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, mail).otherwise(F.concat(F.lit("soon "), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(M.tolerant_time(text)).alias("seconds"))


def _floats(first: int, n: int) -> Column:
    return F.transform(F.slice("embedding", first, n), lambda x: x.cast("double"))


@query("box_rules", """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
p AS (SELECT vec_id, e, [e[1] * 900, e[3] * 900, e[5] * 900, e[7] * 900] AS xs, [e[2] * 900, e[4] * 900, e[6] * 900, e[8] * 900] AS ys FROM v),
c AS (SELECT vec_id, e, greatest(floor(list_min(xs)), 0) AS x1, greatest(floor(list_min(ys)), 0) AS y1, least(ceil(list_max(xs)), 200) AS x2, least(ceil(list_max(ys)), 150) AS y2 FROM p)
SELECT vec_id, CASE WHEN x2 > x1 AND y2 > y1 THEN array_to_string([CAST(x AS BIGINT) FOR x IN [x1, y1, x2, y2]], ',') END AS clipped, coalesce(x2 > x1 AND y2 > y1, false) AS legal,
  CASE WHEN abs(e[1]) * 5e7 + 1 > 1e6 THEN CAST(floor(200 * sqrt(1e6 / ((abs(e[1]) * 5e7 + 1)))) AS INTEGER) ELSE 200 END AS dpi,
  array_to_string([CAST(b.k // 3 AS VARCHAR) || ':' || (b.k % 3) FOR b IN list_slice(list_sort([{'s': -e[k + 1], 'k': k} FOR k IN range(12)]), 1, 4)], ',') AS best,
  array_to_string([CAST(-w.i AS VARCHAR) FOR w IN list_reverse_sort([{'w': len(list_filter(e[3 * i + 1 : 3 * i + 3], lambda x: x > 0)), 'i': -i} FOR i IN range(3)])], ',') AS reading
FROM c
""")
def box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped polygons, legal boxes, page resolution, best detections and reading order by votes."""
    points = F.transform(_floats(1, 8), lambda x: x * 900)
    box = G.clipped(points, 200, 150)
    pixels = (F.abs(_floats(1, 1)[0]) * 5e7 + 1) / (200 / 72) ** 2
    best = F.transform(M.top_boxes(_floats(1, 12), 3, 4), lambda b: F.concat(b["box"].cast("string"), F.lit(":"), b["label"].cast("string")))
    votes = F.array(_floats(1, 3), _floats(4, 3), _floats(7, 3))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_join(F.transform(box, lambda x: x.cast("long").cast("string")), ",").alias("clipped"), F.coalesce(G.is_legal(box), F.lit(False)).alias("legal"),
        M.page_dpi(pixels, F.lit(1.0), 200, 1_000_000).alias("dpi"), F.array_join(best, ",").alias("best"), F.array_join(M.reading_order(votes).cast("array<string>"), ",").alias("reading"),
    )


@query("kept_blocks", """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
b AS (SELECT label, vec_id, vec_id % 3 AS kind, floor((e[1] + 1) * 400) AS x1, floor((e[2] + 1) * 400) AS y1, floor((e[1] + 1) * 400) + floor(abs(e[3]) * 300) AS x2, floor((e[2] + 1) * 400) + floor(abs(e[4]) * 300) AS y2 FROM v)
SELECT vec_id, kind <> 2 AND (x2 - x1) * (y2 - y1) / 1e6 >= 0.001 AS kept, kind = 1 OR vec_id % 5 = 0 AS bad FROM b
""")
def kept_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without a dropped kind and tiny ones; cells without a category or with a box of three numbers."""
    e, k = _floats(1, 4), F.col("vec_id") % 3
    x, y = F.floor((e[0] + 1) * 400).cast("double"), F.floor((e[1] + 1) * 400).cast("double")
    box = F.array(x, y, x + F.floor(F.abs(e[2]) * 300), y + F.floor(F.abs(e[3]) * 300)).cast("array<double>")
    block = F.array(F.struct(F.concat(F.lit("kind"), k.cast("string")).alias("kind"), box.alias("bbox")))
    cell = F.array(F.struct(F.when(k == 1, "").otherwise("Text").alias("category"), F.when(F.col("vec_id") % 5 == 0, F.slice(box, 1, 3)).otherwise(box).alias("bbox")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.size(M.kept_blocks(block, ["kind2"], 0.001, 5)) == 1).alias("kept"), M.first_bad_cell(cell).isNotNull().alias("bad"))


_EVENTS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, event_type, value FROM events)"


def _histories(spark: SparkSession, sf_dir: str, *values: Column) -> DataFrame:
    """What each user did, in order: the history of one state machine."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", *values))).alias("h"))


@query("breaker_states", f"""
WITH RECURSIVE {_EVENTS}, s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 0 AS failed, CAST(NULL AS DOUBLE) AS opened, '' AS state FROM e
  UNION ALL
  SELECT user_id, k, CASE WHEN st = 'open' THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN st = 'open' THEN opened WHEN NOT ok AND failed + 1 >= 2 THEN moment WHEN ok THEN NULL ELSE opened END, st
  FROM (SELECT e.user_id, e.k, CAST(e.event_id AS DOUBLE) AS moment, e.event_type <> 'error' AS ok, s.failed, s.opened,
          CASE WHEN s.opened IS NULL THEN 'closed' WHEN e.event_id - s.opened >= 300 THEN 'half_open' ELSE 'open' END AS st FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
)
SELECT user_id, count(*) FILTER (state = 'closed') AS closed, count(*) FILTER (state = 'open') AS opened, count(*) FILTER (state = 'half_open') AS half, md5(string_agg(state, ',' ORDER BY k)) AS states FROM s WHERE k > 0 GROUP BY 1
""")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = F.transform("h", lambda x: F.struct(x["event_id"].cast("double").alias("at"), x["ok"].alias("ok")))
    told = _histories(spark, sf_dir, (F.col("event_type") != "error").alias("ok")).select("user_id", folds.breaker_states(outcomes, 2, 300.0).alias("s"))
    n = lambda state: F.size(F.filter("s", lambda x: x == state)).cast("long")
    return told.select("user_id", n("closed").alias("closed"), n("open").alias("opened"), n("half_open").alias("half"), F.md5(F.array_join("s", ",").cast("binary")).alias("states"))


@query("limit_trajectory", f"""
WITH RECURSIVE {_EVENTS}, s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(16 AS BIGINT) AS now FROM e
  UNION ALL
  SELECT e.user_id, e.k, CASE WHEN e.event_type = 'error' THEN greatest(1, CAST(floor(s.now * 0.75) AS BIGINT))
    WHEN (e.event_id % 40 >= greatest(1, s.now - 1) OR e.event_type = 'view') AND s.now < 64 THEN least(64, greatest(s.now + 8, CAST(ceil(s.now * 1.25) AS BIGINT))) ELSE s.now END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1
)
SELECT user_id, arg_max(now, k) AS last, min(now) AS least, max(now) AS most, CAST(sum(now) AS BIGINT) AS total FROM s WHERE k > 0 GROUP BY 1
""")
def limit_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = [(F.col("event_type") == "error").cast("int").alias("errors"), (F.col("event_id") % 40).cast("int").alias("inflight"), (F.col("event_type") == "view").cast("int").alias("waiting")]
    path = _histories(spark, sf_dir, *sample).select("user_id", folds.limit_trajectory(F.col("h"), 16, 64).alias("p"))
    long = lambda c: c.cast("long")
    return path.select("user_id", long(F.element_at("p", -1)).alias("last"), long(F.array_min("p")).alias("least"), long(F.array_max("p")).alias("most"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("intake_pauses", f"""
WITH {_EVENTS}, p AS (SELECT user_id, last_value(CASE WHEN event_id % 100 >= 70 THEN 1 WHEN event_id % 100 <= 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paused FROM e)
SELECT user_id, CAST(coalesce(sum(paused), 0) AS BIGINT) AS paused, count(*) AS n FROM p GROUP BY 1
""")
def intake_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = _histories(spark, sf_dir, (F.col("event_id") % 100).cast("int").alias("level"))
    told = level.select("user_id", folds.hysteresis(F.col("h.level"), 30, 70).alias("p"))
    return told.select("user_id", F.size(F.filter("p", lambda x: x)).cast("long").alias("paused"), F.size("p").cast("long").alias("n"))


@query("trimmed_spools", """
WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, turn, strlen(text) + 1 AS size FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, sum(size) AS total FROM l GROUP BY 1),
s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS turn FROM t
  UNION ALL
  SELECT l.conv_id, l.k, s.used + CASE WHEN s.used + l.size <= 800 THEN l.size ELSE 0 END, CASE WHEN s.used + l.size <= 800 THEN l.turn ELSE -1 END FROM s JOIN l ON l.conv_id = s.conv_id AND l.k = s.k + 1
)
SELECT conv_id, CASE WHEN any_value(total) <= 1000 THEN max(k) ELSE count(*) FILTER (turn >= 0) END AS kept, CAST(CASE WHEN any_value(total) <= 1000 THEN any_value(total) ELSE max(used) END AS BIGINT) AS bytes FROM s JOIN t USING (conv_id) GROUP BY 1
""")
def trimmed_spools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spools of 1000 bytes: the turns of each conversation, newest first."""
    lines = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    kept = lines.select("conv_id", folds.trimmed_spool(F.col("l.text"), 1000).alias("k"))
    return kept.select("conv_id", F.size("k").cast("long").alias("kept"), F.aggregate("k", F.lit(0), lambda a, x: a + F.octet_length(x) + 1).cast("long").alias("bytes"))


@query("marker_levels", f"""
WITH RECURSIVE {_EVENTS}, s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 1 AS last, CAST(NULL AS INTEGER) AS level FROM e
  UNION ALL
  SELECT user_id, k, coalesce(level, last), level FROM (
    SELECT e.user_id, e.k, s.last, CASE WHEN e.event_type = 'signup' THEN 1 WHEN e.event_type IN ('click', 'view') THEN least(3, greatest(2, coalesce(CASE WHEN e.event_id % 3 = 0 THEN CAST(e.event_id % 5 AS INTEGER) END, s.last + 1))) END AS level
    FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
)
SELECT user_id, string_agg(coalesce(CAST(level AS VARCHAR), '-'), '' ORDER BY k) AS levels FROM s WHERE k > 0 GROUP BY 1
""")
def marker_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_type") == "signup", "Title").when(F.col("event_type").isin("click", "view"), "Section-header").otherwise("Text")
    level = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 5).cast("int"))
    lines = _histories(spark, sf_dir, category.alias("category"), level.alias("level")).select("user_id", folds.marker_levels(F.col("h")).alias("l"))
    return lines.select("user_id", F.array_join(F.transform("l", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "").alias("levels"))


@query("resume_decisions", """
SELECT o_orderkey, CASE WHEN side AND NOT snap THEN 'snapshot_mismatch' WHEN side AND NOT iden THEN 'path_mismatch' WHEN side AND NOT arts THEN 'artifacts_incomplete' WHEN side THEN 'done'
  WHEN need THEN 'sidecar_missing' WHEN coalesce(size, -1) > 0 THEN 'done' WHEN size = 0 THEN 'empty_markdown' ELSE 'new' END AS decision
FROM (SELECT o_orderkey, o_orderstatus <> 'O' AS side, o_orderkey % 5 <> 0 AS snap, o_orderkey % 7 <> 0 AS iden, o_orderkey % 3 <> 0 AS arts, starts_with(o_orderpriority, '1') AS need, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 END AS size FROM orders)
""")
def resume_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    size = F.when(key % 4 == 0, 0).when(key % 4 == 1, 10)
    told = policy.resume_decision(F.col("o_orderstatus") != "O", key % 5 != 0, key % 7 != 0, key % 3 != 0, size, F.startswith("o_orderpriority", F.lit("1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("decision"))


@query("execution_limits", """
SELECT s_suppkey, s_acctbal < 0 AS paused, CASE WHEN s_acctbal < 0 THEN 1 WHEN s_suppkey % 3 = 1 THEN s_suppkey WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 ELSE 1 END AS "limit",
  CASE WHEN s_acctbal < 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'disk_free' ELSE 'resource_pressure' END ELSE 'ready' END AS reason FROM supplier
""")
def execution_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    reasons = F.when(key % 2 == 0, F.array(F.lit("disk_free"), F.lit("x"))).otherwise(F.expr("cast(array() AS array<string>)"))
    told = policy.execution_limit(F.col("s_acctbal") < 0, reasons, F.when(key % 3 == 1, key).when(key % 3 == 2, 0), key % 4)
    return table(spark, sf_dir, "supplier").select("s_suppkey", told.alias("x")).select("s_suppkey", "x.*")


@query("certifications", """
WITH p AS (
  SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'off' WHEN 2 THEN 'verified' ELSE 'certified' END AS rule, CASE c_custkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'verified' ELSE 'certified' END AS status,
         CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'r' || c_nationkey END AS revision, c_acctbal > 0 AS risk, CASE WHEN c_custkey % 13 <> 0 THEN 'r' || c_nationkey END AS build, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 19 = 0 END AS dirty FROM customer
), c AS (
  SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (r IS NULL OR trim(r) = '' OR d IS NULL) AS m, count(*) FILTER (coalesce(r <> p.revision, false) OR coalesce(d, false)) AS x
  FROM (SELECT o_custkey, CASE WHEN o_orderkey % 97 <> 0 THEN 'r' || c_nationkey END AS r, o_orderkey % 89 = 0 AS d FROM orders JOIN customer ON c_custkey = o_custkey) JOIN p ON p.id = o_custkey GROUP BY 1
), j AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(x, 0) AS x FROM p LEFT JOIN c USING (id)),
t AS (
  SELECT *, CASE WHEN coalesce(rule, 'off') = 'off' THEN 'allowed'
    WHEN rule = 'verified' THEN CASE WHEN status NOT IN ('verified', 'certified') THEN 'mismatch' WHEN status = 'verified' AND NOT risk THEN 'risk_acceptance_required' WHEN status = 'certified' AND trim(revision) = '' THEN 'missing' ELSE 'allowed' END
    WHEN status <> 'certified' THEN 'mismatch' WHEN trim(revision) = '' OR build IS NULL OR dirty IS NULL OR n = 0 OR m > 0 THEN 'missing' WHEN build <> revision OR dirty OR x > 0 THEN 'mismatch' ELSE 'allowed' END AS decision FROM j
)
SELECT id AS profile_id, decision, CASE WHEN rule = 'certified' AND decision = 'missing' THEN m WHEN rule = 'certified' AND decision = 'mismatch' THEN x ELSE 0 END AS affected FROM t
""")
def certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand in for profiles and their orders for candidate builds."""
    key, of = F.col("c_custkey"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))
    customers = table(spark, sf_dir, "customer")
    profiles = customers.select(
        key.alias("profile_id"), F.when(key % 4 == 1, "off").when(key % 4 == 2, "verified").when(key % 4 == 3, "certified").alias("enforcement"),
        F.when(key % 3 == 0, "draft").when(key % 3 == 1, "verified").otherwise("certified").alias("status"), F.when(key % 11 == 0, " ").otherwise(of).alias("revision"),
        (F.col("c_acctbal") > 0).alias("risk_accepted"), F.when(key % 13 != 0, of).alias("build_revision"), F.when(key % 17 != 0, key % 19 == 0).alias("build_dirty"),
    )
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == key)
    candidates = orders.select(key.alias("profile_id"), F.when(F.col("o_orderkey") % 97 != 0, of).alias("revision"), (F.col("o_orderkey") % 89 == 0).alias("dirty"))
    return policy.certification(profiles, candidates)


@query("manifest_roots", """
WITH i AS (SELECT l_orderkey AS job_id, '/data/' || CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber % 2 ELSE 0 END || '/' || l_partkey || '.pdf' AS input, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 'other.pdf' ELSE l_partkey || '.pdf' END AS rel FROM lineitem),
r AS (SELECT job_id, CASE WHEN ends_with(input, '/' || rel) THEN left(input, length(input) - length(rel) - 1) END AS root FROM i)
SELECT job_id, CASE WHEN count(*) = count(root) AND count(DISTINCT root) = 1 THEN min(root) END AS root FROM r GROUP BY 1
""")
def manifest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("l_orderkey") % 5 == 0, F.col("l_linenumber") % 2).otherwise(0).cast("string")
    own = F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf"))
    inputs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.concat(F.lit("/data/"), folder, F.lit("/"), own).alias("input_path"),
        F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1), "other.pdf").otherwise(own).alias("relative_path"),
    )
    return policy.manifest_root(inputs)


@query("bundle_checks", """
WITH k AS (SELECT o_orderkey AS id, ['b' || id || '/s.md', 'b' || id || '/s_origin.md', 'b' || id || '/pages/1.json', 'x/s_layout.pdf', 'b' || id || '/s_pages.json'] AS keys FROM orders)
SELECT id, list_bool_and([CASE WHEN kind = 'page_json' THEN len(list_filter(have, lambda x: contains(x, '/pages/'))) > 0 ELSE len(list_filter(have, lambda x: ends_with(x, kind))) > 0 END FOR kind IN want]) AS complete
FROM (SELECT id, list_filter(keys[1 : 1 + id % 5], lambda x: starts_with(x, 'b' || id || '/')) AS have, CASE id % 3 WHEN 0 THEN ['s.md'] WHEN 1 THEN ['s.md', 'page_json'] ELSE ['s_origin.md', 's_layout.pdf'] END AS want FROM k)
""")
def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    base = F.concat(F.lit("b"), key.cast("string"))
    made = F.array(*(F.concat(base, F.lit(x)) for x in ("/s.md", "/s_origin.md", "/pages/1.json")), F.lit("x/s_layout.pdf"), F.concat(base, F.lit("/s_pages.json")))
    kinds = lambda *x: F.array(*map(F.lit, x))
    wanted = F.when(key % 3 == 0, kinds("markdown")).when(key % 3 == 1, kinds("markdown", "page_json")).otherwise(kinds("origin_md", "layout_pdf"))
    there = F.slice(made, F.lit(1), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), policy.bundle_complete(there, base, F.lit("s"), wanted).alias("complete"))


@query("width_folding", """
SELECT p_partkey, p_name || ' 12' AS folded, CASE WHEN contains('timeout|temporarily', 'timeout') THEN contains(lower(p_type), 'connection') END AS transient FROM part
""")
def width_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width forms come back as the ASCII they were made from."""
    ascii_, wide = "".join(chr(0x21 + k) for k in range(94)) + " ", "".join(chr(0xFF01 + k) for k in range(94)) + "　"
    widened = F.translate(F.concat("p_name", F.lit(" 12")), ascii_, wide)
    return table(spark, sf_dir, "part").select("p_partkey", V.half_width(widened).alias("folded"), T.is_transient(F.col("p_type")).alias("transient"))
