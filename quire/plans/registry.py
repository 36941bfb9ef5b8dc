"""The library's own queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalogue as C
from quire.operators import changes, search
from quire.plans.base import FOUND as _FOUND
from quire.plans.base import query as _query
from quire.sources.tables import chapters, table, works
from quire.streaming import tasks

_WORKS = """WITH works AS (SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.source AS sitename, greatest(d.n_chars, 0) AS length,
 [d.lang, d.source, CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'long' END] AS tags,
 coalesce(l.toxic = 1, false) AS frozen, l.quality = 1 AS finished FROM documents d LEFT JOIN labels l USING (doc_id)),
 listed AS (SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN frozen THEN 'frozen' END, CASE WHEN finished THEN 'finished' END), ''), 'serialising') AS status FROM works)
"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).withColumn("status", C.status())


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("task"), "ts", "event_id", F.col("event_type").alias("status"), "value")


@_query(_WORKS + "SELECT id, title, sitename, length, status, array_to_string(tags, ' ') AS tags, frozen FROM listed")
def catalogue_scan(spark, d):
    return _listed(spark, d).select("id", "title", "sitename", "length", "status", F.array_join("tags", " ").alias("tags"), "frozen").orderBy(F.desc("length"), "title", "id")


@_query(_WORKS + """SELECT id, title, length, status FROM listed WHERE (tags[1] LIKE '%en%' OR tags[2] LIKE '%en%' OR tags[3] LIKE '%en%' OR tags[1] LIKE '%de%' OR tags[2] LIKE '%de%' OR tags[3] LIKE '%de%')
 AND NOT tags[2] LIKE '%src0%' AND NOT frozen ORDER BY length DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def catalogue_page(spark, d):
    found = _listed(spark, d).filter(C.compile_filter("tag:en|de -tag:src0") & C.in_states(["nonfrozen"]))
    return C.page(found, "length", 20, 20).select("id", "title", "length", "status")


@_query(_WORKS + "SELECT id, status FROM listed WHERE contains(lower(title), 'the') OR contains(lower(sitename), 'the') OR contains(status, 'the') OR len(list_filter(tags, lambda x: contains(lower(x), 'the'))) > 0")
def text_filter(spark, d):
    return _listed(spark, d).filter(C.compile_filter("the")).select("id", "status")


@_query(_WORKS + "SELECT status, count(*) AS works FROM listed GROUP BY status")
def status_counts(spark, d):
    return _listed(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("works"))


@_query(_WORKS + "SELECT count(*) AS total, count(*) FILTER (frozen) AS frozen, coalesce(max(id) + 1, 0) AS next_id FROM works")
def catalogue_counts(spark, d):
    return works(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if("frozen").alias("frozen"), F.coalesce(F.max("id") + 1, F.lit(0)).alias("next_id"))


@_query(_WORKS + "SELECT id FROM works WHERE list_contains(tags, 'en') AND list_contains(tags, 'short')")
def tag_exact_and(spark, d):
    return works(spark, d).filter(C.has_all_tags(["en", "short"])).select("id")


@_query(_WORKS + "SELECT tag, count(*) AS works FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM works) GROUP BY tag")
def tag_counts(spark, d):
    return C.tag_rows(works(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("works"))


@_query(_WORKS + ", t AS (SELECT id, unnest(list_distinct(tags)) AS tag FROM works) SELECT tag, id, n AS works FROM t JOIN (SELECT tag, count(*) AS n FROM t GROUP BY tag) USING (tag)")
def tag_index(spark, d):
    rows = C.tag_rows(works(spark, d))
    return rows.join(rows.groupBy("tag").agg(F.count(F.lit(1)).alias("works")), "tag").select("tag", "id", "works")


@_query(_WORKS + "SELECT tag, count(*) AS works, count(*) FILTER (frozen) AS selected FROM (SELECT frozen, unnest(list_distinct(tags)) AS tag FROM works) GROUP BY tag")
def tag_selection_info(spark, d):
    rows = works(spark, d).select("frozen", F.explode(F.array_distinct("tags")).alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("works"), F.count_if("frozen").alias("selected"))


@_query(_WORKS + "SELECT id, array_to_string(list_filter(tags, lambda x: x <> 'short'), ' ') || CASE WHEN finished THEN ' end' ELSE '' END AS tags FROM works")
def tag_edits(spark, d):
    add = F.when(F.col("finished"), F.array(F.lit("end"))).otherwise(F.array().cast("array<string>"))
    return works(spark, d).select("id", F.array_join(C.edited_tags(F.col("tags"), add, F.array(F.lit("short"))), " ").alias("tags"))


@_query(_WORKS + "SELECT id FROM works WHERE id NOT IN (SELECT id FROM works WHERE list_contains(tags, 'en'))")
def tag_complement(spark, d):
    return works(spark, d).filter(~F.coalesce(F.array_contains("tags", "en"), F.lit(False))).select("id")


@_query(_WORKS + """, t(target) AS (VALUES ('https://example.com/a'), ('n1234ab'), ('17'), ('999999999999'), ('Is'), (''))
SELECT target, CASE WHEN regexp_matches(target, '(?i)^https?://') THEN 'url' WHEN regexp_matches(target, '(?i)^n[0-9]+[a-z]+$') THEN 'ncode' WHEN regexp_matches(target, '^[0-9]+$') THEN 'id' ELSE 'other' END AS kind,
 coalesce((SELECT min(id) FROM works WHERE id = TRY_CAST(target AS BIGINT)), (SELECT min(id) FROM works WHERE title = target)) AS id FROM t""")
def target_resolution(spark, d):
    targets = spark.createDataFrame([(x,) for x in ("https://example.com/a", "n1234ab", "17", "999999999999", "Is", "")], "target string")
    return C.resolved(targets, works(spark, d)).select("target", C.target_kind(F.col("target")).alias("kind"), "id")


@_query("SELECT o_orderkey AS work, o_orderdate AS updated, n_name AS site FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def update_order(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left")
    return joined.select(F.col("o_orderkey").alias("work"), F.col("o_orderdate").alias("updated"), F.col("n_name").alias("site")).orderBy(F.desc_nulls_last("updated"), "work")


@_query(_WORKS + "SELECT id, coalesce(nullif(CASE WHEN finished THEN 'new ' || id ELSE '' END, ''), title) AS title, sitename FROM works")
def work_upsert(spark, d):
    stored = works(spark, d).select("id", "title", "sitename")
    labels = table(spark, d, "labels")
    title = F.when(F.col("quality") == 1, F.concat(F.lit("new "), F.col("doc_id").cast("string"))).otherwise("")
    return changes.upsert(stored, labels.select(F.col("doc_id").alias("id"), title.alias("title"), F.lit("").alias("sitename")), "id")


@_query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') || ':' || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS work, min(page_id) AS page_id, count(*) AS pages FROM pages GROUP BY 1")
def discovery_dedup(spark, d):
    return table(spark, d, "pages").groupBy(T.work_id(F.col("url")).alias("work")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))


@_query("""WITH o AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS title, min(l_shipdate) AS day FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
 n AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS title, max(l_shipdate) AS day FROM lineitem GROUP BY ALL)
SELECT n.l_orderkey AS work, n.l_linenumber AS chapter, CASE WHEN o.title IS NULL THEN 'new' WHEN o.title <> n.title THEN 'title' WHEN n.day > o.day THEN 'revised' ELSE 'same' END AS class FROM n LEFT JOIN o USING (l_orderkey, l_linenumber)""")
def contents_changes(spark, d):
    lines, key = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    old = lines.filter("l_linestatus = 'F'").groupBy(*key).agg(F.min("l_returnflag").alias("old_title"), F.min("l_shipdate").alias("old_day"))
    new = lines.groupBy(*key).agg(F.max("l_returnflag").alias("title"), F.max("l_shipdate").alias("day"))
    kind = changes.change_class(F.col("old_title").isNotNull(), F.col("old_title"), F.col("title"), F.col("old_day"), F.col("day"))
    return new.join(old, key, "left").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("chapter"), kind.alias("class"))


@_query("SELECT conv_id AS work, turn AS position, sha256(conv_id || '|' || turn || '|' || coalesce(role, '') || '|' || coalesce(text, '')) AS signature FROM conversations")
def chapter_signatures(spark, d):
    return chapters(spark, d).select("work", "position", F.sha2(changes.metadata_signature("work", "position", "subtitle", "body"), 256).alias("signature"))


@_query("SELECT o_orderkey AS work, coalesce(max(l_shipdate), max(o_orderdate)) AS latest, count(l_orderkey) AS chapters FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def latest_update(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("day"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_orderdate").alias("fallback"))
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(F.col("o_orderkey").alias("work"), F.coalesce("day", "fallback").alias("latest"), F.coalesce("n", F.lit(0)).alias("chapters"))


@_query("SELECT l_orderkey AS work, l_linenumber AS chapter FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def orphan_chapters(spark, d):
    open_orders = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(open_orders, "l_orderkey", "left_anti").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("chapter"))


@_query("SELECT greatest(doc_id - 1, 0) // 1000 + 1 AS shard, count(*) AS works, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def shard_sizes(spark, d):
    shard = F.expr("greatest(doc_id - 1, 0) div 1000 + 1")
    return table(spark, d, "documents").groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("works"), F.sum("n_chars").alias("chars"))


@_query("""SELECT conv_id AS work, turn AS position, row_number() OVER w AS number, (row_number() OVER w - 1) // 3 + 1 AS volume,
 last_value(CASE WHEN role = 'user' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chapter_numbers(spark, d):
    by = Window.partitionBy("work").orderBy("position")
    number = F.row_number().over(by)
    heading = F.last(F.when(F.col("subtitle") == "user", F.substring("body", 1, 20)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return chapters(spark, d).select("work", "position", number.alias("number"), F.floor((number - 1) / 3 + 1).alias("volume"), heading.alias("heading"))


@_query(_WORKS + "SELECT sitename, id, length FROM works QUALIFY row_number() OVER (PARTITION BY sitename ORDER BY length DESC NULLS LAST, id) <= 3")
def longest_of_each_site(spark, d):
    rank = F.row_number().over(Window.partitionBy("sitename").orderBy(F.desc_nulls_last("length"), "id"))
    return works(spark, d).withColumn("rank", rank).filter("rank <= 3").select("sitename", "id", "length")


@_query("SELECT o_custkey AS author, o_orderkey AS work FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 2")
def second_newest_snapshot(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rank", rank).filter("rank = 2").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("work"))


@_query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links FROM pages")
def page_titles(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"))


@_query("SELECT page_id, href, count(*) AS times FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def page_links(spark, d):
    found = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    return table(spark, d, "pages").select("page_id", found.alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("times"))


_STRIPPED = "regexp_replace(html, '(?i)<script\\b[^>]*>(?s:.*?)</script\\s*>|<style\\b[^>]*>(?s:.*?)</style\\s*>|<!--(?s:.*?)-->|<[^>]*>', ' ', 'g')"
for _entity, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("#160", " "), ("amp", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '&{_entity};', '{_sign}')"


@_query(f"SELECT page_id, trim(regexp_replace({_STRIPPED}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM pages")
def html_texts(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@_query(_WORKS + """SELECT id, left(translate(regexp_replace(title, '[\\x00-\\x1f]', '', 'g'), '\\/:*?"<>|.`', '￥／：＊？”〈〉｜．｀'), 80) AS file_name,
 regexp_replace(title, '[^0-9 \\n.,!?]', '●', 'g') AS masked, translate(sitename, '0123456789', '〇一二三四五六七八九') AS kanji FROM works""")
def title_forms(spark, d):
    title = F.col("title")
    return works(spark, d).select("id", T.file_name(title).alias("file_name"), T.masked(title).alias("masked"), T.kanji_digits(F.col("sitename")).alias("kanji"))


@_query("SELECT event_type AS status, strftime(ts, '%Y%m%d') AS day, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def payload_by_day(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status"), F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


@_query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents),
 p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1),
 s AS (SELECT count(*) AS n, avg(dl) AS a FROM l), f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('the', 'and', 'license') GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM p JOIN l USING (doc_id) JOIN f USING (term), s GROUP BY 1""")
def text_ranking(spark, d):
    found = search.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "and", "license"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@_query("SELECT user_id AS task, max_by(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1")
def task_states(spark, d):
    return tasks.latest_state(_events(spark, d))


@_query("SELECT status, count(*) AS tasks FROM (SELECT max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) GROUP BY 1")
def task_summary(spark, d):
    return tasks.latest_state(_events(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


@_query("""WITH a AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT * FROM (SELECT user_id AS task, run::BIGINT AS run, min(event_type) AS status, count(*) AS times FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task ORDER BY run DESC) <= 60""")
def message_history(spark, d):
    return tasks.merged_messages(_events(spark, d))


@_query("SELECT date_trunc('hour', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    return tasks.windowed_counts(_events(spark, d))


@_query("SELECT event_id, greatest(least(round(100 * value / 50, 2), 100), 0) AS percent FROM events")
def progress_percent(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.least(F.round(100 * F.col("value") / 50, 2), F.lit(100.0)), F.lit(0.0)).alias("percent"))


@_query("SELECT conv_id AS work, string_agg('## ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def assembled_texts(spark, d):
    part = F.concat(F.lit("## "), F.coalesce("subtitle", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("position", part.alias("part"))))
    return chapters(spark, d).groupBy("work").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("text"))


@_query("""SELECT doc_id, len(regexp_extract_all(text, ',\\n')) AS comma_ends, round(len(list_filter(l, lambda x: NOT regexp_matches(x, '^[ 　\\t]'))) / nullif(len(l), 0), 6) AS unindented
FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS l FROM documents)""")
def layout_inspection(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(",\n")).cast("long").alias("comma_ends"), F.round(T.indent_ratio(F.col("text")), 6).alias("unindented"))


@_query("""SELECT count(*) FILTER (o.day = n.day) AS hits, count(*) FILTER (o.day IS DISTINCT FROM n.day) AS misses, round(100 * count(*) FILTER (o.day = n.day) / count(*), 1) AS rate
FROM (SELECT l_orderkey, max(l_shipdate) AS day FROM lineitem GROUP BY 1) n LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS day FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) o USING (l_orderkey)""")
def cache_hits(spark, d):
    lines = table(spark, d, "lineitem")
    new = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("day"))
    old = lines.filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("old"))
    hit = F.coalesce(F.col("day") == F.col("old"), F.lit(False))
    counted = new.join(old, "l_orderkey", "left").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return counted.select("hits", "misses", F.round(F.try_divide(100 * F.col("hits"), F.col("hits") + F.col("misses")), 1).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quire.plans import conversion, extraction, listing, stores, updates  # noqa: F401  (they register their queries)

    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from quire.plans import conversion, extraction, listing, stores, updates  # noqa: F401  (they register their queries)

    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_page(spark, sf_dir)
