"""Queries over stored chapters: merges, changes, outputs, values and tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import changes
from quire.operators import listing as L
from quire.operators import sections as S
from quire.plans.base import RECORDS, query
from quire.sources.tables import records, table
from quire.streaming import tasks

_TURNS = "WITH t AS (SELECT DISTINCT conv_id AS work, turn AS position, role FROM conversations), "
_STORED = _TURNS + """s AS (SELECT work, position, role AS subtitle, 'u' || position AS url, CASE WHEN position % 2 = 0 THEN 'sig' || position ELSE '' END AS signature, position % 3 <> 0 AS downloaded, 1 AS updated FROM t WHERE position % 4 <> 3),
 n AS (SELECT work, position, role || '!' AS subtitle, CASE WHEN position % 5 = 0 THEN '' ELSE 'new' || position END AS url, CASE WHEN position % 2 = 0 THEN '' ELSE 'n' || position END AS signature, true AS downloaded, 2 AS updated FROM t WHERE position % 4 <> 0),
 j AS (SELECT coalesce(s.work, n.work) AS work, coalesce(s.position, n.position) AS position, s.subtitle AS s_subtitle, n.subtitle AS n_subtitle, s.url AS s_url, n.url AS n_url, s.signature AS s_signature, n.signature AS n_signature, s.downloaded AS s_downloaded, s.updated AS s_updated, n.updated AS n_updated, n.work IS NOT NULL AS has FROM s FULL JOIN n ON s.work = n.work AND s.position = n.position) """


def _stored(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), "role").distinct()
    p = F.col("position")
    text = p.cast("string")
    old = t.filter(p % 4 != 3).select("work", "position", F.col("role").alias("subtitle"), F.concat(F.lit("u"), text).alias("url"), F.when(p % 2 == 0, F.concat(F.lit("sig"), text)).otherwise("").alias("signature"), (p % 3 != 0).alias("downloaded"), F.lit(1).alias("updated"))
    new = t.filter(p % 4 != 0).select("work", "position", F.concat("role", F.lit("!")).alias("subtitle"), F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("new"), text)).alias("url"), F.when(p % 2 == 0, "").otherwise(F.concat(F.lit("n"), text)).alias("signature"), F.lit(True).alias("downloaded"), F.lit(2).alias("updated"))
    return old, new


@query(_STORED + "SELECT work, position, CASE WHEN has THEN n_subtitle ELSE s_subtitle END AS subtitle, coalesce(nullif(n_url, ''), s_url, n_url) AS url, coalesce(nullif(n_signature, ''), s_signature, n_signature) AS signature, has OR s_downloaded AS downloaded, CASE WHEN has THEN n_updated ELSE s_updated END AS updated FROM j")
def section_upsert(spark, d):
    return S.merge_sections(*_stored(spark, d))


@query(_STORED + "SELECT work, position, CASE WHEN has THEN n_subtitle ELSE s_subtitle END AS subtitle, CASE WHEN has THEN n_url ELSE s_url END AS url, coalesce(s_signature, '') AS signature, CASE WHEN has AND coalesce(s_signature, '') = '' THEN false ELSE coalesce(s_downloaded, false) END AS downloaded, CASE WHEN has AND coalesce(s_signature, '') = '' THEN n_updated ELSE s_updated END AS updated FROM j")
def placeholder_upsert(spark, d):
    return S.merge_placeholders(*_stored(spark, d))


_WORKS = RECORDS + ", s AS (SELECT id, title, author, length, 'old' AS created_at FROM records WHERE id % 3 <> 0), b AS (SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE 'T' || id END AS title, '' AS author, length + 1 AS length, 'new' AS created_at FROM records WHERE id % 5 <> 0) "


def _work_batch(spark, d):
    r, i = records(spark, d), F.col("id")
    old = r.filter(i % 3 != 0).select("id", "title", "author", "length", F.lit("old").alias("created_at"))
    new = r.filter(i % 5 != 0).select("id", F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("T"), i.cast("string"))).alias("title"), F.lit("").alias("author"), (F.col("length") + 1).alias("length"), F.lit("new").alias("created_at"))
    return old, new


@query(_WORKS + "SELECT coalesce(s.id, b.id) AS id, coalesce(nullif(b.title, ''), s.title) AS title, coalesce(nullif(b.author, ''), s.author) AS author, CASE WHEN b.id IS NOT NULL THEN b.length ELSE s.length END AS length, coalesce(s.created_at, b.created_at) AS created_at FROM s FULL JOIN b ON s.id = b.id")
def work_merge(spark, d):
    return S.merge_works(*_work_batch(spark, d))


@query(_WORKS + "SELECT coalesce(s.id, b.id) AS id, s.title, s.author, coalesce(b.length, s.length) AS length, s.created_at FROM s FULL JOIN b ON s.id = b.id")
def record_merge(spark, d):
    old, new = _work_batch(spark, d)
    return S.merge_records(old, new.select("id", "length"))


@query(_TURNS + "g AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT work, position FROM t WHERE work NOT IN (SELECT doc_id FROM g)")
def deleted_works(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), "role").distinct()
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return S.without_works(rows, gone, "work").select("work", "position")


@query(RECORDS + "SELECT id, title, author, sitename, toc_url, CASE WHEN novel_type = 2 THEN '短編' ELSE '連載' END AS novel_type, array_to_string(tags, ' ') AS tags, frozen::VARCHAR AS frozen, epoch(last_update)::BIGINT AS last_update, coalesce(epoch(new_arrivals)::BIGINT, 0) AS general_lastup FROM records")
def csv_rows(spark, d):
    from quire.sources.files import csv_columns

    return csv_columns(records(spark, d))


@query("SELECT conv_id AS work, turn AS position, turn || ' ' || coalesce(role, '') || '.txt' AS name, length(coalesce(text, '')) AS size FROM conversations")
def chapter_files(spark, d):
    from quire.sources.files import chapter_name

    return table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), chapter_name(F.col("turn"), F.coalesce("role", F.lit(""))).alias("name"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))


@query("SELECT conv_id AS work, turn AS position, coalesce(text, '') AS body, 2 AS versions FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, coalesce(text, ''), 1 FROM conversations WHERE turn % 2 = 1")
def section_history(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("body"))
    before = rows.filter("position % 2 = 0").withColumn("version", F.lit(1))
    now = rows.withColumn("version", F.lit(2))
    counted = before.unionByName(now).groupBy("work", "position", "body").agg(F.count(F.lit(1)).alias("n"))
    once = rows.groupBy("work", "position", "body").agg(F.count(F.lit(1)).alias("m"))
    each = once.join(counted, ["work", "position", "body"]).select("work", "position", "body", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("k"), (F.col("n") / F.col("m")).cast("int").alias("versions"))
    return each.drop("k")


@query("SELECT conv_id AS work, turn AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)) - 1) // 1000 + 1 AS folder FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (text IS NULL OR text = '') = 0)")
def text_export(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), "role", F.col("text").alias("body"))
    whole = rows.groupBy("work").agg(F.count_if(F.coalesce("body", F.lit("")) == "").alias("missing")).filter("missing = 0").select("work")
    n = F.row_number().over(Window.partitionBy("work").orderBy("position", "role", "body"))
    return rows.join(whole, "work", "left_semi").withColumn("number", n).select("work", "position", "number", F.floor((F.col("number") - 1) / 1000 + 1).alias("folder"))


@query(RECORDS + "SELECT id, title || chr(10) || author || chr(10) || 'あらすじ：' || chr(10) || 'of ' || sitename || chr(10) || '掲載ページ:' || chr(10) || toc_url AS head FROM records")
def work_heads(spark, d):
    return records(spark, d).select("id", S.heading_text(F.col("title"), F.col("author"), F.concat(F.lit("of "), F.col("sitename")), F.col("toc_url")).alias("head"))


@query("WITH r AS (SELECT event_type AS kind, event_id::VARCHAR AS title, row_number() OVER (PARTITION BY event_type ORDER BY event_id::VARCHAR) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT kind, kind || ' (' || max(c) || '): ' || string_agg(title, ', ' ORDER BY title) || CASE WHEN max(c) > 5 THEN ' +' || (max(c) - 5) || ' more' ELSE '' END AS line FROM r WHERE n <= 5 GROUP BY kind")
def notification_lines(spark, d):
    return S.notification(table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("title")))


_LINES = """WITH l AS (SELECT l_orderkey AS work, l_linenumber AS position, min(l_returnflag) AS title, min(l_linestatus) AS heading, strftime(min(l_shipdate), '%Y-%m-%d') AS day FROM lineitem GROUP BY ALL),
 c AS (SELECT *, (work + position) % 8 <> 0 AS found, (work + position) % 9 <> 0 AS body, CASE WHEN work % 10 = 1 THEN title || '2' ELSE title END AS n_title, CASE WHEN work % 10 = 2 THEN heading || '2' ELSE heading END AS n_heading,
 CASE WHEN work % 13 = 0 THEN NULL ELSE day END AS o_first, day AS n_first, CASE position % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE day END AS o_rev, CASE WHEN work % 4 = 0 THEN NULL WHEN work % 4 = 1 THEN '' ELSE '1996-01-01' END AS n_rev FROM l) """


def _compared(spark, d):
    w, p = F.col("work"), F.col("position")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("position")).agg(F.min("l_returnflag").alias("title"), F.min("l_linestatus").alias("heading"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("day"))
    old = {"title": F.col("title"), "heading": F.col("heading"), "first": F.when(w % 13 == 0, None).otherwise(F.col("day")), "revised": F.when(p % 3 == 0, "").when(p % 3 == 1, None).otherwise(F.col("day"))}
    new = {"title": F.when(w % 10 == 1, F.concat("title", F.lit("2"))).otherwise(F.col("title")), "heading": F.when(w % 10 == 2, F.concat("heading", F.lit("2"))).otherwise(F.col("heading")), "first": F.col("day"), "revised": F.when(w % 4 == 0, None).when(w % 4 == 1, "").otherwise("1996-01-01")}
    return rows.withColumn("change", S.section_change((w + p) % 8 != 0, (w + p) % 9 != 0, old, new))


_CHANGE = """CASE WHEN NOT found THEN 'new' WHEN title IS DISTINCT FROM n_title THEN 'title' WHEN heading IS DISTINCT FROM n_heading THEN 'heading' WHEN NOT body THEN 'missing'
 WHEN n_rev IS NOT NULL AND coalesce(o_rev, o_first) IS NOT NULL THEN CASE WHEN coalesce(o_rev, o_first) = '' THEN CASE WHEN n_rev <> '' THEN 'dated' ELSE 'same' END WHEN n_rev > coalesce(o_rev, o_first) THEN 'revised' ELSE 'same' END
 ELSE CASE WHEN o_first IS NULL THEN 'undated' WHEN n_first > o_first THEN 'revised' ELSE 'same' END END"""


@query(_LINES + f"SELECT work, position, {_CHANGE} AS change FROM c")
def section_changes(spark, d):
    return _compared(spark, d).select("work", "position", "change")


@query("SELECT l_orderkey AS work, l_linenumber AS position, CASE WHEN l_shipdate = o_orderdate + INTERVAL 1 DAY THEN l_returnflag <> l_linestatus ELSE l_shipdate > DATE '1996-01-01' END AS changed FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def strong_updates(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ship, day = F.col("l_shipdate"), F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
    return rows.select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("position"), S.strongly_changed(ship, day, F.col("l_linestatus"), F.col("l_returnflag"), ship > F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))).alias("changed"))


@query("SELECT conv_id AS work, turn AS position, 'sha256:' || sha256(coalesce(role, '') || chr(0) || coalesce(text, '') || chr(0)) AS signature FROM conversations")
def content_signatures(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), changes.content_signature(F.col("role"), F.col("text"), F.lit("")).alias("signature"))


@query(_STORED + "SELECT work, position, CASE WHEN s_downloaded AND s_signature = n_signature THEN 'saved' WHEN has THEN 'read' ELSE 'kept' END AS verdict FROM j")
def skipped_unchanged(spark, d):
    old, new = _stored(spark, d)
    joined = old.select("work", "position", F.col("signature").alias("stored"), "downloaded").join(new.select("work", "position", "signature", F.lit(True).alias("has")), ["work", "position"], "full_outer")
    same = F.coalesce(F.col("downloaded") & (F.col("stored") == F.col("signature")), F.lit(False))
    return joined.select("work", "position", F.when(same, "saved").when(F.col("has"), "read").otherwise("kept").alias("verdict"))


@query(_LINES + f", e AS (SELECT work, count(*) FILTER ({_CHANGE} NOT IN ('same')) AS updated FROM c GROUP BY work) SELECT work, CASE WHEN work % 3 = 0 AND updated > 0 THEN 'updated' WHEN work % 5 = 0 THEN 'removed' WHEN work % 7 = 0 THEN 'title' WHEN work % 11 = 0 THEN 'story' WHEN work % 13 = 0 THEN 'author' ELSE 'none' END AS outcome FROM e")
def run_outcomes(spark, d):
    w = F.col("work")
    n = _compared(spark, d).groupBy("work").agg(F.count_if(F.col("change") != "same").alias("updated"))
    return n.select("work", S.outcome(F.when(w % 3 == 0, F.col("updated")).otherwise(0), F.when(w % 5 == 0, 1).otherwise(0), w % 7 == 0, w % 11 == 0, w % 13 == 0).alias("outcome"))


@query("SELECT o_orderkey AS work, CASE WHEN o_orderkey % 9 >= o_custkey % 9 THEN 'go on' WHEN o_orderkey % 4 = 0 THEN 'freeze' WHEN o_orderkey % 4 = 1 THEN 'compare' ELSE 'cancel' END AS action FROM orders")
def shrink_decisions(spark, d):
    k = F.col("o_orderkey")
    choice = F.when(k % 4 == 0, "freeze").when(k % 4 == 1, "compare").when(k % 4 == 2, "no such choice")
    return table(spark, d, "orders").select(k.alias("work"), S.shrink(F.col("o_custkey") % 9, k % 9, choice).alias("action"))


@query(RECORDS + "SELECT id, array_to_string(CASE WHEN finished IS NULL THEN tags WHEN finished THEN CASE WHEN list_contains(tags, 'end') THEN tags ELSE tags || ['end'] END ELSE list_filter(tags, lambda x: x <> 'end') END, ' ') AS tags FROM records")
def completion_tags(spark, d):
    return records(spark, d).select("id", F.array_join(S.with_state_tag(F.col("tags"), "end", F.col("finished")), " ").alias("tags"))


@query(RECORDS + "SELECT id, frozen OR id % 17 = 0 AS frozen, array_to_string(CASE WHEN id % 17 = 0 THEN CASE WHEN list_contains(tags, '404') THEN tags ELSE tags || ['404'] END WHEN NOT frozen THEN list_filter(tags, lambda x: x <> '404') ELSE tags END, ' ') AS tags FROM records")
def removed_works(spark, d):
    gone = F.col("id") % 17 == 0
    holds = F.when(gone, True).when(~F.col("frozen"), False)
    return records(spark, d).select("id", (F.col("frozen") | gone).alias("frozen"), F.array_join(S.with_state_tag(F.col("tags"), "404", holds), " ").alias("tags"))


@query(RECORDS + "SELECT id, array_to_string(CASE WHEN new_arrivals > last_update THEN tags || ['modified'] WHEN id % 4 = 0 THEN list_filter(tags, lambda x: x <> 'modified') ELSE tags END, ' ') AS tags FROM records")
def modified_tags(spark, d):
    holds = F.when(F.col("new_arrivals") > F.col("last_update"), True).when(F.col("id") % 4 == 0, False)
    return records(spark, d).select("id", F.array_join(S.with_state_tag(F.col("tags"), "modified", holds), " ").alias("tags"))


@query("SELECT conv_id AS work, turn AS position, sha256('chapter=' || conv_id || chr(10) || 'element=' || coalesce(text, '') || chr(10) || 'subtitle=' || coalesce(role, '')) AS source FROM conversations")
def source_hashes(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), S.fingerprint({"subtitle": F.col("role"), "chapter": F.col("conv_id"), "element": F.col("text")}).alias("source"))


@query("SELECT l_orderkey AS work, l_linenumber AS chapter, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def position_map(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("chapter")).distinct()
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("work").orderBy("chapter")))


@query("SELECT conv_id AS work, string_agg(DISTINCT turn || ':' || role || ':' || length(text), '|' ORDER BY turn || ':' || role || ':' || length(text)) AS state FROM conversations GROUP BY conv_id")
def finished_chapters(spark, d):
    entry = F.concat_ws(":", F.col("turn").cast("string"), "role", F.length("text").cast("string"))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("work")).agg(F.array_join(F.array_sort(F.collect_set(entry)), "|").alias("state"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def snapshot_names(spark, d):
    e = F.col("event_id")
    name = F.when(e % 3 == 0, F.date_format("ts", "yyyy.MM.dd@HH.mm.ss")).when(e % 3 == 1, F.date_format("ts", "yyyy.MM.dd;HH.mm.ss")).otherwise("notes")
    return table(spark, d, "events").select("event_id", F.date_format(S.snapshot_time(name), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT c.conv_id AS work, c.turn AS position FROM conversations c JOIN (SELECT conv_id, count(*) // 2 AS done FROM conversations GROUP BY conv_id) USING (conv_id) QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) > any_value(done) OVER (PARTITION BY c.conv_id)")
def resumed_chapters(spark, d):
    by = Window.partitionBy("work")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"))
    numbered = rows.withColumn("n", F.row_number().over(by.orderBy("position"))).withColumn("done", F.floor(F.count(F.lit(1)).over(by) / 2))
    return numbered.filter(F.col("n") > F.col("done")).select("work", "position")


@query("SELECT c_custkey AS url, CASE WHEN c_custkey % 17 = 0 THEN 'error' WHEN c_custkey % 5 = 0 THEN 'init' WHEN n > c_custkey % 20 THEN 'updated' ELSE 'same' END AS state, greatest(0, n - CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 20 END) AS fresh FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)")
def watch_states(spark, d):
    k = F.col("url")
    totals = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("url")).agg(F.count("o_orderkey").alias("n"))
    known = F.when(k % 5 != 0, k % 20)
    return totals.select("url", S.update_check(known, F.col("n"), k % 17 == 0).alias("state"), F.greatest(F.lit(0), F.col("n") - F.coalesce(known, F.lit(0))).alias("fresh"))


@query("SELECT o_orderkey AS work, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 07:05:00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 13:04:00') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 13:04:05') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d 09:30:00') END AS at FROM orders")
def parsed_dates(spark, d):
    day = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, F.concat(day("yyyy年MM月dd日"), F.lit("(月) 07時05分"))).when(k == 2, F.concat(day("yyyy/MM/dd"), F.lit(" 13:04"))).when(k == 3, F.concat(day("yyyy-MM-dd"), F.lit("T13:04:05Z"))).when(k == 4, F.concat(day("yyyy-MM-dd"), F.lit(" 09:30"))).otherwise("soon")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.date_format(V.parsed_date(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, strftime(CASE WHEN m < 360 THEN date_trunc('day', ts) + INTERVAL 6 HOUR WHEN m < 1110 THEN date_trunc('day', ts) + INTERVAL 1110 MINUTE ELSE date_trunc('day', ts) + INTERVAL 30 HOUR END, '%Y-%m-%d %H:%M:%S') AS next FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)")
def next_times(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(V.next_time(F.col("ts"), ["1830", "0600", "2575", "noon"]), "yyyy-MM-dd HH:mm:ss").alias("next"))


@query("SELECT o_orderkey AS work, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN NULL END AS boolean, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS integer, CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey + 0.5 END::DOUBLE AS float, CASE WHEN o_orderkey % 4 = 3 THEN 'text ' || o_orderkey END AS text FROM orders")
def typed_values(spark, d):
    k = F.col("o_orderkey")
    name, value = V.setting_line(F.concat(F.lit("key = "), F.when(k % 4 == 0, "true").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("'text "), k.cast("string"), F.lit("'")))))
    return table(spark, d, "orders").filter(name == "key").select(k.alias("work"), *(c.alias(n) for n, c in V.typed(value).items()))


@query("SELECT o_orderkey AS work, o_orderkey::DOUBLE AS key FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, ('0x' || substr(sha256('part ' || o_orderkey), 1, 16))::UBIGINT::DOUBLE FROM orders WHERE o_orderkey % 2 = 1")
def sort_keys(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("part "), k.cast("string")))
    return table(spark, d, "orders").select(k.alias("work"), V.sort_key(text).alias("key"))


@query("SELECT event_id, least(CASE WHEN event_type = 'error' THEN greatest(1000, 10000) ELSE 1000 END * (1 << least(user_id % 9, 5)::INTEGER) + least(event_id % 1000, 749), 60000)::BIGINT AS wait FROM events")
def retry_waits(spark, d):
    return table(spark, d, "events").select("event_id", V.backoff(F.lit(1000), F.col("user_id") % 9 + 1, F.col("event_type") == "error", F.col("event_id") % 1000).alias("wait"))


@query("""WITH l AS (SELECT l_orderkey AS work, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT work, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (f = 'R'), '') AS returned, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (f = 'N'), '') AS kept FROM l GROUP BY work""")
def inverted_maps(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("line")).agg(F.max("l_returnflag").alias("flag"))
    states = lines.groupBy(F.col("l_orderkey").alias("work")).agg(L.inverted(F.map_from_entries(F.collect_list(F.struct("line", "flag")))).alias("m"))
    return states.select("work", *(F.coalesce(F.array_join(F.try_element_at("m", F.lit(flag)), " "), F.lit("")).alias(name) for flag, name in (("R", "returned"), ("N", "kept"))))


@query("SELECT o_orderkey AS work, 'first_line=' || o_orderkey || ' size=' || o_custkey AS convert FROM orders")
def prefixed_settings(spark, d):
    m = V.prefixed(F.create_map(F.lit("convert.first-line"), F.col("o_orderkey").cast("string"), F.lit("web.port"), F.lit("1"), F.lit("convert.size"), F.col("o_custkey").cast("string")), "convert")
    lines = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.array_join(lines, " ").alias("convert"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing, event_type AS second FROM events")
def json_paths(spark, d):
    listed = F.to_json(F.struct(F.array(F.lit("first"), F.col("event_type")).alias("items")))
    return table(spark, d, "events").select("event_id", V.json_at(F.col("props"), "k").alias("k"), V.json_at(F.col("props"), "k.none[3]").alias("missing"), V.json_at(listed, "items[1]").alias("second"))


@query("SELECT o_orderkey AS work, try_cast(replace(o_orderkey::VARCHAR || ',000', ',', '') AS BIGINT) AS number FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 2 = 1")
def comma_integers(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(",000"))).otherwise("none")
    return table(spark, d, "orders").select(k.alias("work"), F.coalesce(T.integer_with_commas(text), F.lit(0)).alias("number"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, CASE WHEN before IS NULL THEN event_type = 'signup'
 WHEN before = 'signup' THEN event_type IN ('view', 'purchase') WHEN before = 'view' THEN event_type IN ('click', 'error', 'purchase') WHEN before = 'error' THEN event_type = 'signup' ELSE false END AS allowed FROM e""")
def task_transitions(spark, d):
    names = {"signup": "queued", "view": "running", "click": "completed", "error": "failed", "purchase": "canceled"}
    state = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("state", state).withColumn("before", F.lag("state").over(w)).select("event_id", tasks.allowed(F.col("before"), F.col("state")).alias("allowed"))


@query("SELECT user_id AS task, floor(epoch(max(ts) FILTER (event_type = 'click')))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds FROM events GROUP BY user_id")
def elapsed_times(spark, d):
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    ends = F.max(F.when(F.col("event_type") == "click", F.col("ts")))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg((seconds(ends) - seconds(F.min("ts"))).alias("seconds"))


@query("SELECT event_id, user_id AS total, event_id % 7 AS done, 0 AS skipped, 1 AS failed, event_type = 'view' AS running, event_type || ':' || user_id AS current FROM events")
def progress_snapshots(spark, d):
    snapshot = F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string"), F.lit("0"), F.lit("1"), F.when(F.col("event_type") == "view", "1").otherwise("0"), F.col("event_type"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", *V.progress_fields(snapshot))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def message_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click', 'error')) WHERE n <= 10")
def last_tasks(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "error"))
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 10).select("event_id", "event_type")


@query("SELECT event_id, lpad(base36, 4, '0') AS name FROM (SELECT event_id, array_to_string(list_transform([46656, 1296, 36, 1], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', (((2091149000 - floor(epoch(ts))::BIGINT) // 600) // p % 36 + 1)::INTEGER, 1)), '') AS base36 FROM events)")
def reversed_times(spark, d):
    return table(spark, d, "events").select("event_id", T.reverse_time(F.col("ts").cast("timestamp")).alias("name"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '.' ELSE event_type END AS status FROM events WHERE event_type <> 'signup'),
 a AS (SELECT *, CASE WHEN status = '.' AND lag(status) OVER w = '.' THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT * FROM (SELECT user_id AS task, run::BIGINT AS run, min(status) AS status, count(*) AS times FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task ORDER BY run DESC) <= 60""")
def console_history(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(F.col("user_id").alias("task"), "ts", "event_id", F.when(kind == "view", ".").otherwise(kind).alias("status"), (kind == "signup").alias("no_history"))
    return tasks.console(rows)
