"""Catalogue queries over all columns: lists, filters, targets, tags, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import catalogue as C
from quire.operators import listing as L
from quire.plans.base import RECORDS, STATUS_SQL, query
from quire.sources.tables import chapters, records, table, with_columns_of

_NOW = "TIMESTAMP '2024-06-01 12:00:00'"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _now():
    return F.to_timestamp_ntz(F.lit("2024-06-01 12:00:00"))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(RECORDS + f"SELECT id, title, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE sitename END, ''), '/works') AS folder, length, {_STAMP.format('last_update')} AS updated FROM records")
def master_scan(spark, d):
    stored = records(spark, d).withColumn("output_dir", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("sitename")))
    rows = stored.select("id", "title", F.coalesce(F.nullif("output_dir", F.lit("")), F.lit("/works")).alias("folder"), F.greatest("length", F.lit(0)).alias("length"), _stamp("last_update").alias("updated"))
    return rows.orderBy(F.desc("updated"), "title", "id")


@query("SELECT doc_id, text, '' AS shard_dir, '' AS output_dir FROM documents")
def old_layout_scan(spark, d):
    old = table(spark, d, "documents").select("doc_id", "text")
    found = with_columns_of(old, {"doc_id": "bigint", "text": "string", "shard_dir": "string", "output_dir": "string"})
    return found.na.fill("", ["shard_dir", "output_dir"])


@query("SELECT conv_id AS work, turn AS position, length(text) AS size FROM conversations WHERE text <> ''")
def chapter_scan(spark, d):
    found = chapters(spark, d).filter(F.col("body") != "")
    return found.orderBy("work", "position").select("work", "position", F.length("body").cast("bigint").alias("size"))


@query("SELECT conv_id AS work, string_agg(turn || '=' || (role = 'user')::VARCHAR, ',' ORDER BY turn) AS states FROM conversations GROUP BY conv_id")
def download_states(spark, d):
    pairs = chapters(spark, d).groupBy("work").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("position", (F.col("subtitle") == "user").alias("value"))))).alias("m"))
    entry = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    return pairs.select("work", F.array_join(entry, ",").alias("states"))


@query(RECORDS + "SELECT id, title, author FROM records WHERE id IN (SELECT o_orderkey FROM orders)")
def metadata_lookup(spark, d):
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return records(spark, d).select("id", "title", "author").join(probes, "id", "left_semi")


@query(RECORDS + f"""SELECT id, title, author, sitename, CASE WHEN novel_type = 2 THEN '短編' ELSE '連載' END AS kind, {STATUS_SQL} AS status, regexp_extract(toc_url, '^https?://[^/]+', 0) || '/' AS site,
 epoch(last_update)::BIGINT AS updated, coalesce(epoch(new_arrivals)::BIGINT, 0) AS arrived, array_to_string(tags, ' ') AS tags, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM records""")
def catalogue_projection(spark, d):
    escaped = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    seconds = lambda c: F.unix_timestamp(F.to_timestamp_ltz(F.col(c).cast("string")))
    return records(spark, d).select("id", "title", "author", "sitename", L.type_label().alias("kind"), L.full_status().alias("status"), F.concat(F.regexp_extract("toc_url", "^https?://[^/]+", 0), F.lit("/")).alias("site"), seconds("last_update").alias("updated"), F.coalesce(seconds("new_arrivals"), F.lit(0)).alias("arrived"), F.array_join("tags", " ").alias("tags"), escaped.alias("escaped"))


@query(RECORDS + f"SELECT id, {STATUS_SQL} AS status FROM records")
def status_labels(spark, d):
    return records(spark, d).select("id", L.full_status().alias("status"))


@query(RECORDS + "SELECT id, frozen FROM records WHERE frozen")
def visible_frozen(spark, d):
    return records(spark, d).filter(L.visible(True, False)).select("id", "frozen")


@query(RECORDS + f"SELECT id FROM (SELECT *, {STATUS_SQL} AS status, CASE WHEN novel_type = 2 THEN '短編' ELSE '連載' END AS kind FROM records) WHERE contains(lower(title), 'r1') OR contains(lower(author), 'r1') OR contains(lower(sitename), 'r1') OR contains(status, 'r1') OR contains(kind, 'r1') OR len(list_filter(tags, lambda x: contains(lower(x), 'r1'))) > 0")
def text_term(spark, d):
    rows = records(spark, d).withColumn("status", L.full_status()).withColumn("kind", L.type_label())
    return rows.filter(C.compile_filter("R1", ("title", "author", "sitename", "status", "kind"))).select("id")


@query(RECORDS + "SELECT id FROM records WHERE novel_type IN (0, 1) AND NOT frozen")
def kind_filter(spark, d):
    return records(spark, d).filter(L.of_kinds(["series", "nonfrozen"])).select("id")


_LINE = f"""concat_ws(' | ', lpad(n, greatest(4, length(n))::INTEGER, ' '), strftime(CASE WHEN class = 'new' THEN new_arrivals ELSE last_update END, '%y/%m/%d'),
 concat_ws(' ', title, CASE WHEN novel_type = 2 THEN '(短編)' END, CASE WHEN list_contains(tags, 'end') THEN '(完結)' END, CASE WHEN list_contains(tags, '404') THEN '(削除)' END))"""
_LINES = RECORDS + f", r AS (SELECT *, CASE WHEN frozen THEN '*' ELSE '' END || id AS n, CASE WHEN new_arrivals >= last_update AND new_arrivals + INTERVAL 6 HOUR >= {_NOW} THEN 'new' WHEN last_update + INTERVAL 6 HOUR >= {_NOW} THEN 'updated' ELSE 'plain' END AS class FROM records) "


@query(_LINES + f"SELECT id, {_LINE} AS line FROM r")
def decorated_lines(spark, d):
    return records(spark, d).select("id", L.line(_now()).alias("line"))


@query(_LINES + "SELECT id, class FROM r")
def date_classes(spark, d):
    return records(spark, d).select("id", L.recent(_now()).alias("class"))


@query(_LINES + f"SELECT id, {_LINE} AS line FROM r WHERE contains({_LINE}, '24/0') AND NOT contains({_LINE}, '*')")
def grep_lines(spark, d):
    rows = records(spark, d).withColumn("line", L.line(_now()))
    return rows.filter(L.grep(F.col("line"), "24/0 -*")).select("id", "line")


_ARGUMENTS = [(0, "3"), (1, "tag:404"), (2, "^tag:short"), (3, "short"), (4, "unknown"), (5, "99999999"), (6, "tag:nothing"), (7, "3")]


@query(RECORDS + """, a(position, argument) AS (VALUES """ + ", ".join(f"({p}, '{x}')" for p, x in _ARGUMENTS) + """), n AS (SELECT position, argument, regexp_replace(argument, '^\\^?tag:', '') AS name, argument LIKE '^tag:%' AS without, argument IN (SELECT id::VARCHAR FROM records) AS own FROM a),
 w AS (SELECT position, id::VARCHAR AS value FROM n JOIN records ON NOT own AND ((NOT without AND list_contains(tags, name)) OR (without AND NOT list_contains(tags, name) AND name IN (SELECT unnest(tags) FROM records)))
 UNION ALL SELECT position, CASE WHEN own THEN argument ELSE name END FROM n WHERE own OR name NOT IN (SELECT unnest(tags) FROM records))
 SELECT value, min(position) AS position FROM w GROUP BY value""")
def tag_expansion(spark, d):
    return L.expanded(spark.createDataFrame(_ARGUMENTS, "position int, argument string"), records(spark, d))


@query(RECORDS + """, a(alias, target) AS (VALUES ('one', 3), ('hotentry', 4), ('two words', 5), ('gone', 99999999), ('drop', NULL), ('two', 6)) SELECT alias, target FROM a
 WHERE regexp_full_match(alias, '[A-Za-z0-9_]+') AND alias <> 'hotentry' AND target IN (SELECT id FROM records)""")
def alias_definitions(spark, d):
    given = spark.createDataFrame([("one", 3), ("hotentry", 4), ("two words", 5), ("gone", 99999999), ("drop", None), ("two", 6)], "alias string, target bigint")
    named = given.filter(F.col("alias").rlike(r"^\w+$") & ~F.col("alias").isin(*L.BANNED_WORDS))
    return named.join(records(spark, d).select("id"), F.col("target") == F.col("id"), "left_semi")


@query(RECORDS + "SELECT o_orderkey AS id, CASE WHEN r.frozen THEN 'frozen' WHEN r.id IS NOT NULL THEN 'stored' ELSE 'download' END AS verdict FROM orders LEFT JOIN records r ON o_orderkey = r.id")
def download_admission(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    known = records(spark, d).select("id", "frozen")
    return asked.join(known, "id", "left").select("id", F.when(F.col("frozen"), "frozen").when(F.col("frozen").isNotNull(), "stored").otherwise("download").alias("verdict"))


@query(RECORDS + "SELECT id FROM records WHERE novel_type = 2 AND NOT frozen AND NOT suspended")
def removal_admission(spark, d):
    return records(spark, d).filter(L.of_kinds(["ss", "nonfrozen"]) & ~F.col("suspended")).select("id")


_TARGETS = [("Mine",), ("https://www.src0.example/n15ab/",), ("n17ab",), ("N18AB",), ("19",), ("nothing",)]


@query(RECORDS + """, t(target) AS (VALUES ('Mine'), ('https://www.src0.example/n15ab/'), ('n17ab'), ('N18AB'), ('19'), ('nothing')) SELECT target, coalesce(CASE WHEN target = 'Mine' THEN 5 END,
 (SELECT min(id) FROM records WHERE rtrim(toc_url, '/') = rtrim(lower(target), '/')), CASE WHEN regexp_full_match(lower(target), 'n[0-9]+[a-z]+') THEN (SELECT min(id) FROM records WHERE toc_url LIKE '%/' || lower(target) || '/') END,
 (SELECT min(id) FROM records WHERE id::VARCHAR = target), (SELECT min(id) FROM records WHERE title = target)) AS id FROM t""")
def target_lookup(spark, d):
    targets = spark.createDataFrame(_TARGETS, "target string")
    aliases = spark.createDataFrame([("Mine", 5)], "alias string, id bigint")
    return C.looked_up(targets, records(spark, d), aliases)


@query("SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS given FROM pages WHERE regexp_full_match(regexp_extract(url, '([^/]+)$', 1), '[0-9]+')")
def valid_ids(spark, d):
    given = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("given"))
    return given.filter(F.col("given").rlike(r"^\d+$"))


@query("SELECT page_id, regexp_matches(html, '(?i)not found|404') AS missing FROM pages")
def error_pages(spark, d):
    return table(spark, d, "pages").select("page_id", C.matches(F.col("html"), "(?i)not found|404").alias("missing"))


@query("SELECT page_id, contains(lower(left(html, 4096)), 'captcha') OR contains(lower(left(html, 4096)), 'just a moment') OR contains(lower(left(html, 4096)), '<script') AS challenge FROM pages")
def challenge_pages(spark, d):
    return table(spark, d, "pages").select("page_id", C.contains_any(F.substring("html", 1, 4096), ["captcha", "just a moment", "<script"]).alias("challenge"))


@query("SELECT c.conv_id AS work, c.turn AS position, CASE WHEN c.turn % 3 = 0 THEN true WHEN c.turn % 3 = 1 THEN c.role <> 'user' ELSE false END AS refresh FROM conversations c")
def refresh_needed(spark, d):
    from quire.operators.changes import needs_refresh

    rows = chapters(spark, d)
    stored = F.when(F.col("position") % 3 == 1, "user").otherwise("")
    return rows.select("work", "position", needs_refresh(F.col("subtitle"), stored, F.col("position") % 3 != 0).alias("refresh"))


@query(RECORDS + "SELECT id FROM records WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND toc_url NOT IN (SELECT 'https://www.src1.example/n' || o_orderkey || 'ab/' FROM orders)")
def hidden_works(spark, d):
    keys = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    urls = table(spark, d, "orders").select(F.concat(F.lit("https://www.src1.example/n"), F.col("o_orderkey").cast("string"), F.lit("ab/")).alias("toc_url"))
    return records(spark, d).join(keys, "id", "left_anti").join(urls, "toc_url", "left_anti").select("id")


@query(RECORDS + "SELECT id FROM records WHERE contains(lower(title), 'er') OR contains(lower(author), 'er')")
def library_filter(spark, d):
    return records(spark, d).filter(C.library_filter("ER")).select("id")


@query("SELECT page_id, (h = 'example.org' OR ends_with(h, '.example.org') OR h = 'site1.example' OR ends_with(h, '.site1.example')) AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS h FROM pages)")
def host_allow_list(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", L.host_allowed(host, ["example.org", "site1.example"]).alias("allowed"))


@query(RECORDS + "SELECT id, author FROM records WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def selection_in_order(spark, d):
    chosen = table(spark, d, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id"))
    return records(spark, d).join(chosen, "id", "left_semi").orderBy(F.desc("last_update"), "id").select("id", "author")


_API = "(SELECT o_orderkey AS id, o_orderdate AS lastup, o_orderpriority AS state FROM orders)"


@query(RECORDS + f"SELECT r.id, a.state, a.id IS NULL AS slow FROM records r LEFT JOIN {_API} a ON r.id = a.id")
def api_matches(spark, d):
    api = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("state"))
    stored = records(spark, d).select("id")
    fast = stored.join(api, "id").withColumn("slow", F.lit(False))
    rest = stored.join(api, "id", "left_anti").select("id", F.lit(None).cast("string").alias("state"), F.lit(True).alias("slow"))
    return fast.unionByName(rest)


@query("SELECT o_orderkey // 300 AS batch, count(*) AS ids, min(o_orderkey) AS first FROM orders GROUP BY 1")
def api_batches(spark, d):
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 300).alias("batch")).agg(F.count(F.lit(1)).alias("ids"), F.min("o_orderkey").alias("first"))


@query(RECORDS + "SELECT sitename AS api, count(*) AS works, string_agg('n' || id || 'ab', ' ' ORDER BY id) AS codes FROM records WHERE NOT frozen AND sitename <> 'src0' GROUP BY sitename")
def api_targets(spark, d):
    rows = records(spark, d).filter(~F.col("frozen") & (F.col("sitename") != "src0"))
    codes = F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit("ab")))
    return rows.groupBy(F.col("sitename").alias("api")).agg(F.count(F.lit(1)).alias("works"), F.array_join(codes, " ").alias("codes"))


_SETTINGS = RECORDS + ", s AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'forced' END AS forced, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN id::VARCHAR ELSE 'text' END END AS own, CASE WHEN id % 5 = 0 THEN 'default' END AS fallback FROM records) "


@query(_SETTINGS + "SELECT id, coalesce(forced, CASE WHEN regexp_full_match(own, '[0-9]+') THEN own END, fallback, 'built-in') AS value FROM s")
def settings_precedence(spark, d):
    i = F.col("id")
    s = records(spark, d).select("id", F.when(i % 11 == 0, "forced").alias("forced"), F.when(i % 3 == 0, F.when(i % 2 == 0, i.cast("string")).otherwise("text")).alias("own"), F.when(i % 5 == 0, "default").alias("fallback"))
    return s.select("id", C.setting(F.col("forced"), F.col("own"), F.col("own").rlike(r"^\d+$"), F.col("fallback"), F.lit("built-in")).alias("value"))


_TAGS = RECORDS + ", t AS (SELECT tag, min(id) AS first, count(*) AS works FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM records) GROUP BY tag), c AS (SELECT tag, works, ['green','yellow','blue','magenta','cyan','red','white'][(row_number() OVER (ORDER BY first, tag) - 1) % 7 + 1] AS colour FROM t) "


@query(_TAGS + "SELECT tag, works, colour FROM c")
def coloured_tags(spark, d):
    tags = C.tag_rows(records(spark, d)).groupBy("tag").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("works"))
    return tags.select("tag", "works").join(L.with_colours(tags), "tag").orderBy("tag")


@query(_TAGS + "SELECT tag, colour FROM c")
def colour_assignment(spark, d):
    return L.with_colours(C.tag_rows(records(spark, d)).groupBy("tag").agg(F.min("id").alias("first")))


@query(RECORDS + "SELECT id, coalesce(episodes, n, 0) AS episodes FROM records LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ON id = conv_id")
def episode_fill(spark, d):
    n = chapters(spark, d).groupBy(F.col("work").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return records(spark, d).select("id", "episodes").join(n, "id", "left").select("id", F.coalesce("episodes", "n", F.lit(0)).alias("episodes"))


@query("SELECT conv_id AS work, count(*) FILTER (turn % 3 = 0) AS missing FROM conversations GROUP BY conv_id")
def missing_bodies(spark, d):
    return chapters(spark, d).groupBy("work").agg(F.count_if(F.col("position") % 3 == 0).alias("missing"))


@query("SELECT count(*) FILTER (event_type = 'signup') AS saved, count(*) FILTER (event_type = 'click') AS updated, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events")
def download_summary(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").agg(*(F.count_if(kind == k).alias(n) for k, n in (("signup", "saved"), ("click", "updated"), ("view", "skipped"), ("error", "failed"))))


@query(RECORDS + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, role FROM conversations)) SELECT conv_id AS work, string_agg(turn || ' ' || role, '; ' ORDER BY turn) AS arrivals FROM r GROUP BY conv_id")
def new_arrivals(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", "subtitle"))), lambda x: F.concat_ws(" ", x["position"].cast("string"), x["subtitle"]))
    return chapters(spark, d).groupBy("work").agg(F.array_join(rows, "; ").alias("arrivals"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\s\\v]', '', 'g')) AS characters FROM documents")
def character_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[\t\n\u000b\f\r ]", "")).cast("bigint").alias("characters"))


@query("SELECT event_type AS selector, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS uses FROM events GROUP BY event_type")
def selector_history(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("selector")).agg(_stamp(F.min("ts")).alias("first"), _stamp(F.max("ts")).alias("last"), F.count(F.lit(1)).alias("uses"))


@query("SELECT user_id AS site, event_id, event_type AS selector FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def selector_changes(spark, d):
    w = Window.partitionBy("site").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("site"), "ts", "event_id", F.col("event_type").alias("selector"))
    return rows.withColumn("before", F.lag("selector").over(w)).filter(F.col("before") != F.col("selector")).select("site", "event_id", "selector")


@query("SELECT note, count(*) AS times FROM (SELECT unnest(regexp_extract_all(replace(text, '. ', '※［＃' || lang || '］'), '※［＃[^］]*］')) AS note FROM documents) GROUP BY note")
def unresolved_notes(spark, d):
    marked = F.replace("text", F.lit(". "), F.concat(F.lit("※［＃"), F.col("lang"), F.lit("］")))
    notes = F.explode(F.regexp_extract_all(marked, F.lit("※［＃[^］]*］"), F.lit(0)))
    return table(spark, d, "documents").select(notes.alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("times"))


@query(RECORDS + f"SELECT id FROM (SELECT *, {STATUS_SQL} AS status FROM records) ORDER BY status DESC, id LIMIT 50")
def sorted_page(spark, d):
    return C.page(records(spark, d).withColumn("status", L.full_status()), "status", 0, 50).select("id")


@query(RECORDS + "SELECT id, episodes FROM records ORDER BY coalesce(episodes, 0), id LIMIT 40 OFFSET 10")
def sorted_nulls(spark, d):
    return C.page(records(spark, d), "episodes", 10, 40, descending=False).select("id", "episodes")


@query(RECORDS + "SELECT id, row_number() OVER (ORDER BY length DESC, id) AS position FROM records WHERE id IN (SELECT o_orderkey FROM orders)")
def ids_by_state(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return C.sorted_ids(asked, records(spark, d), [F.desc("length")])


@query(RECORDS + "SELECT id, title FROM records ORDER BY title DESC, id DESC LIMIT 30")
def key_sort(spark, d):
    return records(spark, d).select("id", "title").orderBy(F.desc("title"), F.desc("id")).limit(30)


@query(RECORDS + "SELECT o_orderkey AS id, row_number() OVER (ORDER BY r.id IS NULL, coalesce(r.new_arrivals, TIMESTAMP '0001-01-01 00:00:00') DESC, o_orderkey) AS place FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN records r ON r.id = o_orderkey")
def update_targets(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    return C.update_places(asked, records(spark, d), "new_arrivals")


@query(RECORDS + "SELECT id, episodes FROM records ORDER BY episodes DESC NULLS LAST, id LIMIT 25")
def library_order(spark, d):
    return C.library_order(records(spark, d), "episodes").limit(25).select("id", "episodes")


@query(_LINES + f"SELECT id, {_LINE} AS line FROM r WHERE NOT frozen ORDER BY last_update DESC, id LIMIT 10")
def list_limit(spark, d):
    return records(spark, d).filter(L.of_kinds(["nonfrozen"])).orderBy(F.desc("last_update"), "id").limit(10).select("id", L.line(_now()).alias("line"))


@query(RECORDS + "SELECT sitename, id FROM (SELECT sitename, id, row_number() OVER (PARTITION BY sitename ORDER BY length DESC, id) AS n FROM records) WHERE n <= 5 ORDER BY sitename, n LIMIT 100")
def search_limits(spark, d):
    rows = records(spark, d)
    n = F.row_number().over(Window.partitionBy("sitename").orderBy(F.desc("length"), "id"))
    return rows.withColumn("n", n).filter(F.col("n") <= L.search_share(100, 20)).orderBy("sitename", "n").limit(100).select("sitename", "id")


@query("SELECT conv_id AS work, turn AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE CASE WHEN 3 < c THEN n > 3 ELSE n = c END")
def cut_old_chapters(spark, d):
    return C.without_first(chapters(spark, d), 3).select("work", "position")


@query("SELECT c_custkey AS author, o_orderpriority AS tag FROM (SELECT c_custkey, o_orderpriority, row_number() OVER (PARTITION BY c_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n = 1")
def first_seen_tags(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_custkey").alias("author"), F.col("o_orderpriority").alias("tag")).agg(F.min("o_orderkey").alias("first")).select("author", "tag")


@query("SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '^#+ *([^\\n]*)', 1)), ''), nullif(trim(regexp_extract(text, '\"([^\"\\n]*)\"', 1)), ''), nullif(trim(split_part(text, chr(10), 1)), ''), 'untitled') AS title FROM documents")
def first_success(spark, d):
    found = [F.regexp_extract("text", r"^#+ *([^\n]*)", 1), F.regexp_extract("text", '"([^"\\n]*)"', 1), F.substring_index("text", "\n", 1)]
    return table(spark, d, "documents").select("doc_id", C.first_not_blank(*found, F.lit("untitled")).alias("title"))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_tasks(spark, d):
    e = table(spark, d, "events")
    live, history = e.filter("event_type = 'signup'"), e.filter("event_type = 'error'")
    return live.unionByName(history).orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id")


@query("SELECT o_orderdate AS snapshot, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS chapters FROM orders GROUP BY o_orderdate")
def diff_listing(spark, d):
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("snapshot")).agg(F.array_join(keys, " ").alias("chapters")).orderBy(F.desc("snapshot"))


@query("SELECT conv_id AS work, turn AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 2 AND n <= 7 AND turn % 3 = 0")
def missing_window(spark, d):
    rows = chapters(spark, d).withColumn("stored", F.col("position") % 3 != 0)
    return C.missing_ahead(rows, 2, 5).select("work", "position")


@query(RECORDS + "SELECT id, array_to_string(list_filter(tags, lambda x: NOT regexp_matches(x, '^src') AND x <> 'hotentry'), ' ') || CASE WHEN list_contains(tags, 'new') THEN '' ELSE ' new' END AS tags FROM records")
def allowed_tags(spark, d):
    asked = F.filter(F.array(F.lit("new"), F.lit("bad/tag"), F.lit("hotentry")), L.allowed_tag)
    kept = F.filter("tags", lambda t: ~t.startswith("src"))
    return records(spark, d).select("id", F.array_join(F.array_union(kept, asked), " ").alias("tags"))


@query(RECORDS + "SELECT id, array_to_string(list_filter(tags, lambda x: x <> 'short') || ['kept'], ' ') AS tags FROM records")
def tags_by_state(spark, d):
    groups = L.inverted(F.create_map(F.lit("short"), F.lit(0), F.lit("en"), F.lit(1), F.lit("kept"), F.lit(2)))
    none = F.array().cast("array<string>")
    return records(spark, d).select("id", F.array_join(C.edited_tags(F.col("tags"), F.coalesce(groups[2], none), F.coalesce(groups[0], none)), " ").alias("tags"))


@query("SELECT doc_id, array_to_string(list_distinct_in_order, ' ') AS tags FROM (SELECT doc_id, list_filter(list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_split_to_array(split_part(text, chr(10), 1), ' +'), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END), lambda x: x <> '') AS list_distinct_in_order FROM documents)")
def automatic_tags(spark, d):
    words = F.filter(F.split(F.substring_index("text", "\n", 1), " +"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(words), " ").alias("tags"))


@query(RECORDS + "SELECT id, len(list_filter(['end', lang], lambda x: NOT list_contains(tags, x))) > 0 AS fresh FROM records")
def new_tags_present(spark, d):
    return records(spark, d).select("id", (F.size(F.array_except(F.array(F.lit("end"), F.col("lang")), "tags")) > 0).alias("fresh"))


@query(RECORDS + "SELECT lang AS key, string_agg(DISTINCT sitename, ' ' ORDER BY sitename) AS domains FROM records GROUP BY lang")
def domain_sets(spark, d):
    return records(spark, d).groupBy(F.col("lang").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("sitename")), " ").alias("domains"))


@query("SELECT doc_id AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def coverage_gaps(spark, d):
    def gaps(asked, key, known, own):
        return table(spark, d, asked).select(F.col(key).alias("missing")).distinct().join(table(spark, d, known).select(F.col(own).alias("missing")), "missing", "left_anti")

    return gaps("documents", "doc_id", "labels", "doc_id").union(gaps("lineitem", "l_orderkey", "orders", "o_orderkey")).distinct()


@query(RECORDS + "SELECT id, array_to_string(list_filter(tags, lambda x: x NOT IN ('end', '404', 'short')), ' ') AS subjects FROM records")
def subject_tags(spark, d):
    return records(spark, d).select("id", F.array_join(F.array_except("tags", F.array(*map(F.lit, ("end", "404", "short")))), " ").alias("subjects"))


@query(RECORDS + ", u AS (SELECT id, toc_url AS key, title, last_update, true AS master FROM records WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, toc_url, title || '*', last_update, false FROM records WHERE id % 2 = 0) SELECT id, title FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY master DESC, last_update DESC, title, id) = 1")
def merged_catalogues(spark, d):
    r = records(spark, d).select("id", "toc_url", "title", "last_update")
    nested = r.filter("id % 2 = 0").select((F.col("id") + 1000000).alias("id"), "toc_url", F.concat("title", F.lit("*")).alias("title"), "last_update")
    return C.merged_catalogues(r.filter("id % 3 = 0"), nested).select("id", "title")


@query(RECORDS + ", p AS (SELECT o_orderkey AS id FROM orders) SELECT p.id, r.title, r.id IS NOT NULL AS found FROM p LEFT JOIN records r ON r.id = p.id")
def thousand_lookups(spark, d):
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    stored = records(spark, d).select("id", "title", F.lit(True).alias("found"))
    return probes.join(stored, "id", "left").select("id", "title", F.coalesce("found", F.lit(False)).alias("found"))
