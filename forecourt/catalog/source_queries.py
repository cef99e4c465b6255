"""Sources and sinks (S) and union by id (U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.catalog import query
from forecourt.catalog.rule_queries import ENRICHED_SQL, ISSUES, rounded_scores
from forecourt.catalog.tables import TF, documents, read, station_sheet, text_fact
from forecourt.functions import rules
from forecourt.plans import snapshot
from forecourt.plans.enrich import append_new, enrich, export_tags, refresh
from forecourt.session import work_dir
from forecourt.sources import pages, reviews, tabular

ALL_COLUMNS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]
KEY = ["l_orderkey", "l_linenumber"]


def as_reviews(spark, d):
    """Documents under the review schema; the fields they lack are NULL."""
    docs = read(spark, d, "documents")
    given = {"review_id": F.col("doc_id").cast("string"), "station_name": F.col("source"),
             "text": F.col("text"), "zone": F.col("lang"),
             "rating": F.col("n_chars").cast("double")}
    return docs.select([
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in reviews.REVIEW_SCHEMA.fields])


@query("s01_review_json", """
SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS station_name, lang AS zone,
  CAST(n_chars AS DOUBLE) AS rating, md5(text) AS text_md5 FROM documents""")
def s01(spark, d):
    """Documents as JSON lines, then scanned."""
    path = work_dir(spark, "s01")
    as_reviews(spark, d).write.json(path)
    return _digest(reviews.read_review_json(spark, path, layout="line"))


def _digest(df):
    return df.select("review_id", "station_name", "zone", "rating", F.md5("text").alias("text_md5"))


@query("s02_csv_scan", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def s02(spark, d):
    path = work_dir(spark, "s02")
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    tabular.write_csv(docs, path)
    back = tabular.read_csv(spark, path, docs.schema, multi_line=True)  # texts hold line breaks
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("s03_landed_sheet", "SELECT s_suppkey, s_name, s_acctbal, origin FROM supplier, "
       "(SELECT unnest(['csv', 'parquet']) AS origin)")
def s03(spark, d):
    sheet = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    csv, parquet = work_dir(spark, "s03-csv"), work_dir(spark, "s03") + ".parquet"
    tabular.write_csv(sheet, csv)
    sheet.write.parquet(parquet)
    a = tabular.land_sheet(spark, csv, sheet.schema).withColumn("origin", F.lit("csv"))
    return a.unionByName(tabular.land_sheet(spark, parquet).withColumn("origin", F.lit("parquet")))


@query("s04_csv_sink", """
SELECT key, md5(v) AS row_md5 FROM (SELECT l_orderkey * 8 + l_linenumber AS key,
  l_returnflag || '|' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '|' || l_linestatus AS v
  FROM lineitem)""")
def s04(spark, d):
    path = work_dir(spark, "s04")
    li = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), "l_returnflag",
        F.col("l_quantity").cast("int").alias("quantity"), "l_linestatus")
    tabular.write_csv(li, path)
    back = tabular.read_csv(spark, path, li.schema)
    return back.select("key", F.md5(F.concat_ws("|", "l_returnflag", "quantity", "l_linestatus"))
                       .alias("row_md5"))


@query("s05_station_json", """
SELECT doc_id, source AS station_key, md5(text) AS text_md5 FROM documents""")
def s05(spark, d):
    path = work_dir(spark, "s05")
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("station_key"))
    reviews.write_station_json(docs, path)
    back = reviews.read_station_json(spark, path, docs.schema)
    return back.select("doc_id", "station_key", F.md5("text").alias("text_md5"))


@query("s06_pending_stations", """
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (
  SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'A' AND l_tax = 0)""")
def s06(spark, d):
    done = read(spark, d, "lineitem").where(
        "l_quantity = 50 AND l_returnflag = 'A' AND l_tax = 0").select(
        F.col("l_suppkey").alias("s_suppkey"))
    stations = read(spark, d, "supplier").select("s_suppkey", "s_name")
    return reviews.pending(stations, done, "s_suppkey")


@query("s07_refresh", TF + """
SELECT doc_id, zone, origin FROM (
  SELECT doc_id, zone, CASE WHEN sentiment = 'Unknown' THEN 'new' ELSE 'kept' END AS origin FROM tf)""")
def s07(spark, d):
    raw = text_fact(spark, d).drop("sentiment")
    labels = read(spark, d, "labels").select("doc_id")
    before = work_dir(spark, "s07")
    enrich(raw.join(labels, "doc_id", "left_semi")).withColumn("origin", F.lit("kept")).write.parquet(before)
    table = spark.read.parquet(before)
    fresh = raw.withColumn("origin", F.lit("new"))
    return refresh(fresh, table, "doc_id").select("doc_id", "zone", "origin")


@query("s07_append", """
SELECT doc_id, source AS zone FROM documents""")
def s07c(spark, d):
    """New rows, each of them twice, appended to a table partitioned by zone."""
    raw = read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("zone"))
    labels = read(spark, d, "labels").select("doc_id")
    path = work_dir(spark, "s07-append")
    enrich(raw.join(labels, "doc_id", "left_semi")).write.partitionBy("zone").parquet(path)
    append_new(spark, raw.unionByName(raw), path, "doc_id")
    return spark.read.parquet(path).select("doc_id", F.col("zone").cast("string").alias("zone"))


@query("s07_fresh_files", """
SELECT doc_id, md5(text) AS text_md5, 1 AS version FROM documents WHERE doc_id % 4 IN (0, 3)
UNION ALL SELECT doc_id, md5(text || '!'), 2 FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, md5(text), 3 FROM documents WHERE doc_id % 8 = 2""")
def s07_fresh(spark, d):
    """A table derived from files of which some change, some lose their rows and some are new."""
    source, table = work_dir(spark, "s07-source"), work_dir(spark, "s07-table")
    docs = read(spark, d, "documents").select("doc_id", "text")

    def put(part, rows):
        rows.write.mode("overwrite").parquet(f"{source}/part-{part}")

    def derive(rows):
        return rows.select("doc_id", F.md5("text").alias("text_md5"), snapshot.SOURCE)
    for part in range(4):
        put(part, docs.where(F.col("doc_id") % 4 == part))
    snapshot.refresh(spark, source, table, derive)
    put(1, docs.where(F.col("doc_id") % 4 == 1).withColumn("text", F.concat("text", F.lit("!"))))
    put(2, docs.limit(0))
    snapshot.refresh(spark, source, table, derive)
    put(4, docs.where(F.col("doc_id") % 8 == 2))
    snapshot.refresh(spark, source, table, derive)
    snapshot.refresh(spark, source, table, derive)  # nothing has changed
    return snapshot.read_table(spark, table).drop(snapshot.SOURCE)


@query("s07_enriched", ENRICHED_SQL)
def s07b(spark, d):
    out = export_tags(enrich(documents(spark, d), lexicon=lx.Lexicon(issues=ISSUES)))
    return rounded_scores(out.drop("text"))


@query("s08_dedupe", f"""
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ALL_COLUMNS)}) AS rn FROM lineitem)
WHERE rn = 1""")
def s08(spark, d):
    return reviews.keep_first(read(spark, d, "lineitem"), KEY, [F.col(c) for c in ALL_COLUMNS])


_MERGE = f"""
WITH a AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'),
extra AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY {', '.join(ALL_COLUMNS)}) AS rn FROM b
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = b.l_orderkey
    AND a.l_linenumber = b.l_linenumber))
"""


def _merged(spark, d):
    li = read(spark, d, "lineitem")
    return reviews.merge_passes(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"), KEY,
                                [F.col(c) for c in ALL_COLUMNS])


@query("s09_merge_passes", _MERGE + """
SELECT * FROM a UNION ALL SELECT * EXCLUDE rn FROM extra WHERE rn = 1""")
def s09(spark, d):
    return _merged(spark, d)


@query("u02_union_by_id", _MERGE + f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY {', '.join(ALL_COLUMNS)}) AS k FROM (
    SELECT * FROM a UNION ALL SELECT * EXCLUDE rn FROM extra WHERE rn = 1)) WHERE k = 1""")
def u02(spark, d):
    once = reviews.keep_first(_merged(spark, d), KEY, [F.col(c) for c in ALL_COLUMNS])
    return once.select(*KEY, "l_partkey")


@query("s10_take_stations", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 25")
def s10(spark, d):
    stations = read(spark, d, "supplier").select("s_suppkey", "s_name")
    return reviews.take_stations(stations, 25, [F.col("s_suppkey")])


@query("s11_record_id", """
SELECT l_orderkey, l_linenumber, l_partkey, md5(s_name || '|' || CAST(s_acctbal AS VARCHAR) || '|' ||
  CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) || '|' || l_returnflag || '|' ||
  CASE WHEN l_tax = 0 THEN 'None' ELSE l_linestatus END) AS review_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def s11(spark, d):
    df = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey"))
    text = F.when(F.col("l_tax") != 0, F.col("l_linestatus"))
    rid = rules.record_id(F.col("s_name"), F.col("s_acctbal"), F.col("l_quantity"),
                          F.col("l_returnflag"), text)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", rid.alias("review_id"))


@query("s12_station_key", """
SELECT p_partkey, (CASE WHEN p_partkey < 1000 THEN printf('%03d', p_partkey)
  ELSE CAST(p_partkey AS VARCHAR) END) || '_' || substr(regexp_replace(
  lower(p_name || ' (' || p_brand || '), ' || p_type || ' petrol pump & service station'),
  '[^a-z0-9]', '_', 'g'), 1, 40) AS station_key FROM part""")
def s12(spark, d):
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("), "), "p_type",
                     F.lit(" petrol pump & service station"))
    return read(spark, d, "part").select(
        "p_partkey", rules.station_key(title, F.col("p_partkey")).alias("station_key"))


@query("s13_dispatch", """
SELECT 'reviews' AS route, count(*) AS n FROM documents UNION ALL
SELECT 'stations', count(*) FROM supplier""")
def s13(spark, d):
    def count_as(route):
        return lambda df: df.agg(F.count("*").alias("n")).select(F.lit(route).alias("route"), "n")
    out = [tabular.dispatch(df, count_as("stations"), count_as("reviews"))
           for df in (read(spark, d, "documents"), station_sheet(spark, d))]
    return out[0].unionByName(out[1])


# A paragraph is a block; its text is what is in it, and its author what is in its bold part.
PARAGRAPHS = pages.PageRules(
    blocks=(pages.Select("div", attribute="data-review-id"), pages.Select("p")),
    author=(pages.Select("span", cls="byline"), pages.Select("b")),
    stars=(pages.Select(attribute="aria-label"),),
    text=(pages.Select("p", itself=True),),
    date=(pages.Select("time"),),
)


def _inner_sql(e):
    e = f"regexp_replace(regexp_replace(replace({e}, '<br>', chr(10)), '(?s)<[^>]*>', '', 'g'), '(?s)<[a-zA-Z/][^>]*$', '')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                 ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"trim(regexp_replace({e}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'))"


@query("s14_page_records", f"""
SELECT page_id, pos, author_name, text, date_relative, rating FROM (
  SELECT page_id, i - 1 AS pos, CASE WHEN contains(p, '<b>') THEN {_inner_sql("regexp_extract(p, '(?s)<b>(.*)', 1)")} ELSE '' END AS author_name,
    {_inner_sql("p")} AS text, '' AS date_relative, CAST(NULL AS DOUBLE) AS rating
  FROM (SELECT page_id, i, regexp_extract(bs[i + 1], '(?s)^(.*?)(</p>|</article>|\\z)', 1) AS p FROM (
    SELECT page_id, bs, unnest(range(1, len(bs))) AS i FROM (
      SELECT page_id, string_split(regexp_replace(html,
        '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'), '<p>') AS bs FROM pages))))
WHERE author_name <> '' OR text <> ''""")
def s14(spark, d):
    return pages.extract_records(read(spark, d, "pages"), "html", ["page_id"], PARAGRAPHS)


def _marked_up(spark, d):
    """Each turn of a conversation as a saved review page: two blocks, the second in fallback markup."""
    t = read(spark, d, "conversations").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ").alias("text"))
    stars = F.concat((F.pmod("turn", F.lit(5)) + 1).cast("string"), F.lit(" stars"))
    ago = F.concat((F.col("turn") + 2).cast("string"), F.lit(" months ago"))
    html = F.concat(
        F.lit('<script>var t="<div data-review-id=x>";</script><!-- <div data-review-id> -->'),
        F.lit('<div data-review-id="a"><div class="d4r55">'), "role",
        F.lit('</div><span aria-label="'), stars, F.lit('"></span><span class="wiI7pd"><b>'), "text",
        F.lit('</b> &amp; more</span><span class="rsqaWe">'), ago, F.lit("</span></div>"),
        F.lit('<div data-review-id="b"><span class="the-author">second '), "role",
        F.lit('</span><i class="kvMYJc" aria-label="Rated 4"></i><p class="section-review-text">'), "text",
        F.lit('</p><span class="a-date">a year ago</span></div>'))
    return t.select("conv_id", "turn", html.alias("html"))


_TRIM = "regexp_replace({}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


@query("s14_review_pages", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role,
  regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g') AS text FROM conversations)
SELECT conv_id, turn, 0 AS pos, {_TRIM.format("role")} AS author_name,
  CAST(turn % 5 + 1 AS DOUBLE) AS rating, {_TRIM.format("text || ' & more'")} AS text,
  CAST(turn + 2 AS VARCHAR) || ' months ago' AS date_relative FROM t
UNION ALL SELECT conv_id, turn, 1, {_TRIM.format("'second ' || role")}, 4.0,
  CASE WHEN {_TRIM.format("text")} = '' THEN {_TRIM.format("'second ' || role")} ELSE {_TRIM.format("text")} END,
  'a year ago' FROM t""")
def s14b(spark, d):
    return pages.extract_records(_marked_up(spark, d), "html", ["conv_id", "turn"])


def _nested(spark, d):
    """Each turn as a page with elements in elements, a reply in a review, and attributes without double quotes."""
    t = read(spark, d, "conversations").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ").alias("text"))
    html = F.concat(
        F.lit("<div class=reviews-list><div class='a review' DATA-REVIEW-ID=r1><div class='x d4r55'><p>"), "role",
        F.lit("<p>again</div><img src=p.png alt='</div> 9 stars'><span class=kvMYJc aria-label='Rated "),
        (F.col("turn") % 5 + 1).cast("string"), F.lit(" stars'><i></i></span><span class = \"q wiI7pd\">"), "text",
        F.lit(" <span>very <b>deep</span> in</b><br/>line<input disabled> &eacute;</i></span>"
              "<ul><li>one<li><span class='rsqaWe'>"), (F.col("turn") + 2).cast("string"),
        F.lit(" months <span>ago</span></span></ul><div data-review-id><span class='wiI7pd'><span>reply to "), "role",
        F.lit("</span></span><script>document.write('</div><span class=rsqaWe>now</span>')</script></div></div>"
              "<div data-review-id=''><span><span></span></span><span title='a>b' class='the-author'>last"))
    return t.select("conv_id", "turn", html.alias("html"))


@query("s14_nested_pages", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role,
  regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g') AS text FROM conversations)
SELECT conv_id, turn, 0 AS pos, {_TRIM.format("role || 'again'")} AS author_name, CAST(turn % 5 + 1 AS DOUBLE) AS rating,
  {_TRIM.format("text || ' very deep in' || chr(10) || 'line é'")} AS text, CAST(turn + 2 AS VARCHAR) || ' months ago' AS date_relative FROM t
UNION ALL SELECT conv_id, turn, 1, '', NULL, {_TRIM.format("'reply to ' || role")}, '' FROM t
UNION ALL SELECT conv_id, turn, 2, 'last', NULL, '', '' FROM t""")
def s14c(spark, d):
    return pages.extract_records(_nested(spark, d), "html", ["conv_id", "turn"])


@query("s15_clean_address", r"""
SELECT s_suppkey, n_name || ' ' || s_name AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def s15(spark, d):
    df = read(spark, d, "supplier").join(read(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    raw = F.concat(F.lit(" \n\ue0c8"), F.col("n_name"), F.lit("\n"), F.col("s_name"), F.lit("  "))
    return df.select("s_suppkey", rules.clean_address(raw).alias("address"))


@query("s16_station_defaults", """
SELECT c_custkey AS idx, 'Station_' || CAST(c_custkey AS VARCHAR) AS title, c_acctbal AS lat,
  CAST(72.877 AS DOUBLE) AS lng, CASE WHEN c_acctbal < CAST(18.97 AS DOUBLE) THEN 'South Mumbai'
  WHEN c_acctbal < CAST(19.05 AS DOUBLE) THEN 'Central Mumbai'
  WHEN c_acctbal < CAST(19.15 AS DOUBLE) THEN 'Western Suburbs' ELSE 'North Suburbs' END AS zone,
  'Other' AS brand, 'Petrol Pump' AS category, CAST(0 AS DOUBLE) AS review_count FROM customer""")
def s16(spark, d):
    sheet = read(spark, d, "customer").select(
        F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("latitude_clean"))
    out = reviews.tag_stations(reviews.station_defaults(sheet))
    return out.select("idx", "title", "lat", "lng", "zone", "brand", "category", "review_count")
