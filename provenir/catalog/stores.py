"""Stored state: keyed stores, parameter tables and sinks, each written and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from provenir import schemas
from provenir.catalog import demo, query, sql
from provenir.functions import keys
from provenir.operators import excerpts as ex, pages as pg
from provenir.session import cut_lineage, small_table, stage_folder
from provenir.sources import keyed_store, readers, writers


def _root(spark, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid4().hex}"


_PAGE_ROWS = """r AS (SELECT 'https://h' || (user_id % 7) || '.net/' || user_id AS url, ts AS fetched_at, event_id % 3 AS part,
  event_type || ':' || event_id AS content FROM events WHERE event_type <> 'error')"""


@query(
    "cache_store",
    f"""WITH {_PAGE_ROWS}, n AS (SELECT url, arg_max(content, (fetched_at, content)) AS content, max(fetched_at) AS fetched_at FROM r GROUP BY url),
w AS (SELECT DISTINCT 'https://h' || (user_id % 7) || '.net/' || user_id AS url FROM events UNION SELECT 'https://none.net/' || n_nationkey FROM nation)
SELECT w.url, content, sha256(content) AS content_hash, epoch_us(fetched_at) AS fetched_us, n.url IS NOT NULL AS hit FROM w LEFT JOIN n USING (url)""",
)
def cache_store(spark, sf):
    """A3 A4: pages stored in three generations, and the cached entry of every wanted URL."""
    e = demo.table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    url = F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string"), F.lit(".net/"), user)
    content = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    none = F.lit(None).cast("string")
    rows = cut_lineage(
        e.filter(F.col("event_type") != "error").select(
            url.alias("url"), url.alias("final_url"), F.col("ts").cast("timestamp").alias("fetched_at"), content.alias("content"),
            keys.content_hash(content).alias("content_hash"), F.lit(200).alias("http_status"), none.alias("etag"),
            none.alias("last_modified"), (F.col("event_id") % 3).alias("part"),
        )
    )
    store = keyed_store.page_store(spark, _root(spark, "pages"), buckets=16)
    for part in range(3):
        store.merge(rows.filter(F.col("part") == part))
    wanted = e.select(url.alias("url")).union(
        demo.table(spark, sf, "nation").select(F.concat(F.lit("https://none.net/"), F.col("n_nationkey").cast("string")))
    )
    found = store.lookup(wanted.distinct())
    return found.select(
        "url", "content", "content_hash", F.unix_micros("fetched_at").alias("fetched_us"), F.col("content").isNotNull().alias("hit")
    )


@query(
    "corridor_store",
    """WITH r AS (SELECT 'corridor ' || (o_custkey % 50) AS corridor_key, o_orderdate, o_orderkey FROM orders),
n AS (SELECT corridor_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM r GROUP BY corridor_key),
o AS (SELECT corridor_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM r WHERE o_orderkey % 2 = 0 GROUP BY corridor_key)
SELECT n.corridor_key, n.k AS pages_fetched, o.k AS before FROM n LEFT JOIN o USING (corridor_key)""",
)
def corridor_store(spark, sf):
    """A5: resolved corridors stored twice; the newest of each, and what the first generation said."""
    orders = demo.table(spark, sf, "orders")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    rows = orders.select(
        F.concat(F.lit("corridor "), (F.col("o_custkey") % 50).cast("string")).alias("corridor_key"),
        F.col("o_orderdate").cast("timestamp").alias("resolved_at"),
        F.expr(f"cast(array() as {dict(small_table(spark, [], schemas.RESOLVED_CORRIDORS).dtypes)['sources']})").alias("sources"),
        empty("string").alias("unresolved_roles"), empty("string").alias("notes"), empty("string").alias("queries"),
        F.lit(0).alias("model_calls"), F.col("o_orderkey").cast("int").alias("pages_fetched"), "o_orderkey",
    )
    store = keyed_store.corridor_store(spark, _root(spark, "corridors"), buckets=8)
    first = store.merge(rows.filter("o_orderkey % 2 = 0"))
    store.merge(rows.filter("o_orderkey % 2 <> 0"))
    before = store.read(first).select("corridor_key", F.col("pages_fetched").cast("long").alias("before"))
    return store.read().select("corridor_key", F.col("pages_fetched").cast("long").alias("pages_fetched")).join(before, "corridor_key", "left")


@query(
    "dimensions",
    """SELECT 'N' || n_nationkey AS code, n_name AS name, n_nationkey::BIGINT AS seq, 'denied' || n_nationkey || '.com' AS domain FROM nation""",
)
def dimensions(spark, sf):
    """A2: country and denylist tables written as JSON and loaded with their declared schema."""
    root = _root(spark, "dimensions")
    nations = demo.countries(spark, sf).withColumn("tlds", F.array(F.lit("net")))
    nations.write.json(f"{root}/countries")
    denied = nations.select(F.concat(F.lit("denied"), F.col("seq").cast("string"), F.lit(".com")).alias("domain"), F.lit("commercial").alias("category"))
    denied.write.json(f"{root}/denylist")
    named = readers.read_denylist(spark, f"{root}/denylist").select(F.regexp_extract("domain", "[0-9]+", 0).cast("int").alias("seq"), "domain")
    return readers.read_countries(spark, f"{root}/countries").join(named, "seq").select("code", "name", F.col("seq").cast("long").alias("seq"), "domain")


@query(
    "registry_sink",
    """WITH n AS (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code, n_name AS name, n_nationkey AS k FROM nation)
SELECT code, name, row_number() OVER (ORDER BY code) - 1 AS line, 'z' || k || '.net' || ',' || 'a' || k || '.net' AS trusted FROM n""",
)
def registry_sink(spark, sf):
    """The registry as a file sorted by code, trusted domains in their own order."""
    n = F.col("n_nationkey").cast("string")
    rows = demo.table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.lpad(n, 2, "0")).alias("code"), F.col("n_name").alias("name"),
        F.array(F.concat(F.lit("z"), n, F.lit(".net")), F.concat(F.lit("a"), n, F.lit(".net"))).alias("trusted"),
        F.expr("cast(array() as array<struct<domain:string,evidence:string>>)").alias("reviewed"), F.array().cast("array<string>").alias("unconfirmable"),
    )
    path = f"{_root(spark, 'registry')}/out"
    writers.write_registry(rows, path)
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    of_line = lines.select(F.get_json_object("value", "$.code").alias("code"), "line")
    read = readers.read_registry(spark, path)
    return read.join(of_line, "code").select("code", "name", "line", F.array_join("trusted", ",").alias("trusted"))


_PACKET = """to_json({'destination': lang, 'traveller': {'nationality': upper(lang) || ' (' || lang || ')'}, 'sources': list_transform(list_sort(items),
  lambda i: {'source_id': i.source_id, 'title': i.title, 'url': i.url, 'authority': i.authority, 'content': i.content})})::VARCHAR"""


@query(
    "research_packets",
    f"""WITH s AS (SELECT doc_id // 8 AS request, min(lang) AS lang, list({{'seq': doc_id, 'source_id': 's' || doc_id, 'title': 'Page ' || doc_id, 'url': 'https://x/' || doc_id, 'authority': source, 'content': text}}) AS items,
  sum(length(text)) AS total FROM documents GROUP BY ALL),
t AS (SELECT request, CASE WHEN total <= 30000 THEN {_PACKET} END AS txt FROM s)
SELECT request, CASE WHEN length(txt) <= 30000 THEN txt END AS packet,
  CASE WHEN txt IS NULL OR length(txt) > 30000 THEN 'the packet is longer than 30000 characters' END AS rejected FROM t""",
)
def research_packets(spark, sf):
    """A10: a packet of destination, traveller and sources per request of eight documents, or why there is none."""
    docs = demo.table(spark, sf, "documents")
    request = F.floor(F.col("doc_id") / 8).alias("request")
    name = F.col("doc_id").cast("string")
    sources = docs.select(
        request, F.col("doc_id").alias("seq"), F.concat(F.lit("s"), name).alias("source_id"), F.concat(F.lit("Page "), name).alias("title"),
        F.concat(F.lit("https://x/"), name).alias("url"), F.col("source").alias("authority"), F.col("text").alias("content"),
    )
    requests = docs.groupBy(request).agg(F.min("lang").alias("destination")).select(
        "request", "destination",
        F.struct(F.concat(F.upper("destination"), F.lit(" ("), F.col("destination"), F.lit(")")).alias("nationality")).alias("traveller"),
    )
    return ex.research_packets(sources, requests, ["request"], 30_000).select("request", "packet", "rejected")


_META = """m AS (SELECT page_id, url, regexp_extract(html, '(?is)<a\\b[^>]*href="(/[^"]*)"', 1) AS href FROM p)"""


@query(
    "forward_targets",
    f"""WITH {sql.PAGES}, {_META}
SELECT page_id, CASE WHEN page_id % 4 = 3 OR href = '' THEN NULL WHEN page_id % 4 = 2 THEN 'https://else.net/' || page_id
  ELSE {sql.part('url', 1)} || '://' || {sql.part('url', 3)} || {sql.escape_path('href')} END AS target FROM m""",
)
def forward_targets(spark, sf):
    """Where a page's meta refresh leads, resolved against the page; the tag is written into its markup."""
    rows = demo.pages(spark, sf)
    href = F.regexp_extract("html", '(?is)<a\\b[^>]*href="(/[^"]*)"', 1)
    page = F.col("page_id").cast("string")
    tag = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<META HTTP-EQUIV="Refresh" content="0; URL=\''), href, F.lit("'\">")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("<meta content='5;url="), href, F.lit("' http-equiv=refresh >")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<meta http-equiv="refresh" content="1; url=https://else.net/'), page, F.lit('">')))
        .otherwise('<meta http-equiv="refresh" content="30"><meta http-equiv="refresh" content="0;url=/second">')
    )
    written = F.when(href == "", F.col("html")).otherwise(F.concat(tag, F.col("html")))
    return rows.select("page_id", pg.forward_target(written, F.col("url")).alias("target"))


@query(
    "content_kinds",
    f"""WITH {sql.PAGES}, {_META},
c AS (SELECT page_id, href || CASE WHEN page_id % 5 = 4 THEN '.PDF?x=1' ELSE '' END AS path,
  CASE page_id % 5 WHEN 0 THEN 'Application/JSON; charset=utf-8' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'text/html' ELSE 'text/plain' END AS kind FROM m)
SELECT page_id, page_id % 5 IN (0, 1) AS machine, page_id % 5 IN (2, 4) AS pdf, kind FROM c""",
)
def content_kinds(spark, sf):
    """Machine-readable and PDF answers, by type and by path."""
    page = F.col("page_id") % 5
    kinds = ["Application/JSON; charset=utf-8", "text/csv", "application/pdf", "text/html", "text/plain"]
    href = F.regexp_extract("html", '(?is)<a\\b[^>]*href="(/[^"]*)"', 1)
    rows = demo.pages(spark, sf).select(
        "page_id", F.element_at(F.array(*[F.lit(k) for k in kinds]), (page + 1).cast("int")).alias("kind"),
        F.concat(F.lit("https://h"), href, F.when(page == 4, ".PDF?x=1").otherwise("")).alias("link"),
    )
    return rows.select(
        "page_id", pg.is_machine_readable(F.col("kind")).alias("machine"), pg.is_pdf_response(F.col("kind"), F.col("link")).alias("pdf"), "kind"
    )
