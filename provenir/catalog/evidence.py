"""Freshness of evidence: cache lookups, the cache fold, ledgers, reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.catalog import demo, query, sql
from provenir.functions import keys, urls
from provenir.operators import freshness as fr
from provenir.operators.trust import flag_within
from provenir.params import SETTLED_REFUSALS
from provenir.params import LIMITS
from provenir.session import small_table

EVENTS = """ev AS (SELECT event_id, 'u' || user_id AS url, epoch_us(ts) AS "at", event_id AS seq, event_type,
  CASE WHEN event_type = 'view' THEN 'not_modified' WHEN event_type IN ('click', 'purchase') THEN 'stored'
    WHEN event_type = 'signup' THEN CASE WHEN value < 10 THEN 'stored' WHEN value < 15 THEN 'untrusted' ELSE 'disallowed' END
    WHEN value < 6 THEN 'unreachable' WHEN value < 12 THEN 'blocked' ELSE 'unusable' END AS attempt,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN sha256(props) END AS content_hash FROM events)"""


def observations(spark, sf):
    """Events as fetch observations of the user's page."""
    e = demo.table(spark, sf, "events")
    kind, value = F.col("event_type"), F.col("value")
    rows = e.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.when((value >= 15), "disallowed").otherwise("allowed")).otherwise("allowed").alias("policy"),
        F.when((kind == "error") & (value < 6), "timed out").alias("error"),
        (~((kind == "signup") & (value >= 10) & (value < 15))).alias("trusted"),
        F.when(kind == "view", 304).when((kind == "error") & (value < 12), 403).otherwise(200).alias("http_status"),
        F.lit(1000).alias("bytes"),
        F.lit(False).alias("machine"),
        F.lit("ok").alias("forward"),
        F.when((kind == "error") & (value >= 12), "too little readable text").alias("thin"),
        F.when(kind.isin("click", "purchase", "signup"), keys.content_hash(F.col("props"))).alias("content_hash"),
    )
    return fr.attempt(rows)


_FOLD = f"""{EVENTS},
ok AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY "at", seq) AS n FROM ev WHERE attempt IN ('stored', 'not_modified')),
chain AS (
  SELECT url, n, "at", seq, attempt, content_hash FROM ok o WHERE attempt = 'stored' AND n = (SELECT min(n) FROM ok i WHERE i.url = o.url AND i.attempt = 'stored')
  UNION ALL
  SELECT x.url, x.n, x."at", x.seq, x.attempt, x.content_hash FROM (
    SELECT o.*, row_number() OVER (PARTITION BY o.url ORDER BY o.n) AS k FROM chain c JOIN ok o ON o.url = c.url AND o.n > c.n AND o."at" - c."at" >= 24 * 3600000000) x WHERE k = 1),
held AS (SELECT url, "at", seq, attempt, content_hash, last_value(CASE WHEN attempt = 'stored' THEN content_hash END IGNORE NULLS) OVER (PARTITION BY url ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held_hash FROM chain),
st AS (SELECT ev.*, h."at" AS h_at, h.held_hash, (ev."at" - h."at") / 3.6e9 AS age FROM ev LEFT JOIN LATERAL (SELECT * FROM held WHERE held.url = ev.url AND (held."at" < ev."at" OR (held."at" = ev."at" AND held.seq < ev.seq)) ORDER BY "at" DESC, seq DESC LIMIT 1) h ON true),
rs AS (SELECT *, CASE WHEN h_at IS NOT NULL AND age < 24 THEN 'hit' WHEN attempt = 'not_modified' AND h_at IS NOT NULL THEN 'revalidated'
   WHEN attempt = 'stored' THEN 'fetched' WHEN attempt = 'untrusted' THEN 'failure' WHEN h_at IS NOT NULL AND age <= 168 THEN 'stale' ELSE 'failure' END AS result FROM st)"""


@query(
    "cache_fold",
    f"""WITH RECURSIVE {_FOLD}
SELECT event_id, url, attempt, result, CASE WHEN result = 'failure' THEN CASE WHEN attempt = 'not_modified' THEN 'unreachable' ELSE attempt END WHEN result = 'stale' THEN 'stale' ELSE 'ok' END AS outcome,
  CASE WHEN result IN ('fetched', 'revalidated') THEN "at" WHEN result IN ('hit', 'stale') THEN h_at END AS served_at,
  CASE WHEN result = 'fetched' THEN content_hash WHEN result <> 'failure' THEN held_hash END AS served_hash,
  round(age, 4) AS age_hours FROM rs""",
)
def cache_fold(spark, sf):
    """What the cache makes of every fetch observation."""
    folded = fr.fold_cache(observations(spark, sf))
    return folded.select(
        "event_id", "url", "attempt", "result", "outcome", "served_at", "served_hash",
        F.round("age_hours", 4).alias("age_hours"),
    )


@query(
    "cache_fold_busy",
    f"""WITH RECURSIVE {_FOLD}
SELECT url, "at", seq, attempt, held_hash FROM held""",
)
def cache_fold_busy(spark, sf):
    """The refreshes of every page, all of them by the path for busy pages."""
    moved = fr.refreshes(observations(spark, sf), row_limit=0)
    return moved.select("url", "at", "seq", "attempt", "held_hash")


@query(
    "graded_plans",
    f"""WITH RECURSIVE {_FOLD},
pr AS (SELECT rs.*, event_id // 7 AS plan_id FROM rs),
pl AS (SELECT DISTINCT event_id // 7 AS plan_id FROM events),
g AS (SELECT plan_id, bool_or(result = 'failure') AS failed, bool_or(result = 'stale') AS stale,
  max(CASE WHEN result IN ('fetched', 'revalidated') THEN "at" WHEN result IN ('hit', 'stale') THEN h_at END) AS last,
  count(*) FILTER (result <> 'failure') AS fetched, count(*) FILTER (result = 'failure') AS failures FROM pr GROUP BY plan_id)
SELECT plan_id, CASE WHEN plan_id % 4 = 0 OR plan_id % 9 = 0 OR failed OR stale THEN 'partial' ELSE 'verified' END AS graded, last AS checked_us, fetched, failures
FROM pl JOIN g USING (plan_id)""",
)
def graded_plans(spark, sf):
    """The entry point from fetch observations and drafted plans to grades; a plan asks for seven pages."""
    from provenir.plans.grade import grade

    seen = observations(spark, sf)
    plan = F.floor(F.col("event_id") / 7).alias("plan_id")
    wanted = seen.select(plan, F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("source_id"), "url", F.col("seq").cast("long").alias("seq"))
    plans = wanted.select("plan_id").distinct().select(
        "plan_id", (F.col("plan_id") % 4 != 0).alias("has_checklist"), (F.col("plan_id") % 9 == 0).alias("decision_is_unverified")
    )
    graded, fetched, failures = grade(seen, wanted, plans)
    count = lambda rows, name: rows.groupBy("plan_id").agg(F.count("*").alias(name))
    return (
        graded.join(count(fetched, "fetched"), "plan_id", "left")
        .join(count(failures, "failures"), "plan_id", "left")
        .select(
            "plan_id", "graded", F.unix_micros("last_checked").alias("checked_us"),
            F.coalesce("fetched", F.lit(0)).alias("fetched"), F.coalesce("failures", F.lit(0)).alias("failures"),
        )
    )


@query(
    "content_changes",
    f"""WITH RECURSIVE {_FOLD}
SELECT url, "at", content_hash, coalesce(content_hash <> lag(content_hash) OVER (PARTITION BY url ORDER BY "at", seq), false) AS changed FROM held WHERE attempt = 'stored'""",
)
def content_changes(spark, sf):
    """Stored pages whose text differs from the one before."""
    moved = fr.refreshes(observations(spark, sf))
    return fr.content_changes(moved).select("url", "at", "content_hash", "changed")


@query(
    "page_cache",
    f"""WITH RECURSIVE {_FOLD}
SELECT url, "at" AS fetched_at, held_hash AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY "at" DESC, seq DESC) AS k FROM held) WHERE k = 1""",
)
def page_cache(spark, sf):
    """A3 A4: the current cache row of every page."""
    return fr.cache_table(fr.refreshes(observations(spark, sf)))


@query(
    "cache_lookup",
    f"""WITH {EVENTS}, en AS (SELECT url, "at", content_hash FROM ev WHERE attempt = 'stored')
SELECT ev.event_id, en.content_hash AS cached_hash, round((ev."at" - en."at") / 3.6e9, 4) AS age_hours,
  CASE WHEN en."at" IS NULL THEN 'miss' WHEN (ev."at" - en."at") / 3.6e9 < 24 THEN 'hit' WHEN (ev."at" - en."at") / 3.6e9 <= 168 THEN 'stale' ELSE 'expired' END AS class
FROM ev ASOF LEFT JOIN en ON ev.url = en.url AND ev."at" >= en.at""",
)
def cache_lookup(spark, sf):
    """The last stored page at or before every event, by age class."""
    rows = observations(spark, sf).select("event_id", "url", "at", "seq", "attempt", "content_hash")
    entries = rows.filter(F.col("attempt") == "stored").select("url", "at", "seq", "content_hash")
    joined = fr.as_of(rows, entries, ["url"], "at", "seq", "held")
    age = keys.age_hours(F.timestamp_micros("held.at"), F.timestamp_micros("at"))
    return joined.withColumn("age", age).select(
        "event_id",
        F.col("held.content_hash").alias("cached_hash"),
        F.round("age", 4).alias("age_hours"),
        F.when(F.col("held").isNull(), "miss")
        .when(F.col("age") < 24, "hit")
        .when(F.col("age") <= 168, "stale")
        .otherwise("expired")
        .alias("class"),
    )


_OUT = f"""{EVENTS}, oc AS (SELECT url, "at", seq, CASE WHEN attempt IN ('stored', 'not_modified') THEN 'ok' ELSE attempt END AS outcome,
   attempt || ' at last' AS reason, CASE WHEN attempt = 'blocked' THEN CASE WHEN seq % 2 = 0 THEN 403 ELSE 429 END WHEN attempt = 'stored' THEN 200 END AS status FROM ev),
la AS (SELECT url, arg_max(outcome, ("at", seq)) AS outcome, arg_max(reason, ("at", seq)) AS reason, max("at") AS "at", arg_max(seq, ("at", seq)) AS seq FROM oc GROUP BY url),
ss AS (SELECT url, arg_max(status, ("at", seq)) AS status FROM oc WHERE status IS NOT NULL GROUP BY url),
le AS (SELECT la.*, status FROM la LEFT JOIN ss USING (url))"""


def _ledger(spark, sf):
    rows = observations(spark, sf)
    tried = F.col("attempt")
    status = F.when(tried == "blocked", F.when(F.col("seq") % 2 == 0, 403).otherwise(429)).when(
        tried == "stored", 200
    )
    return fr.ledger(
        rows.select(
            "url", "at", "seq",
            F.when(tried.isin("stored", "not_modified"), "ok").otherwise(tried).alias("outcome"),
            F.concat(tried, F.lit(" at last")).alias("reason"),
            status.alias("status"),
        )
    )


@query(
    "ledger",
    f"""WITH {_OUT} SELECT url, outcome, status::BIGINT AS status, "at", outcome = 'blocked' AND coalesce(status IN (401, 403), false) AS persistent,
  'u (' || url || ') could not be used: ' || reason AS sentence FROM le""",
)
def ledger(spark, sf):
    """Last outcome per page, with settled refusals and a sentence."""
    rows = _ledger(spark, sf)
    settled = (F.col("outcome") == "blocked") & F.coalesce(
        F.col("status").isin(SETTLED_REFUSALS), F.lit(False)
    )
    from provenir.operators.checks import failure_sentence

    told = rows.withColumn("title", F.lit("u")).withColumn("authority", F.col("url")).withColumn("detail", F.col("reason"))
    return told.select(
        "url", "outcome", F.col("status").cast("long").alias("status"), "at",
        settled.alias("persistent"), failure_sentence().alias("sentence"),
    )


@query(
    "failure_rollup",
    f"""WITH {_OUT}, h AS (SELECT *, 'h' || (substring(url, 2)::INT % 20) AS host FROM le WHERE outcome <> 'ok')
SELECT host, 'unreadable' AS kind, arg_min(reason, ("at", seq)) AS reason FROM h WHERE outcome <> 'disallowed' GROUP BY host
UNION ALL SELECT DISTINCT host, 'skipped', reason FROM h WHERE outcome = 'disallowed'
UNION ALL SELECT DISTINCT host, 'inaccessible', '' FROM h WHERE outcome = 'blocked'
UNION ALL SELECT host, 'refused', url FROM h WHERE outcome = 'blocked' AND status IN (401, 403)""",
)
def failure_rollup(spark, sf):
    """failures per host, as rows: unreadable, skipped, inaccessible, refused pages."""
    from provenir.operators.evidence_report import rollup_failures

    rows = _ledger(spark, sf).withColumn(
        "host", F.concat(F.lit("h"), (F.substring("url", 2, 10).cast("int") % 20).cast("string"))
    )
    return rollup_failures(rows)


@query(
    "crawl_outcome",
    """WITH e AS (SELECT event_id, event_type, value, 'https://' || CASE WHEN value < 4 THEN 'ok.net' WHEN value < 8 THEN 'sub.ok.net' ELSE 'notok.net' END AS landing FROM events)
SELECT event_id, CASE WHEN event_type = 'signup' AND value > 30 THEN 'disallowed' WHEN event_type = 'error' AND value < 5 THEN 'unreachable'
  WHEN NOT (landing IN ('https://ok.net', 'https://sub.ok.net')) THEN 'untrusted' WHEN event_type = 'error' AND value < 6 THEN 'disallowed'
  WHEN event_type = 'error' THEN 'blocked' WHEN event_type = 'view' THEN 'unusable' WHEN event_type = 'purchase' AND value < 2 THEN 'unusable'
  WHEN event_type = 'purchase' AND value < 3 THEN 'unusable' WHEN event_type = 'click' AND value < 1 THEN 'unusable' ELSE 'ok' END AS outcome FROM e""",
)
def crawl_outcome(spark, sf):
    """How every crawl request ended."""
    kind, value = F.col("event_type"), F.col("value")
    site = F.when(value < 4, "ok.net").when(value < 8, "sub.ok.net").otherwise("notok.net")
    rows = demo.table(spark, sf, "events").select(
        "event_id",
        F.when((kind == "signup") & (value > 30), "disallowed").otherwise("allowed").alias("policy"),
        F.when((kind == "error") & (value < 5), "reset").alias("error"),
        F.concat(F.lit("https://"), site).alias("final_url"),
        F.when((kind == "error") & (value < 6), "unreadable").otherwise("allowed").alias("landing_policy"),
        F.when(kind == "error", 429).when(kind == "view", 404).otherwise(200).alias("http_status"),
        F.when((kind == "purchase") & (value < 2), 4_000_001).otherwise(10).alias("bytes"),
        F.when((kind == "purchase") & (value < 3), "application/json").alias("content_type"),
        F.when((kind == "click") & (value < 1), " ").otherwise("text").alias("body"),
    )
    trusted = small_table(spark, [("ok.net",)], "domain string")
    hosted = rows.withColumn("host", urls.host(F.col("final_url")))
    flagged = flag_within(hosted, "host", trusted, "landing_trusted")
    return fr.crawl_outcome(flagged).select("event_id", "outcome")


_REUSE = """WITH e AS (SELECT event_id, user_id AS k, epoch_us(ts) AS "at", event_type FROM events),
s AS (SELECT k, "at", event_id FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type <> 'purchase'),
j AS (SELECT r.event_id, r."at", s."at" AS sat, s.event_id AS stored_id FROM r ASOF LEFT JOIN s ON r.k = s.k AND r."at" >= s."at")"""


def _asked_and_stored(spark, sf, key):
    rows = demo.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias(key), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type"
    )
    stored = rows.filter(F.col("event_type") == "purchase").select(key, "at", "event_id")
    return rows.filter(F.col("event_type") != "purchase").select("event_id", key, "at"), stored


@query(
    "corridor_reuse",
    f"""{_REUSE}
SELECT event_id, stored_id, coalesce(("at" - sat) / 3.6e9 < 504, false) AS reused FROM j""",
)
def corridor_reuse(spark, sf):
    """Requests that reuse a stored corridor (504 h)."""
    asked, stored = _asked_and_stored(spark, sf, "k")
    found = fr.reuse(asked, stored, ["k"], "at", "event_id", LIMITS.corridor_hours)
    return found.select("event_id", F.col("held.event_id").alias("stored_id"), "reused")


@query(
    "policy_reuse",
    f"""{_REUSE}
SELECT event_id, stored_id, CASE WHEN ("at" - sat) / 3.6e9 < 24 THEN 'reused' ELSE 'fetch' END AS policy FROM j""",
)
def policy_reuse(spark, sf):
    """Crawl policies looked up within a day of their fetch, per origin."""
    from provenir.operators import policies as pol

    asked, stored = _asked_and_stored(spark, sf, "origin")
    found = pol.reusable(asked.withColumnRenamed("event_id", "ask"), stored.withColumnRenamed("event_id", "ask"))
    return found.select(F.col("ask").alias("event_id"), F.col("held.ask").alias("stored_id"), "policy")


@query(
    "newest_runs",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS outcome FROM events GROUP BY user_id""",
)
def newest_runs(spark, sf):
    """The newest run of every corridor."""
    rows = demo.table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("outcome"))
    return fr.newest(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "outcome")


@query(
    "cache_stream",
    f"""WITH RECURSIVE {_FOLD}
SELECT event_id, url, attempt, result, CASE WHEN result IN ('fetched', 'revalidated') THEN "at" WHEN result IN ('hit', 'stale') THEN h_at END AS served_at,
  CASE WHEN result = 'fetched' THEN content_hash WHEN result <> 'failure' THEN held_hash END AS served_hash FROM rs""",
)
def cache_stream(spark, sf):
    """J3 as a stream: the same fold by keyed state."""
    from provenir.streaming.cache_stream import replay

    return replay(spark, observations(spark, sf))
