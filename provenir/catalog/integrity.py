"""Plan grading and integrity rules over plan-shaped rows built from orders, lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.catalog import demo, query
from provenir.operators import checks as ck
from provenir.operators.large_groups import dealt
from provenir.session import cut_lineage

# A plan is an order; its lines are its sources (by part), its steps and its citations.
_PLAN = """pl AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'partial' ELSE 'verified' END AS status,
  o_orderstatus <> 'P' AS has_checklist, o_orderpriority = '2-HIGH' AS unverified, o_orderpriority <> '3-MEDIUM' AS has_location FROM orders),
so AS (SELECT l_orderkey AS plan_id, l_partkey AS source_id, l_returnflag = 'R' AS is_stale, l_shipdate AS retrieved_at FROM lineitem WHERE l_linestatus = 'O'),
fa AS (SELECT l_orderkey AS plan_id, l_partkey AS source_id, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A'),
ci AS (SELECT l_orderkey AS plan_id, l_partkey AS source_id FROM lineitem WHERE l_returnflag IN ('N', 'R')),
rq AS (SELECT l_orderkey AS plan_id, l_partkey AS source_id, l_suppkey AS requirement FROM lineitem WHERE l_tax > 0.05),
qs AS (SELECT l_orderkey AS plan_id FROM lineitem WHERE l_discount > 0.07),
st AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_no, p_name AS title, p_type AS action, CASE WHEN l_quantity < 3 THEN 'no' ELSE p_brand END AS timing,
  CASE WHEN l_quantity < 20 THEN 'source' WHEN l_quantity < 35 THEN 'application_route' ELSE 'none' END AS link_target,
  CASE WHEN l_quantity < 10 OR l_quantity > 48 THEN l_partkey WHEN l_quantity < 18 THEN l_partkey + 1 END AS link_source_id, l_partkey AS source_id
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _plans(spark, sf):
    o = demo.table(spark, sf, "orders")
    first = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("plan_id"),
        F.when(first == "1-URGENT", "partial").otherwise("verified").alias("status"),
        (F.col("o_orderstatus") != "P").alias("has_checklist"),
        (first == "2-HIGH").alias("decision_is_unverified"),
        (first != "3-MEDIUM").alias("has_location"),
    )


def _lines(spark, sf):
    return demo.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "plan_id").withColumnRenamed(
        "l_partkey", "source_id"
    )


def _sources(lines):
    return lines.filter(F.col("l_linestatus") == "O").select(
        "plan_id", "source_id", (F.col("l_returnflag") == "R").alias("is_stale"),
        F.col("l_shipdate").alias("retrieved_at"),
    )


def _failures(lines):
    return lines.filter((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"))


@query(
    "plan_status",
    f"""WITH {_PLAN}, s AS (SELECT plan_id, bool_or(is_stale) AS stale, max(retrieved_at) AS last FROM so GROUP BY plan_id), f AS (SELECT DISTINCT plan_id FROM fa)
SELECT pl.plan_id, CASE WHEN NOT has_checklist OR unverified OR f.plan_id IS NOT NULL OR coalesce(stale, false) THEN 'partial' ELSE 'verified' END AS graded,
  CAST(last AS VARCHAR)[:10] AS last_checked FROM pl LEFT JOIN s USING (plan_id) LEFT JOIN f ON f.plan_id = pl.plan_id""",
)
def plan_status(spark, sf):
    """The grade of every plan, and when its evidence was last checked."""
    lines = _lines(spark, sf)
    graded = ck.plan_status(_plans(spark, sf), _sources(lines), _failures(lines))
    return graded.select(
        "plan_id", "graded", F.date_format("last_checked", "yyyy-MM-dd").alias("last_checked")
    )


@query(
    "missing_sources",
    f"""WITH {_PLAN}, rr AS (SELECT plan_id, source_id, min(requirement) AS seq FROM rq GROUP BY ALL),
f1 AS (SELECT plan_id, source_id, min(l_linenumber) AS n FROM fa GROUP BY ALL)
SELECT rr.plan_id, rr.source_id, seq, CASE WHEN n IS NULL THEN 'The required source ' || rr.source_id || ' was not retrieved.' ELSE 'Part ' || rr.source_id || ' (Line ' || n || ') could not be used: failed' END AS reason
FROM rr LEFT JOIN f1 USING (plan_id, source_id) WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.plan_id = rr.plan_id AND so.source_id = rr.source_id)""",
)
def missing_sources(spark, sf):
    """Required sources that were not fetched, with the reason."""
    lines = _lines(spark, sf)
    required = lines.filter(F.col("l_tax") > 0.05).groupBy("plan_id", "source_id").agg(F.min("l_suppkey").alias("seq"))
    failures = (
        _failures(lines)
        .groupBy("plan_id", "source_id")
        .agg(F.min("l_linenumber").alias("n"))
        .select(
            "plan_id", "source_id",
            F.concat(F.lit("Part "), F.col("source_id").cast("string")).alias("title"),
            F.concat(F.lit("Line "), F.col("n").cast("string")).alias("authority"),
            F.lit("failed").alias("detail"),
        )
    )
    found = ck.missing_sources(required, _sources(lines), failures, ["plan_id"])
    return found.select("plan_id", "source_id", "seq", "reason")


@query(
    "cited_requirements",
    f"""WITH {_PLAN}, k AS (SELECT DISTINCT plan_id, requirement FROM rq WHERE EXISTS (SELECT 1 FROM so WHERE so.plan_id = rq.plan_id AND so.source_id = rq.source_id)),
a AS (SELECT DISTINCT plan_id FROM so), c AS (SELECT plan_id, count(*) AS kept FROM k GROUP BY plan_id),
x AS (SELECT plan_id, bool_and(EXISTS (SELECT 1 FROM so WHERE so.plan_id = rq.plan_id AND so.source_id = rq.source_id)) AS subset FROM rq GROUP BY plan_id)
SELECT a.plan_id, coalesce(kept, 0) AS kept, coalesce(kept, 0) = 0 AS nothing_left, coalesce(subset, true) AS all_fetched FROM a LEFT JOIN c USING (plan_id) LEFT JOIN x USING (plan_id)""",
)
def cited_requirements(spark, sf):
    """H3 H5: requirements that cite a checklist source, and whether all cited ones were fetched."""
    lines = _lines(spark, sf)
    sources = _sources(lines)
    asked = lines.filter(F.col("l_tax") > 0.05).select(
        "plan_id", "source_id", F.col("l_suppkey").alias("requirement")
    )
    kept = ck.cited_requirements(asked, sources, ["plan_id"]).groupBy("plan_id").agg(F.count("*").alias("kept"))
    outside = asked.join(sources, ["plan_id", "source_id"], "left_anti").select("plan_id").distinct()
    plans = sources.select("plan_id").distinct()
    return (
        plans.join(kept, "plan_id", "left")
        .join(outside.withColumn("_out", F.lit(True)), "plan_id", "left")
        .select(
            "plan_id",
            F.coalesce("kept", F.lit(0)).alias("kept"),
            F.col("kept").isNull().alias("nothing_left"),
            F.col("_out").isNull().alias("all_fetched"),
        )
    )


@query(
    "integrity",
    f"""WITH {_PLAN}, sd AS (SELECT plan_id, source_id FROM so),
sc AS (SELECT DISTINCT plan_id, step_no, source_id FROM st),
n AS (SELECT plan_id, count(*) AS n FROM st GROUP BY plan_id)
SELECT plan_id::VARCHAR AS entity_id, 'verified_with_failure' AS rule, 'unavailable source' AS detail FROM pl WHERE status = 'verified' AND plan_id IN (SELECT plan_id FROM fa)
UNION ALL SELECT plan_id::VARCHAR, 'verified_with_stale', 'stale source' FROM pl WHERE status = 'verified' AND plan_id IN (SELECT plan_id FROM so WHERE is_stale)
UNION ALL SELECT plan_id::VARCHAR, 'requirements_without_checklist', 'requirement' FROM pl WHERE NOT has_checklist AND plan_id IN (SELECT plan_id FROM rq)
UNION ALL SELECT plan_id::VARCHAR, 'no_checklist_no_question', 'open question missing' FROM pl WHERE NOT has_checklist AND plan_id NOT IN (SELECT plan_id FROM qs)
UNION ALL SELECT DISTINCT plan_id::VARCHAR, 'unknown_citation', source_id::VARCHAR FROM ci WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.plan_id = ci.plan_id AND so.source_id = ci.source_id)
UNION ALL SELECT plan_id::VARCHAR, 'duplicate_source', source_id::VARCHAR FROM so GROUP BY plan_id, source_id HAVING count(*) > 1
UNION ALL SELECT pl.plan_id::VARCHAR, 'step_count', coalesce(n, 0)::VARCHAR FROM pl LEFT JOIN n USING (plan_id) WHERE coalesce(n, 0) NOT BETWEEN 4 AND 8
UNION ALL SELECT plan_id::VARCHAR, 'title_length', 'step ' || step_no FROM st WHERE length(title) NOT BETWEEN 3 AND 70
UNION ALL SELECT plan_id::VARCHAR, 'action_length', 'step ' || step_no FROM st WHERE length(action) NOT BETWEEN 3 AND 320
UNION ALL SELECT plan_id::VARCHAR, 'timing_length', 'step ' || step_no FROM st WHERE length(timing) NOT BETWEEN 3 AND 160
UNION ALL SELECT plan_id::VARCHAR, 'source_link_without_id', 'step ' || step_no FROM st WHERE link_target = 'source' AND link_source_id IS NULL
UNION ALL SELECT plan_id::VARCHAR, 'link_not_cited', 'step ' || step_no FROM st WHERE link_target = 'source' AND link_source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.plan_id = st.plan_id AND sc.step_no = st.step_no AND sc.source_id = st.link_source_id)
UNION ALL SELECT plan_id::VARCHAR, 'stray_link_id', 'step ' || step_no FROM st WHERE link_target <> 'source' AND link_source_id IS NOT NULL
UNION ALL SELECT st.plan_id::VARCHAR, 'route_link_without_location', 'step ' || step_no FROM st JOIN pl USING (plan_id) WHERE link_target = 'application_route' AND NOT has_location""",
)
def integrity(spark, sf):
    """K4 K5 K6 K7: rule violations of every plan."""
    lines = _lines(spark, sf)
    rows = lines.count()
    plans, sources, failures = _plans(spark, sf), _sources(lines), _failures(lines)
    part = demo.table(spark, sf, "part").withColumnRenamed("p_partkey", "source_id")
    quantity, source = F.col("l_quantity"), F.col("source_id")
    steps = dealt(lines, rows, "source_id").join(dealt(part, rows, "source_id"), "source_id").select(
        "plan_id", F.col("l_linenumber").alias("step_no"), F.col("p_name").alias("title"),
        F.col("p_type").alias("action"), F.when(quantity < 3, "no").otherwise(F.col("p_brand")).alias("timing"),
        F.when(quantity < 20, "source").when(quantity < 35, "application_route").otherwise("none").alias("link_target"),
        F.when((quantity < 10) | (quantity > 48), source).when(quantity < 18, source + 1).alias("link_source_id"),
        "source_id",
    )
    # Every rule on steps reads them; they are joined and written once.
    steps = cut_lineage(steps)
    cited = lines.filter(F.col("l_returnflag").isin("N", "R"))
    required = lines.filter(F.col("l_tax") > 0.05)
    questions = lines.filter(F.col("l_discount") > 0.07)
    return ck.together(
        [
            ck.check_statuses(plans, sources, failures, rows),
            ck.check_checklist(plans, required, questions, rows),
            ck.check_citations(cited, sources, rows),
            ck.check_steps(plans, steps.drop("source_id"), steps.select("plan_id", "step_no", "source_id"), rows),
        ]
    )


_DEST = """ds AS (SELECT 's' || s_suppkey AS slug, CASE WHEN s_nationkey < 8 THEN 'schengen_member' ELSE 'national' END AS route_type,
  CASE WHEN s_acctbal > 3000 THEN 'N' || s_nationkey END AS member, s_acctbal < 0 AS unverified FROM supplier),
ps AS (SELECT 's' || s_suppkey AS slug, s_suppkey, 'n' || s_nationkey || '.gov' AS domain FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 's' || s_suppkey, s_suppkey, 'com' FROM supplier WHERE s_nationkey = 4),
cs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
sr AS (SELECT 's' || l_suppkey AS slug, 'p' || l_partkey AS source_id, 'https://www.n' || (CASE WHEN l_partkey < 40 THEN 99 ELSE s_nationkey END) || '.gov/' || l_partkey AS url, s_nationkey FROM cs JOIN supplier ON s_suppkey = l_suppkey),
ck AS (SELECT 's' || l_suppkey AS slug, 'p' || l_partkey AS source_id FROM lineitem WHERE l_discount = 0.1),
rq AS (SELECT DISTINCT 's' || l_suppkey AS slug, 'p' || l_partkey AS source_id FROM lineitem WHERE l_tax = 0.08),
un AS (SELECT 's' || s_suppkey AS slug, 'https://n' || (s_suppkey % 25) || '.gov/x' AS url FROM supplier WHERE s_acctbal < -500),
pr AS (SELECT 's' || s_suppkey AS slug, 'agent' || s_suppkey || '.com' AS domain, 'p' || (s_suppkey + 5) AS source_id FROM supplier),
td AS (SELECT slug, domain FROM ps UNION SELECT slug, domain FROM pr)"""


def _off(table: str) -> str:
    return (
        f"NOT EXISTS (SELECT 1 FROM td WHERE td.slug = {table}.slug AND (regexp_extract(url, '//([^/]*)', 1) = td.domain "
        f"OR ends_with(regexp_extract(url, '//([^/]*)', 1), '.' || td.domain)))"
    )


@query(
    "destination_rules",
    f"""WITH {_DEST}
SELECT slug AS entity_id, 'member_missing' AS rule, 'no member country' AS detail FROM ds WHERE route_type = 'schengen_member' AND member IS NULL
UNION ALL SELECT slug, 'member_on_national_route', member FROM ds WHERE route_type = 'national' AND member IS NOT NULL
UNION ALL SELECT slug, 'duplicate_checklist_id', source_id FROM ck GROUP BY slug, source_id HAVING count(*) > 1
UNION ALL SELECT slug, 'unknown_checklist_id', source_id FROM ck WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.slug = ck.slug AND sr.source_id = ck.source_id)
UNION ALL SELECT slug, 'unknown_required_id', source_id FROM rq WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.slug = rq.slug AND sr.source_id = rq.source_id)
UNION ALL SELECT slug, 'unverified_without_authority', 'no unreadable authority' FROM ds WHERE unverified AND slug NOT IN (SELECT slug FROM un)
UNION ALL SELECT slug, 'unreadable_off_trust', url FROM un WHERE {_off('un')}
UNION ALL SELECT slug, 'bare_suffix_trusted', domain FROM ps WHERE domain = 'com'
UNION ALL SELECT slug, 'unknown_appointing_source', domain FROM pr WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.slug = pr.slug AND sr.source_id = pr.source_id)
UNION ALL SELECT DISTINCT slug, 'sources_without_domains', 'no trusted domain' FROM sr WHERE slug NOT IN (SELECT slug FROM ps)
UNION ALL SELECT slug, 'source_off_trust', url FROM sr WHERE {_off('sr')}""",
)
def destination_rules(spark, sf):
    """K1 K2: rule violations of destination configurations."""
    supplier = demo.table(spark, sf, "supplier")
    lines = demo.table(spark, sf, "lineitem")
    slug = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    nation = F.col("s_nationkey").cast("string")
    line_slug = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("slug")
    source = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id")
    destinations = supplier.select(
        slug.alias("slug"),
        F.when(F.col("s_nationkey") < 8, "schengen_member").otherwise("national").alias("route_type"),
        F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("N"), nation)).alias("schengen_member"),
        (F.col("s_acctbal") < 0).alias("decision_is_unverified"),
    )
    domain = F.concat(F.lit("n"), nation, F.lit(".gov"))
    domains = supplier.filter(F.col("s_nationkey") != 3).select(slug.alias("slug"), domain.alias("domain")).unionByName(
        supplier.filter(F.col("s_nationkey") == 4).select(slug.alias("slug"), F.lit("com").alias("domain"))
    )
    cited = lines.filter(F.col("l_returnflag") == "R").select("l_suppkey", "l_partkey").distinct()
    number = F.when(F.col("l_partkey") < 40, "99").otherwise(nation)
    sources = cited.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        line_slug, source,
        F.concat(F.lit("https://www.n"), number, F.lit(".gov/"), F.col("l_partkey").cast("string")).alias("url"),
    )
    sources = cut_lineage(sources)
    unreadable = supplier.filter(F.col("s_acctbal") < -500).select(
        slug.alias("slug"),
        F.concat(F.lit("https://n"), (F.col("s_suppkey") % 25).cast("string"), F.lit(".gov/x")).alias("url"),
    )
    providers = supplier.select(
        slug.alias("slug"),
        F.concat(F.lit("agent"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"),
        F.concat(F.lit("p"), (F.col("s_suppkey") + 5).cast("string")).alias("appointed_by"),
    )
    checklist = lines.filter(F.col("l_discount") == 0.1).select(line_slug, source)
    required = lines.filter(F.col("l_tax") == 0.08).select(line_slug, source).distinct()
    return ck.check_destinations(destinations, sources, checklist, required, domains, providers, unreadable, sources.count())


@query(
    "registry_rules",
    """WITH e AS (SELECT 'N' || c_nationkey AS code, CASE WHEN c_mktsegment = 'BUILDING' THEN 'trusted' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'reviewed' ELSE 'unconfirmable' END AS list,
  'd' || (c_custkey // 3) || '.gov' AS domain, CASE WHEN c_acctbal < 0 THEN ' ' ELSE 'seen' END AS evidence FROM customer),
k AS (SELECT 'N' || n_nationkey AS code, n_nationkey % 2 AS half FROM nation UNION ALL SELECT 'N' || s_nationkey, 2 FROM supplier)
SELECT code AS entity_id, 'domain_in_two_lists' AS rule, domain AS detail FROM e GROUP BY code, domain HAVING count(DISTINCT list) > 1
UNION ALL SELECT code, 'reviewed_without_evidence', domain FROM e WHERE list = 'reviewed' AND trim(evidence) = ''
UNION ALL SELECT code, 'duplicate_code', code FROM k GROUP BY code HAVING count(*) > 1
UNION ALL SELECT code, 'code_shape', 'field rule' FROM (SELECT 'N' || n_nationkey AS code FROM nation) WHERE NOT regexp_matches(code, '^[A-Z]{1}[0-9]{2}$')
UNION ALL SELECT c_mktsegment || c_custkey, 'ceiling_below_ttl', 'stale ceiling below TTL' FROM customer WHERE c_acctbal < 24""",
)
def registry_rules(spark, sf):
    """Rule violations of registry rows, codes and freshness policies."""
    customer = demo.table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    entries = customer.select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"),
        F.when(segment == "BUILDING", "trusted").when(segment == "AUTOMOBILE", "reviewed").otherwise("unconfirmable").alias("list"),
        F.concat(F.lit("d"), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit(".gov")).alias("domain"),
        F.when(F.col("c_acctbal") < 0, " ").otherwise("seen").alias("evidence"),
    )
    nations = demo.table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    codes = nations.unionByName(
        demo.table(spark, sf, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("code"))
    )
    policies = customer.select(
        F.concat(segment, F.col("c_custkey").cast("string")).alias("name"),
        F.lit(24.0).alias("fresh_hours"), F.col("c_acctbal").alias("stale_hours"),
    )
    return ck.together(
        [
            ck.check_registry(entries),
            ck.duplicates(codes, [], "code", "duplicate_code"),
            ck.check_fields(nations, "code", [("code_shape", F.col("code").rlike("^[A-Z]{1}[0-9]{2}$"))]),
            ck.check_policy(policies),
        ]
    )


@query(
    "finished_plans",
    """WITH d AS (SELECT o_orderkey, 's' || (o_custkey % 100) AS slug, CASE WHEN o_orderpriority = '5-LOW' THEN 'elsewhere' ELSE 'Land ' || (o_custkey % 100) END AS destination, o_orderstatus = 'F' AS req FROM orders),
t AS (SELECT 's' || s_suppkey AS slug, s_suppkey, 'Land ' || s_suppkey AS name, s_acctbal < 0 AS unverified FROM supplier),
j AS (SELECT * FROM d JOIN t USING (slug))
SELECT o_orderkey AS plan_id, 'plan' AS what, CASE WHEN NOT unverified THEN CASE WHEN req THEN 'true' ELSE 'false' END END AS detail FROM j WHERE destination = name
UNION ALL SELECT o_orderkey, 'blocked_1', 'Official guidance at n' || s_suppkey || '.gov' FROM j WHERE destination = name AND unverified
UNION ALL SELECT o_orderkey, 'rejected', destination FROM j WHERE destination <> name""",
)
def finished_plans(spark, sf):
    """Drafts turned into plans, refusals attached, wrong destinations rejected."""
    slug = F.concat(F.lit("s"), (F.col("o_custkey") % 100).cast("string"))
    name = F.concat(F.lit("Land "), (F.col("o_custkey") % 100).cast("string"))
    drafts = demo.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("plan_id"), slug.alias("slug"),
        F.when(F.col("o_orderpriority") == "5-LOW", "elsewhere").otherwise(name).alias("destination"),
        (F.col("o_orderstatus") == "F").alias("visa_required"),
    )
    supplier = demo.table(spark, sf, "supplier")
    number = F.col("s_suppkey").cast("string")
    destinations = supplier.select(
        F.concat(F.lit("s"), number).alias("slug"), F.concat(F.lit("Land "), number).alias("display_name"),
        (F.col("s_acctbal") < 0).alias("decision_is_unverified"),
    )
    unreadable = supplier.filter(F.col("s_acctbal") < 0).select(
        F.concat(F.lit("s"), number).alias("slug"), F.lit(1).alias("seq"),
        F.concat(F.lit("https://n"), number, F.lit(".gov/visa")).alias("url"),
        F.lit("Ministry").alias("authority"), F.lit("refused").alias("detail"),
    )
    plans, failures, rejected = ck.finish_plans(drafts, destinations, unreadable)
    return (
        plans.select("plan_id", F.lit("plan").alias("what"), F.col("visa_required").cast("string").alias("detail"))
        .unionByName(failures.select("plan_id", F.col("source_id").alias("what"), F.col("title").alias("detail")))
        .unionByName(
            rejected.select(F.col("entity_id").cast("long").alias("plan_id"), F.lit("rejected").alias("what"), "detail")
        )
    )


_FOLDED = """r0 AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
sr AS (SELECT 's' || l_suppkey AS slug, 'p' || l_partkey AS source_id, 'https://www.n' || (CASE WHEN p_size < 4 THEN 99 ELSE s_nationkey END) || '.gov/' || l_partkey AS url, p_size
  FROM r0 JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
ds AS (SELECT 's' || s_suppkey AS slug, s_name AS name, s_acctbal < 0 AS unverified, s_nationkey, s_suppkey FROM supplier),
cl AS (SELECT slug, source_id FROM sr WHERE p_size > 40), de AS (SELECT slug, source_id FROM sr WHERE p_size > 30 AND p_size < 45),
rq AS (SELECT slug, source_id, 1 AS place FROM cl UNION ALL SELECT slug, source_id, 2 FROM de WHERE (slug, source_id) NOT IN (SELECT slug, source_id FROM cl)),
pr AS (SELECT 's' || ps.s_suppkey AS slug, 'agent' || p_partkey || '.com' AS domain, 'p' || p_partkey AS appointed_by FROM supplier ps JOIN part ON p_partkey = ps.s_suppkey),
ap AS (SELECT * FROM pr WHERE (slug, appointed_by) IN (SELECT slug, source_id FROM sr)),
un AS (SELECT slug, 'https://n' || s_nationkey || '.gov/' || s_suppkey AS url, name || ' authority (n' || s_nationkey || '.gov)' AS authority FROM ds WHERE s_suppkey IN (SELECT user_id FROM events WHERE event_type = 'error')),
dm AS (SELECT slug, 'n' || s_nationkey || '.gov' AS domain FROM ds)"""


@query(
    "folded_destinations",
    f"""WITH {_FOLDED}
SELECT slug, 'required ' || place AS what, source_id AS detail FROM rq
UNION ALL SELECT slug, 'provider', domain FROM ap
UNION ALL SELECT slug, 'unreadable', authority FROM un
UNION ALL SELECT slug, 'source_off_trust', url FROM sr WHERE p_size < 4
UNION ALL SELECT slug, 'unverified_without_authority', 'no unreadable authority' FROM ds WHERE unverified AND slug NOT IN (SELECT slug FROM un)""",
)
def folded_destinations(spark, sf):
    """K9: corridors folded into destination configurations, which must pass the rules again."""
    from provenir.plans.fold import check_folded, fold_corridors

    supplier = demo.table(spark, sf, "supplier")
    part = demo.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    lines = demo.table(spark, sf, "lineitem")
    rows = lines.count()
    # Dealt by part, they are made distinct and meet the parts without another shuffle.
    lines = dealt(lines.filter(F.col("l_returnflag") == "R").select("l_suppkey", "l_partkey"), rows, "l_partkey").distinct()
    slug = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    host = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".gov"))
    number = F.when(F.col("p_size") < 4, "99").otherwise(F.col("s_nationkey").cast("string"))
    roles = F.array_compact(
        F.array(
            F.when(F.col("p_size") > 40, "document_checklist"),
            F.when((F.col("p_size") > 30) & (F.col("p_size") < 45), "visa_decision"),
            F.lit("fees"),
        )
    )
    source_id = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    sources = lines.join(dealt(part, rows, "l_partkey"), "l_partkey").join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        slug.alias("slug"), source_id.alias("source_id"),
        F.concat(F.lit("https://www.n"), number, F.lit(".gov/"), F.col("l_partkey").cast("string")).alias("url"),
        roles.alias("roles"),
    )
    destinations = supplier.select(
        slug.alias("slug"), F.col("s_name").alias("display_name"), (F.col("s_acctbal") < 0).alias("decision_is_unverified")
    )
    known = part.select(F.col("l_partkey").alias("s_suppkey"))
    providers = supplier.join(known, "s_suppkey").select(
        slug.alias("slug"),
        F.concat(F.lit("agent"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"),
        F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("appointed_by"),
    )
    errors = demo.table(spark, sf, "events").filter(F.col("event_type") == "error")
    refused = supplier.join(errors.select(F.col("user_id").alias("s_suppkey")).distinct(), "s_suppkey").select(
        slug.alias("slug"), F.concat(F.lit("https://"), host, F.lit("/"), F.col("s_suppkey").cast("string")).alias("url")
    )
    folded = fold_corridors(sources, destinations, providers, refused)
    broken = check_folded(folded, supplier.select(slug.alias("slug"), host.alias("domain")))
    rule = F.col("rule")
    return (
        folded["required"].select("slug", F.concat(F.lit("required "), F.col("place").cast("string")).alias("what"), F.col("source_id").alias("detail"))
        .unionByName(folded["providers"].select("slug", F.lit("provider").alias("what"), F.col("domain").alias("detail")))
        .unionByName(folded["unreadable"].select("slug", F.lit("unreadable").alias("what"), F.col("authority").alias("detail")))
        .unionByName(broken.select(F.col("entity_id").alias("slug"), rule.alias("what"), "detail"))
    )
