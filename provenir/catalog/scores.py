"""Body scores, ranking, shortlists, roles, decisions, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.catalog import demo, query, sql
from provenir.functions import text as tx, urls
from provenir.operators import audit, lexicon as lx, ranking as rk, roles as rl, scoring as sc
from provenir.operators.trust import within
from provenir.params import LOAD_BEARING_ROLES, REPORTED_ROLES, ROLES
from provenir.session import cut_lineage, small_table

LX = demo.LEXICON
_ROLE = "list_position([" + sql.strings(ROLES) + "], role)"


def _contains_any(items, text: str) -> str:
    return f"len(list_filter([{sql.strings(i.lower() for i in items)}]::VARCHAR[], lambda t: contains({text}, t))) > 0"


def _by_purpose(build) -> str:
    return "CASE " + " ".join(f"WHEN purpose = '{p}' THEN {build(p)}" for p in LX.purposes) + " END"


DOCS = f"""d0 AS (SELECT doc_id, 'https://www.' || source || '.org/' || lang || '/' || doc_id AS url, lang AS corridor, source || '.org' AS domain,
  'Page ' || lang || ' ' || split_part(text, chr(10), 1) AS title, text AS content, n_chars, {sql.case('lang', demo.PURPOSE_OF)} AS purpose FROM documents)"""
_TERMS = sql.values([(r, i, p, w) for i, (r, p, w) in enumerate(LX.terms)], "role, seq, phrase, w")
BODY = f"""{DOCS},
d1 AS (SELECT *, lower(title || chr(10) || content) AS hay, lower(title || chr(10) || translate(lower(url), '-_/.+', '     ')) AS identity FROM d0),
tm AS (SELECT * FROM {_TERMS}),
b1 AS (SELECT doc_id, role, max(w)::DOUBLE AS score FROM d1 JOIN tm ON contains(hay, phrase) GROUP BY ALL),
n1 AS (SELECT doc_id, len(list_filter([{sql.strings(LX.document_nouns)}], lambda t: contains(hay, t))) AS nouns FROM d1),
b2 AS (SELECT doc_id, role, sum(score) AS score FROM (SELECT * FROM b1 UNION ALL SELECT doc_id, 'document_checklist', least(nouns, 5) * 9.0 FROM n1 WHERE nouns >= 3) GROUP BY ALL),
f1 AS (SELECT doc_id, contains(identity, '/' || corridor || '/1') OR contains(identity, 'org ' || corridor || ' 2') AS own,
  {_by_purpose(lambda p: _contains_any(LX.own_terms(p), 'hay'))} AS pur,
  {_by_purpose(lambda p: _contains_any(LX.off_scope_for(p), 'lower(title)'))} AS off FROM d1),
b3 AS (SELECT doc_id, role, own, score + CASE WHEN own THEN 40 ELSE 0 END + CASE WHEN pur THEN 20 ELSE 0 END + CASE WHEN off THEN -30 ELSE 0 END AS score FROM b2 JOIN f1 USING (doc_id)),
b4 AS (SELECT *, count(*) FILTER (score > 0) OVER (PARTITION BY doc_id) AS breadth FROM b3),
body AS (SELECT doc_id, role, CASE WHEN breadth > 2 AND NOT own THEN score * sqrt(2.0 / breadth) ELSE score END AS score FROM b4)"""


def _bodies(spark, sf):
    docs = demo.documents(spark, sf)
    return sc.score_bodies(docs, ["corridor", "url", "domain", "doc_id"], LX)


@query("body_scores", f"WITH {BODY} SELECT doc_id, role, round(score, 4) AS score FROM body")
def body_scores(spark, sf):
    """Role scores of every page text; the trusted domains are those of all documents."""
    docs = demo.documents(spark, sf).withColumn("host", urls.host(F.col("url")))
    trusted = docs.select("domain").distinct()
    read = within(docs, "host", trusted)
    scored = sc.score_bodies(read, ["doc_id"], LX)
    return scored.select("doc_id", "role", F.round("score", 4).alias("score"))


@query("body_scores_tables", f"WITH {BODY} SELECT doc_id, role, round(score, 4) AS score FROM body")
def body_scores_tables(spark, sf):
    """The same scores from a vocabulary in tables, found by its n-gram index."""
    scored = sc.score_bodies(demo.documents(spark, sf), ["doc_id"], demo.vocabulary(spark, sf))
    return scored.select("doc_id", "role", F.round("score", 4).alias("score"))


@query(
    "document_nouns",
    f"""SELECT doc_id, array_to_string(list_filter([{sql.strings(LX.document_nouns)}], lambda t: contains(lower(text), t)), ',') AS nouns,
  regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])license($|[^\\p{{L}}\\p{{N}}_])') AS names_license, contains(lower(text), 'tion') AS has_tion FROM documents""",
)
def document_nouns(spark, sf):
    """Phrases and words a document names."""
    docs = demo.table(spark, sf, "documents")
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.array_join(sc.document_nouns(F.lower(text), LX), ",").alias("nouns"),
        tx.contains_word(text, "license").alias("names_license"),
        tx.contains_phrase(text, F.lit("TION")).alias("has_tion"),
    )


# Link scores of a document come from its URL and title, read as a link to it.
LINKSC = f"""{BODY},
k1 AS (SELECT doc_id, corridor, url, domain, role, round(sum(w), 4)::DOUBLE AS score FROM d1 JOIN tm ON contains(lower(title), phrase) GROUP BY ALL),
comb AS (SELECT corridor, url, domain, doc_id, role, round(0.4 * coalesce(k1.score, 0) + 0.6 * coalesce(body.score, 0), 4) AS score
  FROM (SELECT doc_id, role, score FROM k1) k1 FULL JOIN body USING (doc_id, role) JOIN d0 USING (doc_id)),
best AS (SELECT corridor, url, domain, doc_id, greatest(max(score), 0) AS best FROM comb GROUP BY ALL)"""


def _combined(spark, sf):
    """Combined scores, written once: every ranking query below starts from this narrow table."""
    docs = demo.documents(spark, sf)
    keys = ["corridor", "url", "domain", "doc_id"]
    terms = F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(p).alias("p"), F.lit(w).alias("w")) for r, p, w in LX.terms]
    )
    by_role = F.array(*[F.lit(r) for r in ROLES])
    title = F.lower("title")
    totals = F.transform(
        by_role,
        lambda r: F.struct(
            r.alias("role"),
            F.aggregate(
                F.filter(terms, lambda t: (t["role"] == r) & F.contains(title, t["p"])),
                F.lit(0.0), lambda acc, t: acc + t["w"],
            ).alias("score"),
        ),
    )
    link = docs.select(*keys, F.inline(F.filter(totals, lambda t: t["score"] != 0)))
    body = sc.score_bodies(docs, keys, LX)
    both = sc.combine(link, body, keys, docs, LX)
    return cut_lineage(both.select(*keys, "role", F.round("score", 4).alias("score")))


def _best(scores):
    best = F.greatest(F.max("score"), F.lit(0.0)).alias("best")
    return scores.groupBy("corridor", "url", "domain", "doc_id").agg(best)


@query(
    "role_rank",
    f"""WITH {LINKSC} SELECT corridor, role, doc_id, score, row_number() OVER (PARTITION BY corridor, role ORDER BY score DESC, url) AS place
FROM comb WHERE score > 0""",
)
def role_rank(spark, sf):
    """Every positive candidate's place within its corridor and role."""
    ranked = rk.rank_for_role(_combined(spark, sf), ["corridor"])
    return ranked.select("corridor", "role", "doc_id", "score", "place")


@query(
    "best_roles",
    f"""WITH {LINKSC}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {_ROLE}) AS k FROM comb)
SELECT doc_id, max(CASE WHEN k = 1 THEN CASE WHEN score > 0 THEN role ELSE 'irrelevant' END END) AS role,
  max(CASE WHEN k = 1 THEN CASE WHEN score > 0 THEN score ELSE 0 END END) AS score,
  coalesce(CASE WHEN max(CASE WHEN k = 1 THEN score END) > 0 THEN max(CASE WHEN k = 2 THEN score END) ELSE max(CASE WHEN k = 1 THEN score END) END, 0) AS runner_up
FROM r GROUP BY doc_id""",
)
def best_roles(spark, sf):
    """best role and runner-up of every document."""
    return sc.best_role(_combined(spark, sf), ["doc_id"], LX)


@query(
    "merge_candidates",
    """WITH c AS (SELECT d.doc_id, source || '/' || lang || '/' || (n_chars // 10) AS url, lang AS corridor, n_chars % 100 AS best, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT corridor, url, (best * 7) % 100 AS best, doc_id AS seq, 'search' AS found_by, 0 AS pref FROM c WHERE quality IS NOT NULL
  UNION ALL SELECT corridor, url, best, doc_id, 'crawl', 1 FROM c WHERE quality IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY corridor, url ORDER BY best DESC, pref, seq) AS k FROM a)
SELECT corridor, url, best::BIGINT AS best, seq, found_by FROM r WHERE k = 1""",
)
def merge_candidates(spark, sf):
    """Labelled documents as search candidates, the others as crawled ones."""
    docs = demo.table(spark, sf, "documents").join(
        demo.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    rows = docs.select(
        F.col("lang").alias("corridor"),
        F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 10).cast("string")).alias("url"),
        (F.col("n_chars") % 100).alias("best"),
        F.col("doc_id").alias("seq"),
        "quality",
    )
    found = rows.filter(F.col("quality").isNotNull()).withColumn("best", (F.col("best") * 7) % 100)
    crawled = rows.filter(F.col("quality").isNull())
    merged = rk.merge_candidates(found.drop("quality"), crawled.drop("quality"), ["corridor"])
    return merged.select("corridor", "url", F.col("best").cast("long").alias("best"), "seq", "found_by")


SHORT = f"""{LINKSC},
rr AS (SELECT *, row_number() OVER (PARTITION BY corridor, role ORDER BY score DESC, url) AS k FROM comb WHERE score > 0),
aa AS (SELECT DISTINCT corridor, url FROM rr WHERE k <= 3),
na AS (SELECT corridor, count(*) AS n FROM aa GROUP BY corridor),
bf AS (SELECT b.corridor, b.url, row_number() OVER (PARTITION BY b.corridor ORDER BY best DESC, b.url) AS k FROM best b LEFT JOIN aa USING (corridor, url) WHERE best > 0 AND aa.url IS NULL),
bb AS (SELECT corridor, url FROM aa UNION ALL SELECT corridor, url FROM bf LEFT JOIN na USING (corridor) WHERE k <= 25 - coalesce(n, 0)),
rs AS (SELECT corridor, url FROM (SELECT corridor, url, row_number() OVER (PARTITION BY corridor, domain ORDER BY best DESC, url) AS k FROM best WHERE best > 0) WHERE k <= 1),
cc AS (SELECT corridor, url, max(res) AS res FROM (SELECT corridor, url, 0 AS res FROM bb UNION ALL SELECT corridor, url, 1 FROM rs) GROUP BY ALL),
ct AS (SELECT cc.*, best, row_number() OVER (PARTITION BY cc.corridor ORDER BY res DESC, best DESC, cc.url) AS k FROM cc JOIN best USING (corridor, url)),
sl AS (SELECT corridor, url, best, row_number() OVER (PARTITION BY corridor ORDER BY best DESC, url) AS place FROM ct WHERE k <= 25)"""


@query("shortlist_reserved", f"WITH {SHORT} SELECT corridor, url, best, place FROM sl")
def shortlist_reserved(spark, sf):
    """The shortlist of every corridor, with a place reserved per domain."""
    scores = _combined(spark, sf)
    best = _best(scores)
    kept = rk.shortlist(best, scores, ["corridor"])
    return kept.select("corridor", "url", "best", F.col("place").cast("long").alias("place"))


@query(
    "readable_shortlist",
    """WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS outcome FROM events GROUP BY user_id),
c AS (SELECT doc_id, lang AS corridor, 'https://' || source || '.org/' || (doc_id % 200) AS url, (doc_id % 200)::BIGINT AS k, source FROM documents)
SELECT doc_id, url FROM c WHERE k NOT IN (SELECT user_id FROM e WHERE outcome = 'error') AND source NOT IN ('src3', 'src7')""",
)
def readable_shortlist(spark, sf):
    """Candidates minus refused URLs and dead hosts; other failures stay."""
    events = demo.table(spark, sf, "events")
    last = events.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome")
    )
    docs = demo.table(spark, sf, "documents").select(
        "doc_id", "source", (F.col("doc_id") % 200).alias("user_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".org/"), (F.col("doc_id") % 200).cast("string")).alias("url"),
    )
    refused = last.filter(F.col("outcome") == "error")
    blocked = docs.join(refused, "user_id", "left_semi").select("url").distinct()
    dead = small_table(spark, [("src3.org",), ("src7.org",)], "host string")
    return rk.readable_only(docs, blocked, dead).select("doc_id", "url")


ASSIGN = f"""{LINKSC},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corridor, role ORDER BY score DESC, url) AS k FROM comb WHERE score >= 45) WHERE k = 1),
asg AS (SELECT corridor, url, string_agg(role, ',' ORDER BY {_ROLE}) AS roles, round(max(score), 1) AS score FROM w GROUP BY ALL)"""


@query("assign_roles", f"WITH {ASSIGN} SELECT corridor, url, roles, score FROM asg")
def assign_roles(spark, sf):
    """The pages that fill the roles of every corridor."""
    scores = _combined(spark, sf).withColumn("signals", F.array(F.concat_ws(":", "role", "url")))
    won = rl.assign_roles(scores, ["corridor"], ROLES, 45.0)
    return won.select("corridor", "url", F.array_join("roles", ",").alias("roles"), "score")


@query(
    "corridor_results",
    f"""WITH {ASSIGN},
co AS (SELECT DISTINCT corridor FROM d0 UNION ALL SELECT 'zz'),
fl AS (SELECT corridor, role FROM w),
un AS (SELECT corridor, role FROM (SELECT corridor, unnest([{sql.strings(REPORTED_ROLES)}]) AS role FROM co) a WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.corridor = a.corridor AND fl.role = a.role)),
ua AS (SELECT corridor, string_agg(role, ',' ORDER BY role) AS unresolved, string_agg('no page scored high enough to be the ' || replace(role, '_', ' '), '; ' ORDER BY role) AS notes FROM un GROUP BY corridor),
sr AS (SELECT corridor, count(DISTINCT url) AS sources, bool_or(role = 'visa_decision') AS decided FROM w GROUP BY corridor),
bl AS (SELECT corridor, count(*) AS blocking FROM (SELECT DISTINCT corridor, url FROM comb WHERE role = 'visa_decision' AND score > 0 AND doc_id IN (SELECT user_id FROM events WHERE event_type = 'error')) GROUP BY corridor),
j AS (SELECT corridor, coalesce(sources, 0) AS sources, coalesce(decided, false) AS decided, coalesce(unresolved, '') AS unresolved, coalesce(notes, '') AS notes, coalesce(blocking, 0) AS blocking_urls
  FROM co LEFT JOIN sr USING (corridor) LEFT JOIN ua USING (corridor) LEFT JOIN bl USING (corridor)),
u AS (SELECT *, decided OR (blocking_urls > 0 AND sources > 0) AS usable FROM j)
SELECT corridor, sources, blocking_urls, unresolved, usable, NOT decided AND blocking_urls > 0 AS decision_is_unverified,
  CASE WHEN corridor = 'fr' THEN 'the run raised before it finished' WHEN sources = 0 THEN 'refused: a load-bearing role has no page' WHEN unresolved <> '' THEN 'resolved, with no ' || replace(unresolved, ',', ', ') ELSE 'resolved' END AS outcome
FROM u""",
)
def corridor_results(spark, sf):
    """One row per corridor, refused ones included."""
    scores = _combined(spark, sf).withColumn("signals", F.array("role"))
    corridors = scores.select("corridor").distinct()
    corridors = corridors.unionByName(small_table(spark, [("zz",)], "corridor string"))
    by = ["corridor"]
    won = rl.best_per_role(scores, by, 45.0)
    sources = rl.assign_roles(scores, by, ROLES, 45.0)
    unresolved = rl.unresolved_roles(corridors, won, by)
    refused = demo.table(spark, sf, "events").filter(F.col("event_type") == "error")
    settled = scores.join(refused.select(F.col("user_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    blocking = rl.decision_blocking(scores, settled.select("url").distinct(), by, "visa_decision")
    counts = scores.groupBy("corridor").agg(F.count("*").alias("scored"))
    rows = rl.corridor_results(corridors, sources, unresolved, blocking, by, LOAD_BEARING_ROLES, counts)
    # One corridor's run ended in an error.
    outcome = audit.run_outcome(
        F.col("corridor") != "fr", F.col("sources"), F.col("unresolved"), F.element_at("notes", -1)
    )
    return rows.select(
        "corridor", F.col("sources").cast("long").alias("sources"),
        F.col("blocking_urls").cast("long").alias("blocking_urls"),
        F.array_join("unresolved", ",").alias("unresolved"), "usable", "decision_is_unverified",
        outcome.alias("outcome"),
    )


_CHOICE = f"""cv AS (SELECT conv_id, turn, CASE WHEN length(text) % 7 = 6 THEN 'unheard_of' ELSE [{sql.strings(ROLES)}][length(text) % 7 + 1] END AS role,
  CASE WHEN length(text) % 5 = 0 THEN NULL ELSE 'd' || (length(text) % 4) END AS source_id, chr(9) || ' ' || text || chr(10) AS reason FROM conversations),
cd AS (SELECT DISTINCT conv_id, 'd' || (turn % 3) AS source_id FROM conversations),
jj AS (SELECT cv.*, CASE WHEN role = 'unheard_of' THEN 'unknown role' WHEN cv.source_id IS NULL THEN 'refused' WHEN cd.source_id IS NULL THEN 'not a candidate' END AS cause FROM cv LEFT JOIN cd ON cd.conv_id = cv.conv_id AND cd.source_id = cv.source_id),
vv AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM jj WHERE cause IS NULL)"""


def _choices(spark, sf):
    talk = demo.table(spark, sf, "conversations")
    n = F.length("text")
    roles = F.array(*[F.lit(r) for r in ROLES], F.lit("unheard_of"))
    choices = talk.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.get(roles, n % 7).alias("role"),
        F.when(n % 5 != 0, F.concat(F.lit("d"), (n % 4).cast("string"))).alias("source_id"),
        F.concat(F.lit("\t "), "text", F.lit("\n")).alias("reason"),
    )
    candidates = talk.select(
        "conv_id", F.concat(F.lit("d"), (F.col("turn") % 3).cast("string")).alias("source_id")
    ).distinct()
    return choices, candidates


@query(
    "validate_choices",
    f"""WITH {_CHOICE}
SELECT conv_id, turn AS seq, role, source_id, 'kept' AS verdict FROM vv WHERE k = 1
UNION ALL SELECT conv_id, turn, role, source_id, 'answered more than once' FROM vv WHERE k > 1
UNION ALL SELECT conv_id, turn, role, source_id, cause FROM jj WHERE cause IS NOT NULL AND cause <> 'refused'""",
)
def validate_choices(spark, sf):
    """Supplied decisions, kept or discarded with the reason."""
    choices, candidates = _choices(spark, sf)
    kept, discarded = rl.validate_choices(choices, candidates, ["conv_id"], ROLES)
    columns = ["conv_id", "seq", "role", "source_id"]
    return kept.select(*columns, F.lit("kept").alias("verdict")).unionByName(
        discarded.select(*columns, F.col("cause").alias("verdict"))
    )


@query(
    "sources_from_choices",
    f"""WITH {_CHOICE}, k AS (SELECT *, 'https://h/2013' || lpad((conv_id % 14)::VARCHAR, 2, '0') || '/' || source_id AS url, substring(regexp_replace(reason, '^\\s+|\\s+$', '', 'g'), 1, 160) AS r FROM vv WHERE k = 1),
g AS (SELECT conv_id, url, string_agg(role, ',' ORDER BY {_ROLE}) AS roles,
  list_distinct(list(r)) AS rs, list(r ORDER BY {_ROLE}) AS ordered FROM k GROUP BY ALL)
SELECT conv_id, url, roles, least(6, CASE WHEN conv_id % 14 BETWEEN 1 AND 12 THEN 1 ELSE 0 END + len(list_filter(rs, lambda x: x <> '')))::BIGINT AS signals,
  CASE WHEN conv_id % 14 BETWEEN 1 AND 12 THEN 'published in path: 2013-' || lpad((conv_id % 14)::VARCHAR, 2, '0') ELSE ordered[1] END AS first_signal FROM g""",
)
def sources_from_choices(spark, sf):
    """pages named by valid decisions, with the dates their paths name."""
    choices, candidates = _choices(spark, sf)
    month = F.lpad((F.col("conv_id") % 14).cast("string"), 2, "0")
    linked = candidates.withColumn(
        "url", F.concat(F.lit("https://h/2013"), month, F.lit("/"), F.col("source_id"))
    )
    kept, _ = rl.validate_choices(choices, candidates, ["conv_id"], ROLES)
    rows = rl.sources_from_choices(kept, linked, ["conv_id"], ROLES)
    return rows.select(
        "conv_id", "url", F.array_join("roles", ",").alias("roles"),
        F.size("signals").cast("long").alias("signals"), F.get("signals", F.lit(0)).alias("first_signal"),
    )


@query(
    "considered_audit",
    f"""WITH {SHORT}, ft AS (SELECT doc_id FROM labels),
p AS (SELECT b.corridor, b.url, b.doc_id, b.best, row_number() OVER (PARTITION BY b.corridor ORDER BY b.best DESC, b.url) AS position, sl.url IS NOT NULL AS shortlisted,
  sl.url IS NOT NULL AND ft.doc_id IS NOT NULL AS fetched FROM best b LEFT JOIN sl ON sl.corridor = b.corridor AND sl.url = b.url LEFT JOIN ft USING (doc_id))
SELECT corridor, url, best, position, shortlisted, fetched FROM p""",
)
def considered_audit(spark, sf):
    """Every candidate considered, with its position and how far it came."""
    records = _considered(spark, sf)
    return records.select("corridor", "url", "best", "position", "shortlisted", "fetched")


def _considered(spark, sf):
    scores = _combined(spark, sf)
    best = cut_lineage(_best(scores))
    short = rk.shortlist(best, scores, ["corridor"]).select("corridor", "url", "doc_id")
    fetched = short.join(demo.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return audit.considered(best, short, fetched, ["corridor"])


@query(
    "miss_classifier",
    f"""WITH {SHORT}, ft AS (SELECT doc_id FROM labels),
p AS (SELECT b.corridor, b.url, CASE WHEN sl.url IS NOT NULL AND ft.doc_id IS NOT NULL THEN 3 WHEN sl.url IS NOT NULL THEN 2 ELSE 1 END AS stage
  FROM best b LEFT JOIN sl ON sl.corridor = b.corridor AND sl.url = b.url LEFT JOIN ft USING (doc_id)),
a AS (SELECT DISTINCT lang AS corridor, source || '.org/' || CASE lang WHEN 'en' THEN 'en/1' WHEN 'de' THEN 'de' ELSE 'xx' END AS fragment FROM documents),
m AS (SELECT a.corridor, a.fragment, max(stage) AS stage, count(p.url) AS matches FROM a LEFT JOIN p ON p.corridor = a.corridor AND contains(p.url, a.fragment) GROUP BY ALL)
SELECT corridor, fragment, matches, CASE stage WHEN 3 THEN 'fetched' WHEN 2 THEN 'shortlisted, not read' WHEN 1 THEN 'ranked out' ELSE 'never seen' END AS verdict FROM m""",
)
def miss_classifier(spark, sf):
    """For every asked URL fragment, where its pages were lost."""
    tail = demo.mapped(F.col("lang"), {"en": "en/1", "de": "de"}, "xx")
    asks = demo.table(spark, sf, "documents").select(
        F.col("lang").alias("corridor"), F.concat(F.col("source"), F.lit(".org/"), tail).alias("fragment")
    ).distinct()
    found = audit.classify_misses(asks, _considered(spark, sf), ["corridor"])
    return found.select("corridor", "fragment", F.col("matches").cast("long").alias("matches"), "verdict")
