"""Links, titles, candidates from links, crawl policies, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.catalog import demo, query, sql
from provenir.functions import text as tx, urls
from provenir.operators import expansion, lexicon as lx, policies as pol
from provenir.operators import pages as pg
from provenir.operators.ranking import first_of, host_budget
from provenir.operators.trust import own_missions
from provenir.params import LIMITS
from provenir.session import cut_lineage, small_table

P = sql.PAGES


@query(
    "links",
    f"WITH {sql.LINKS} SELECT page_id, pos, url, text, heading, count(*) OVER (PARTITION BY page_id) AS found FROM lnk QUALIFY pos < 4",
)
def links(spark, sf):
    """The first four links of every page in document order, and how many it has."""
    return pg.extract_links(demo.pages(spark, sf), maximum=4).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "url", "text", "heading", F.col("found").cast("long").alias("found")
    )


@query(
    "all_links",
    f"WITH {sql.LINKS} SELECT page_id, pos, url, text, heading FROM lnk",
)
def all_links(spark, sf):
    """All links of every page in document order."""
    return pg.extract_links(demo.pages(spark, sf), maximum=None).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "url", "text", "heading"
    )


@query(
    "titles",
    f"""WITH {sql.links(sql.decode_all)}, f AS (SELECT page_id, url, {sql.page_title('html', sql.decode_all)} AS title FROM p),
l AS (SELECT page_id, text FROM lnk WHERE pos = 0),
j AS (SELECT f.page_id, coalesce(CASE WHEN {sql.lang('url')} IN ('en', 'fr') THEN nullif(title, '') END, text) AS title FROM f LEFT JOIN l USING (page_id)),
c AS (SELECT *, trim(split_part(title, '|', 1)) AS h1, trim(split_part(title, '—', 1)) AS h2, trim(split_part(title, ' - ', 1)) AS h3 FROM j)
SELECT page_id, title, CASE WHEN coalesce(title, '') = '' THEN 'page ' || page_id
  WHEN contains(title, '|') AND length(h1) >= 8 THEN substring(h1, 1, 90)
  WHEN contains(title, '—') AND length(h2) >= 8 THEN substring(h2, 1, 90)
  WHEN contains(title, ' - ') AND length(h3) >= 8 THEN substring(h3, 1, 90) ELSE substring(title, 1, 90) END AS clean FROM c""",
)
def titles(spark, sf):
    """Page titles, back-filled from the link text, tidied."""
    pages = demo.pages(spark, sf)
    first = demo.links(spark, sf).filter(F.col("pos") == 0).select("page_id", "text")
    fetched = pages.select(
        "page_id",
        F.when(demo.lang_of(F.col("url")).isin("en", "fr"), pg.page_title(F.col("html"))).alias("page_title"),
    )
    own = F.lit(None).cast("string")
    joined = fetched.join(first, "page_id", "left")
    filled = F.coalesce(own, F.nullif("page_title", F.lit("")), F.col("text"))
    return joined.select(
        "page_id",
        filled.alias("title"),
        tx.clean_title(filled, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("clean"),
    )


@query(
    "hit_reader",
    f"""WITH {P}, a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>.*?</a\\s*>', 1) AS hrefs FROM p),
x AS (SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS rank FROM a)
SELECT page_id, rank, {sql.decode('href')} AS url, CASE WHEN length({sql.decode('href')}) % 3 = 1 THEN '' ELSE {sql.decode('href')} || '!' END AS title, '' AS snippet
FROM x WHERE length({sql.decode('href')}) > 3""",
)
def hit_reader(spark, sf):
    """A1: search responses read into hits; ranks keep the gaps of dropped entries."""
    from provenir.sources.readers import read_search_responses

    attributes = F.regexp_extract_all("html", F.lit(r"(?is)<a\b([^>]*)>.*?</a\s*>"), F.lit(1))
    entries = F.transform(
        F.transform(attributes, pg._href),
        lambda h: F.struct(
            F.when(F.length(h) > 3, h).alias("url"),
            F.when(F.length(h) % 3 != 1, F.concat(h, F.lit("!"))).alias("title"),
        ),
    )
    payload = F.to_json(F.struct(F.struct(entries.alias("results")).alias("web")))
    responses = demo.pages(spark, sf).select(
        "page_id", F.col("page_id").cast("string").alias("query"), F.lit(0).alias("query_seq"), payload.alias("body")
    )
    return read_search_responses(responses, ["page_id"]).select(
        "page_id", F.col("rank").cast("long").alias("rank"), "url", "title", "snippet"
    )


@query(
    "query_templates",
    f"""WITH b AS (SELECT n_name AS name, unnest(['{{}} visa official government', '{{}} embassy visa application', '{{}} immigration authority official', '{{}} ministry of foreign affairs visa']) AS t, unnest([0, 1, 2, 3]) AS query_seq FROM nation),
d AS (SELECT n_name AS name, n_nationkey AS k, unnest([{sql.strings(demo.TRUSTED)}]) AS domain, unnest([0, 1, 2]) AS ds FROM nation),
s AS (SELECT name, k, domain, ds, unnest([0, 1, 2]) AS ts FROM d)
SELECT name, 'bootstrap' AS stage, query_seq, replace(t, '{{}}', name) AS query FROM b
UNION ALL SELECT name, 'corridor', ds * 3 + ts, CASE ts WHEN 0 THEN 'site:' || domain || ' ' || name || ' visa requirements NATION_0'
  WHEN 1 THEN 'site:' || domain || ' tourism visa documents required' ELSE 'site:' || domain || ' visa application NATION_1' END FROM s""",
)
def query_templates(spark, sf):
    """Search queries per country, and per corridor and trusted domain."""
    from provenir.sources.readers import bootstrap_queries, corridor_queries

    nations = demo.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    corridors = nations.select(
        "name",
        F.lit("NATION_0").alias("nationality"),
        F.lit("NATION_1").alias("residence"),
        F.lit("tourism").alias("purpose"),
        F.array(*[F.lit(d) for d in demo.TRUSTED]).alias("trusted"),
    )
    first = bootstrap_queries(nations).withColumn("stage", F.lit("bootstrap"))
    second = corridor_queries(corridors, ["name"]).withColumn("stage", F.lit("corridor"))
    return first.select("name", "stage", "query_seq", "query").unionByName(
        second.select("name", "stage", "query_seq", "query")
    )


_LX = demo.LEXICON
_WORDS = sql.values([(f"N{i}", f"NATION_{i}", i, w) for i, w in enumerate(demo.WORDS)], "code, name, seq, word")


def _link_rows(spark, sf):
    """Links as candidates: heading from the page, purpose and country from its language."""
    heading = F.when(F.col("heading") == "", F.col("page_heading")).otherwise(F.col("heading"))
    return demo.links(spark, sf).select(
        "page_id",
        F.col("pos").cast("long").alias("pos"),
        "url",
        "host",
        "text",
        heading.alias("heading"),
        (F.col("pos") % 3).cast("int").alias("depth"),
        "lang",
        demo.mapped(F.col("lang"), demo.PURPOSE_OF).alias("purpose"),
        F.concat(F.lit("N"), (demo.lang_seq(F.col("lang")) - 1).cast("string")).alias("nationality"),
        F.lit("N24").alias("applying_from"),
    )


_LINK_ROWS = f"""{sql.LINKS}, ph AS (SELECT page_id AS pid, {sql.page_title('html')} AS page_heading FROM p),
lr AS (SELECT page_id, pos, url, text, CASE WHEN heading = '' THEN page_heading ELSE heading END AS heading,
  pos % 3 AS depth, {sql.lang('src_page')} AS lang, {sql.segments('url')} AS segs, {sql.host('url')} AS host,
  translate(lower(url), '-_/.+', '     ') AS u FROM lnk JOIN ph ON page_id = pid),
lp AS (SELECT *, {sql.case('lang', demo.PURPOSE_OF)} AS purpose, 'N' || ({sql.lang_seq('lang')} - 1) AS nationality FROM lr),
wd AS (SELECT * FROM {_WORDS}),
lm AS (SELECT DISTINCT page_id, pos, code, name, seq, in_host AND NOT in_text AND NOT in_path AS host_only FROM (
  SELECT page_id, pos, code, name, seq,
    list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), [word, 'src' || seq, 'nation_' || seq]) AS in_text,
    len(list_filter(segs, lambda s: list_has_any(list_append(string_split(s, '-'), s), [word, 'src' || seq, 'nation_' || seq]))) > 0 AS in_path,
    list_contains(string_split(host, '.'), word || 'x') AS in_host
  FROM lp CROSS JOIN wd) WHERE in_text OR in_path OR in_host)"""


def _first_in(items, text: str, any_of: bool = False) -> str:
    return f"list_filter([{sql.strings(i.lower() for i in items)}], lambda t: contains({text}, t))[1]"


_HARD = "CASE " + " ".join(
    f"WHEN purpose = '{p}' THEN {_first_in(_LX.hard_off_scope_for(p), 'hay')}" for p in _LX.purposes
) + " END"


_REJECTED = f"""WITH {_LINK_ROWS},
a AS (SELECT *, lower(text || ' ' || heading || ' ' || u) AS hay FROM lp),
b AS (SELECT *, len(list_filter(segs, lambda x: regexp_matches(x, '^[0-9]{{4}}$') AND x >= '1990' AND x <= '2024')) > 0
    OR list_has_any(segs, [{sql.strings(_LX.archive)}]) AS archived,
  list_has_any(segs, [{sql.strings(_LX.boilerplate)}]) AS furniture, {_HARD} AS hard FROM a),
f AS (SELECT page_id, pos, arg_min(lm.name, lm.seq) AS foreign_name FROM lm JOIN lp USING (page_id, pos)
  WHERE lm.code NOT IN ('N24', nationality) GROUP BY ALL)
SELECT page_id, pos, CASE WHEN archived THEN 'archived' WHEN furniture THEN 'site furniture'
  WHEN hard IS NOT NULL THEN 'for another audience: ' || hard
  WHEN foreign_name IS NOT NULL THEN 'about another country: ' || foreign_name END AS rejected
FROM b LEFT JOIN f USING (page_id, pos)"""


def _rejected(spark, sf, lexicon):
    judged = lx.reject_links(
        _link_rows(spark, sf), ["page_id", "pos"], lexicon, demo.countries(spark, sf), ["nationality", "applying_from"]
    )
    return judged.select("page_id", "pos", "rejected")


@query("reject_cascade", _REJECTED)
def reject_cascade(spark, sf):
    """Every link with its reject reason, if it has one."""
    return _rejected(spark, sf, _LX)


@query("reject_cascade_tables", _REJECTED)
def reject_cascade_tables(spark, sf):
    """The same reasons from a vocabulary in tables."""
    return _rejected(spark, sf, demo.vocabulary(spark, sf))


_TERMS = sql.values([(r, i, p, w) for i, (r, p, w) in enumerate(_LX.terms)], "role, seq, phrase, w")


def _shared(items_by_purpose, text: str = None) -> str:
    return "CASE " + " ".join(
        f"WHEN purpose = '{p}' THEN len(list_filter([{sql.strings(i.lower() for i in items)}]::VARCHAR[], "
        f"lambda t: contains(u, t) OR contains(anchor, t))) > 0"
        for p, items in items_by_purpose.items()
    ) + " END"


_LINK_SCORE = f"""{_LINK_ROWS},
c0 AS (SELECT *, lower(trim(text)) AS label, lower(trim(heading)) AS head,
  trim(lower(trim(text)) || ' ' || lower(trim(heading))) AS anchor FROM lp),
tm AS (SELECT * FROM {_TERMS}),
base AS (SELECT page_id, pos, role, sum(CASE WHEN contains(u, phrase) THEN w ELSE 0 END
    + CASE WHEN label <> '' AND contains(label, phrase) THEN w * 1.2 WHEN head <> '' AND contains(head, phrase) THEN w * 0.5 ELSE 0 END)::DOUBLE AS score
  FROM c0 CROSS JOIN tm GROUP BY ALL HAVING score <> 0),
flag AS (SELECT c0.*, contains(u, 'th') OR contains(anchor, 'th') AS topic,
  CASE {' '.join(f"WHEN purpose = '{p}' THEN label <> '' AND len(list_filter([{sql.strings(v)}], lambda t: contains(label, t))) > 0" for p, v in _LX.purposes.items())} END AS plabel,
  EXISTS (SELECT 1 FROM lm WHERE lm.page_id = c0.page_id AND lm.pos = c0.pos AND lm.code = c0.nationality AND NOT host_only) AS nat,
  {_shared(_LX.purposes)} AS own,
  {_shared({p: _LX.off_scope_for(p) for p in _LX.purposes})} AS off,
  len(list_filter([{sql.strings(_LX.form)}], lambda t: contains(u, t) OR contains(anchor, t))) > 0 AS form,
  len(list_filter([{sql.strings(_LX.language)}], lambda t: contains(anchor, t))) > 0 AS language,
  regexp_replace(coalesce(segs[-1], ''), '\\.[^.]*$', '') IN ({sql.strings(_LX.index_stems)}) AS idx,
  CASE WHEN list_contains(string_split(host, '.'), 'blog') THEN 'own'
       WHEN len(list_filter(segs, lambda s: starts_with(s, 'la-') OR starts_with(s, 'la_') OR starts_with(s, 'mission-') OR starts_with(s, 'mission_'))) > 0 THEN 'other'
       WHEN host IN ('m.ththth.net', 'm.theron.com') OR ends_with(host, '.m.ththth.net') OR ends_with(host, '.m.theron.com') THEN 'own' END AS aff
  FROM c0),
w1 AS (SELECT page_id, pos, role, score FROM base),
w2 AS (SELECT flag.page_id, flag.pos, r.role, coalesce(w1.score, 0) AS score, w1.role IS NOT NULL AS present,
   EXISTS (SELECT 1 FROM base b WHERE b.page_id = flag.page_id AND b.pos = flag.pos) AS any_role, topic, plabel
  FROM flag CROSS JOIN (SELECT DISTINCT role FROM tm) r LEFT JOIN w1 ON w1.page_id = flag.page_id AND w1.pos = flag.pos AND w1.role = r.role),
w3 AS (SELECT *, CASE WHEN role = 'visa_decision' AND topic AND (present OR NOT any_role) THEN score + 6
   WHEN role IN ('document_checklist', 'application_route') AND NOT present AND plabel THEN 18 ELSE score END AS s2,
   present OR (role = 'visa_decision' AND topic AND NOT any_role) OR (role IN ('document_checklist', 'application_route') AND plabel) AS kept FROM w2),
fin AS (SELECT page_id, pos, flag.url, flag.text, w3.role, s2
   + CASE WHEN nat THEN 40 ELSE 0 END + CASE WHEN own THEN 20 ELSE 0 END + CASE WHEN off THEN -30 ELSE 0 END
   + CASE WHEN form THEN -35 ELSE 0 END + CASE WHEN language THEN -25 ELSE 0 END + CASE WHEN idx THEN -18 ELSE 0 END
   + CASE WHEN len(segs) <= 4 THEN 8 ELSE 0 END + depth * -10
   + CASE WHEN w3.role IN ('document_checklist', 'application_route') THEN CASE aff WHEN 'own' THEN 30 WHEN 'other' THEN -45 ELSE 0 END ELSE 0 END
   + CASE WHEN w3.role = 'document_checklist' AND ends_with(lower(url), '.pdf') THEN 10 ELSE 0 END AS score
  FROM w3 JOIN flag USING (page_id, pos) WHERE kept)"""


def link_scores_of(spark, sf, lexicon=_LX):
    from provenir.operators import scoring

    rows = _link_rows(spark, sf)
    keys = ["page_id", "pos"]
    about = lx.country_mentions(rows, keys, demo.countries(spark, sf), by_host=False)
    named = about.select(*keys, F.col("code").alias("nationality"), F.lit(True).alias("_about"))
    ready = (
        rows.join(named, [*keys, "nationality"], "left")
        .withColumn("describes_nationality", F.coalesce("_about", F.lit(False)))
        .withColumn(
            "affinity",
            lx.mission_affinity(F.col("url"), F.array(F.lit("blog")), _LX.mission_markers),
        )
    )
    ready = ready.withColumn("slug", F.lit("d")).withColumn("residence", F.lit("R"))
    if "host" not in ready.columns:
        ready = ready.withColumn("host", urls.host(F.col("url")))
    sources = small_table(spark, [("d", "www.m.ththth.net"), ("d", "M.theron.com"), ("e", "m.ththor.net"), ("d", "ththor.net")], "slug string, host string")
    residences = small_table(spark, [("R", ["M"])], "code string, host_labels array<string>")
    return scoring.score_links(own_missions(ready, sources, residences, "residence"), keys, lexicon)


@query(
    "link_scores",
    f"WITH {_LINK_SCORE} SELECT page_id, pos, role, round(score, 4) AS score FROM fin",
)
def link_scores(spark, sf):
    """Role scores of every link."""
    return link_scores_of(spark, sf).select("page_id", "pos", "role", F.round("score", 4).alias("score"))


@query(
    "link_scores_tables",
    f"WITH {_LINK_SCORE} SELECT page_id, pos, role, round(score, 4) AS score FROM fin",
)
def link_scores_tables(spark, sf):
    """The same scores from a vocabulary in tables, found by its n-gram index."""
    scored = link_scores_of(spark, sf, demo.vocabulary(spark, sf))
    return scored.select("page_id", "pos", "role", F.round("score", 4).alias("score"))


_SIGNED = sql.values(
    [(r, i, p, f"{w:g}", f"{w * 1.2:g}", f"{w * 0.5:g}") for i, (r, p, w) in enumerate(_LX.terms)], "role, seq, phrase, plain, txt, hd"
)


def _first_hit(items, texts: str = "contains(u, t) OR contains(anchor, t)") -> str:
    return f"list_filter([{sql.strings(i.lower() for i in items)}]::VARCHAR[], lambda t: {texts})[1]"


_LINK_SIGNALS = f"""{_LINK_SCORE},
sv AS (SELECT * FROM {_SIGNED}),
sb AS (SELECT page_id, pos, role, string_agg(concat_ws('; ', CASE WHEN contains(u, phrase) THEN 'url:' || phrase || '+' || plain END,
    CASE WHEN label <> '' AND contains(label, phrase) THEN 'text:' || phrase || '+' || txt WHEN head <> '' AND contains(head, phrase) THEN 'heading:' || phrase || '+' || hd END), '; ' ORDER BY seq) AS base
  FROM c0 CROSS JOIN sv WHERE contains(u, phrase) OR contains(label, phrase) OR contains(head, phrase) GROUP BY ALL),
sf0 AS (SELECT flag.*, {" ".join(["CASE"] + [f"WHEN purpose = '{p}' THEN {_first_hit(_LX.off_scope_for(p))}" for p in _LX.purposes] + ["END"])} AS off_hit,
  {_first_hit(_LX.form)} AS form_hit, {_first_hit(_LX.language, 'contains(anchor, t)')} AS language_hit FROM flag),
sg AS (SELECT page_id, pos, w3.role, concat_ws('; ', CASE WHEN present THEN base END,
  CASE WHEN w3.role = 'visa_decision' AND w3.topic AND (present OR NOT any_role) THEN 'mentions-th+6' END,
  CASE WHEN w3.role IN ('document_checklist', 'application_route') AND NOT present AND w3.plabel THEN 'purpose-label:' || purpose || '+18' END,
  CASE WHEN nat THEN 'nationality:' || nationality || '+40' END, CASE WHEN own THEN 'purpose:' || purpose || '+20' END,
  CASE WHEN off THEN 'off-scope:' || off_hit || '-30' END, CASE WHEN form THEN 'form:' || form_hit || '-35' END,
  CASE WHEN language THEN 'translation:' || language_hit || '-25' END, CASE WHEN idx THEN 'section-index-18' END,
  CASE WHEN len(segs) <= 4 THEN 'shallow+8' END, CASE WHEN depth > 0 THEN 'depth' || depth || (depth * -10) END,
  CASE WHEN w3.role IN ('document_checklist', 'application_route') THEN CASE aff WHEN 'own' THEN 'mission+30' WHEN 'other' THEN 'other-mission-45' END END,
  CASE WHEN w3.role = 'document_checklist' AND ends_with(lower(url), '.pdf') THEN 'pdf+10' END) AS signals
  FROM w3 JOIN sf0 USING (page_id, pos) LEFT JOIN sb USING (page_id, pos, role) WHERE kept)"""


@query("link_signals", f"WITH {_LINK_SIGNALS} SELECT page_id, pos, role, signals FROM sg")
def link_signals(spark, sf):
    """the signals behind every link score, in order."""
    return link_scores_of(spark, sf).select(
        "page_id", "pos", "role", F.array_join("signals", "; ").alias("signals")
    )


@query(
    "host_budgets",
    f"""WITH {P}, ph AS (SELECT {sql.lang('url')} AS corridor, {sql.host('url')} AS phost FROM p)
SELECT corridor, count(DISTINCT phost) AS seed_hosts, CASE WHEN count(DISTINCT phost) > 1 THEN least(20, greatest(4, 40 // count(DISTINCT phost))) ELSE 20 END AS budget
FROM ph GROUP BY corridor""",
)
def host_budgets(spark, sf):
    """Pages that one host of a corridor may take."""
    pages = demo.pages(spark, sf).select(
        demo.lang_of(F.col("url")).alias("corridor"), urls.host(F.col("url")).alias("host")
    )
    return host_budget(pages, ["corridor"]).select(
        "corridor", F.col("seed_hosts").cast("long").alias("seed_hosts"), F.col("budget").cast("long").alias("budget")
    )


_BODY = """'# policy of page ' || page_id || chr(10) || chr(9) || 'Disallow: /stray' || chr(10) || 'User-agent: ' || CASE WHEN page_id % 3 = 0 THEN 'Demo' ELSE '*' END || chr(10)
 || chr(9) || 'Disallow:' || chr(9) || '/' || hrefs[1] || ' ' || chr(9) || '# first' || chr(10) || 'Disallow:' || chr(10) || 'Allow: /*a$' || chr(10)
 || 'User-Agent: other' || chr(10) || 'User-agent: *' || chr(10) || 'disallow : /th*e' || chr(10) || 'Allow: /the' || chr(10) || 'Disallow: /' || hrefs[2] || '$'"""


def _bodies(spark, sf):
    """One policy body per host, written from the first page of the host and its links."""
    rows = demo.pages(spark, sf).withColumn("origin", urls.origin(F.col("url")))
    targets = F.transform(
        F.regexp_extract_all("html", F.lit('(?is)<a\\b[^>]*href="/([^"]*)"'), F.lit(1)), lambda h: h
    )
    listed = rows.select("origin", "page_id", targets.alias("hrefs"))
    first = first_of(listed, ["origin"], [F.col("page_id")])
    named = F.when(F.col("page_id") % 3 == 0, "Demo").otherwise("*")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# policy of page "), F.col("page_id").cast("string")),
        F.lit("\tDisallow: /stray"),
        F.concat(F.lit("User-agent: "), named),
        F.concat(F.lit("\tDisallow:\t/"), F.get("hrefs", F.lit(0)), F.lit(" \t# first")),
        F.lit("Disallow:"),
        F.lit("Allow: /*a$"),
        F.lit("User-Agent: other"),
        F.lit("User-agent: *"),
        F.lit("disallow : /th*e"),
        F.lit("Allow: /the"),
        F.concat(F.lit("Disallow: /"), F.get("hrefs", F.lit(1)), F.lit("$")),
    )
    page = F.col("page_id")
    status = F.when(page % 7 == 1, 404).when(page % 11 == 2, 503).otherwise(200)
    size = F.when(page % 13 == 3, LIMITS.policy_bytes + 1).otherwise(F.length("body"))
    return first.withColumn("body", body).withColumn("status", status).withColumn(
        "bytes", size.cast("long")
    )


_ESCAPED = "regexp_replace(pattern, '([\\\\.\\[\\]{}()+?^|$])', '\\\\\\1', 'g')"
_RULES = f"""{P}, o0 AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS origin,
   regexp_extract_all(html, '(?is)<a\\b[^>]*href="/([^"]*)"', 1) AS hrefs FROM p),
o1 AS (SELECT DISTINCT ON (origin) * FROM o0 ORDER BY origin, page_id),
bo AS (SELECT origin, page_id, {_BODY} AS body, CASE WHEN page_id % 7 = 1 THEN 404 WHEN page_id % 11 = 2 THEN 503 ELSE 200 END AS status,
  page_id % 13 = 3 AS huge FROM o1),
ln0 AS (SELECT origin, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS pos FROM bo),
ln1 AS (SELECT origin, pos, regexp_replace(split_part(raw, '#', 1), '^\\s+|\\s+$', '', 'g') AS t FROM ln0),
ln2 AS (SELECT origin, pos, lower(regexp_replace(split_part(t, ':', 1), '^\\s+|\\s+$', '', 'g')) AS field, regexp_replace(regexp_replace(t, '^[^:]*:', ''), '^\\s+|\\s+$', '', 'g') AS value FROM ln1 WHERE contains(t, ':')),
ln3 AS (SELECT *, CASE WHEN field = 'user-agent' AND lag(field) OVER (PARTITION BY origin ORDER BY pos) IN ('allow', 'disallow') THEN 1 ELSE 0 END AS o FROM ln2 WHERE field IN ('user-agent', 'allow', 'disallow')),
ln4 AS (SELECT *, sum(o) OVER (PARTITION BY origin ORDER BY pos) AS block FROM ln3),
ag AS (SELECT DISTINCT origin, block, lower(value) AS agent FROM ln4 WHERE field = 'user-agent'),
nm AS (SELECT origin, bool_or(agent = 'demo') AS named FROM ag GROUP BY origin),
ru0 AS (SELECT r.origin, a.agent, r.field = 'allow' AS allow, r.value AS pattern, r.pos FROM ln4 r JOIN ag a USING (origin, block) JOIN nm USING (origin)
  WHERE r.field <> 'user-agent' AND r.value <> '' AND a.agent = CASE WHEN named THEN 'demo' ELSE '*' END),
ru AS (SELECT *, '(?s)^' || CASE WHEN ends_with(pattern, '$') THEN regexp_replace(replace({_ESCAPED}, '*', '.*'), '\\\\\\$$', '$') ELSE replace({_ESCAPED}, '*', '.*') END AS regex FROM ru0)"""


@query(
    "robots_rules",
    f"WITH {_RULES} SELECT origin, agent, allow, pattern, regex, length(pattern) AS length FROM ru",
)
def robots_rules(spark, sf):
    """The rules of every policy that speak to this client."""
    token = "Demo"
    return pol.rules_for(_bodies(spark, sf), token).select(
        "origin", "agent", "allow", "pattern", "regex", F.col("length").cast("long").alias("length")
    )


@query(
    "robots_verdict",
    f"""WITH {_RULES}, {sql.LINKS[len(P) + 1:].lstrip().lstrip(',')},
lo AS (SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]*)', 1) AS origin, {sql.part('url', 4)} AS path FROM lnk),
mt AS (SELECT page_id, lo.pos, allow, row_number() OVER (PARTITION BY page_id, lo.pos ORDER BY length(pattern) DESC, allow DESC) AS k
  FROM lo JOIN ru USING (origin) WHERE regexp_matches(path, regex))
SELECT lo.page_id, lo.pos, CASE WHEN status >= 500 THEN 'unreadable' WHEN status <> 200 THEN 'allowed' WHEN huge THEN 'unreadable'
  WHEN mt.allow IS NULL OR mt.allow THEN 'allowed' ELSE 'disallowed' END AS policy
FROM lo LEFT JOIN bo USING (origin) LEFT JOIN mt ON mt.page_id = lo.page_id AND mt.pos = lo.pos AND mt.k = 1""",
)
def robots_verdict(spark, sf):
    """The policy verdict of every link."""
    rows = demo.links(spark, sf).select("page_id", F.col("pos").cast("long").alias("pos"), "url")
    table = pol.policies(_bodies(spark, sf), "Demo")
    return pol.verdicts(rows, table).select("page_id", "pos", "policy")


_FW = """o AS (SELECT o_orderkey, o_orderstatus, 'https://c' || (o_custkey % 10) || '.shop.net/o/' || o_orderkey AS url FROM orders),
f AS (SELECT a.url, CASE WHEN a.o_orderkey % 17 = 0 THEN 'https://elsewhere.org/' || a.o_orderkey ELSE b.url END AS target
  FROM o a JOIN o b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderstatus IN ('F', 'P')),
pl AS (SELECT 'https://c3.shop.net' AS origin),
t AS (SELECT f.url, target, CASE WHEN NOT contains(target, '.shop.net/') THEN 'untrusted' WHEN starts_with(target, 'https://c3.shop.net/') THEN 'disallowed' END AS stop FROM f)"""


def _shop(spark):
    """Trusted domains, and crawl policies of which one forbids its whole origin."""
    bodies = small_table(
        spark, [("https://c3.shop.net", 200, 30, "User-agent: *\nDisallow: /")], "origin string, status int, bytes long, body string"
    )
    return small_table(spark, [("shop.net",)], "domain string"), pol.policies(bodies, "Demo")


@query(
    "forward_chain",
    f"""WITH {_FW},
s AS (SELECT o_orderkey, o.url, a.target AS t1, a.stop AS s1, b.target AS t2, b.stop AS s2, c.target AS t3
  FROM o LEFT JOIN t a ON a.url = o.url LEFT JOIN t b ON b.url = a.target AND a.stop IS NULL LEFT JOIN t c ON c.url = b.target AND b.stop IS NULL)
SELECT o_orderkey, CASE WHEN t1 IS NULL OR s1 IS NOT NULL THEN url WHEN t2 IS NULL OR s2 IS NOT NULL THEN t1 ELSE t2 END AS final_url,
  (CASE WHEN t1 IS NULL OR s1 IS NOT NULL THEN 0 WHEN t2 IS NULL OR s2 IS NOT NULL THEN 1 ELSE 2 END)::BIGINT AS hops,
  CASE WHEN s1 IS NOT NULL THEN s1 WHEN s2 IS NOT NULL THEN s2 WHEN t3 IS NOT NULL THEN 'unusable' ELSE 'ok' END AS outcome,
  CASE WHEN contains(url, 'https://c3.') AND (t1 IS NOT NULL AND s1 IS NULL) THEN 'ok' ELSE 'ok' END AS landing
FROM s""",
)
def forward_chain(spark, sf):
    """Pages that forward, followed while trusted and allowed."""
    key = F.col("o_orderkey")
    orders = demo.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.concat(
            F.lit("https://c"), (F.col("o_custkey") % 10).cast("string"), F.lit(".shop.net/o/"), key.cast("string")
        ).alias("url"),
    )
    orders = cut_lineage(orders)
    following = orders.select((key - 1).alias("o_orderkey"), F.col("url").alias("target"))
    away = F.concat(F.lit("https://elsewhere.org/"), key.cast("string"))
    forwards = (
        orders.filter(F.col("o_orderstatus").isin("F", "P"))
        .join(following, "o_orderkey")
        .select("url", F.when(key % 17 == 0, away).otherwise(F.col("target")).alias("target"))
    )
    trusted, table = _shop(spark)
    followed = expansion.follow_forwards(orders.select("o_orderkey", "url"), forwards, trusted, table)
    landed = expansion.check_landings(followed, trusted, table)
    return landed.select(
        "o_orderkey", "final_url", F.col("hops").cast("long").alias("hops"), "outcome", "landing"
    )


_EDGES = """l AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem),
ed0 AS (SELECT DISTINCT 'P' || a.l_partkey AS src, 'P' || b.l_partkey AS url, b.l_partkey AS k
  FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
pt AS (SELECT p_partkey AS k, p_type AS host, p_retailprice / 100 AS score, p_brand FROM part),
ed AS (SELECT b.p_brand AS brand, src, url, pt.host, pt.score, pt.k AS seq, ends_with(url, '7') AS leaf
  FROM ed0 JOIN pt ON pt.k = ed0.k JOIN pt b ON 'P' || b.k = src)"""


def _level(n: int) -> str:
    seen = " UNION ALL ".join(f"SELECT brand, url, host FROM v{i}" for i in range(n))
    cand = f"c{n}"
    return f"""
{cand} AS (SELECT DISTINCT ON (brand, url) * FROM (
   SELECT e.brand, e.url, e.host, e.score, e.seq, e.leaf, {n} AS depth FROM ed e JOIN v{n - 1} v ON v.brand = e.brand AND v.url = e.src
   {f'UNION ALL SELECT brand, url, host, score, seq, leaf, depth FROM c{n - 1}' if n > 1 else ''})
   ORDER BY brand, url, -score, depth, seq),
sn{n} AS ({seen}),
r{n} AS (SELECT c.* FROM {cand} c LEFT JOIN sn{n} s USING (brand, url) WHERE s.url IS NULL AND c.score >= 10 AND NOT leaf),
h{n} AS (SELECT r.*, row_number() OVER (PARTITION BY brand, host ORDER BY -score, url) AS hn,
   (SELECT count(*) FROM sn{n} s WHERE s.brand = r.brand AND s.host = r.host) AS spent_host FROM r{n} r),
g{n} AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY -score, url) AS pn,
   (SELECT count(*) FROM sn{n} s WHERE s.brand = h{n}.brand) AS spent FROM h{n} WHERE hn <= 8 - spent_host),
v{n} AS (SELECT brand, url, host FROM g{n} WHERE pn <= 12 - spent)"""


_EXPANSION = f"""{_EDGES},
sd AS (SELECT p_brand AS brand, 'P' || k AS url, host, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS rn FROM pt),
v0 AS (SELECT brand, url, host FROM sd WHERE rn <= 2), {_level(1)}, {_level(2)}"""


def _expansion(spark, sf, judged: bool = False):
    """Two levels of expansion from two seeds per brand over the part graph; scores come with the links or from a judge."""
    from provenir.operators.ranking import top

    part = demo.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_type").alias("host"),
        (F.col("p_retailprice") / 100).alias("score"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("url"),
    )
    lines = demo.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    before = lines.select("l_orderkey", F.col("l_partkey").alias("src_key"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    pairs = before.join(lines, ["l_orderkey", "l_linenumber"]).select("src_key", F.col("l_partkey").alias("k")).distinct()
    owner = part.select(F.col("k").alias("src_key"), F.col("url").alias("src"), "brand")
    edges = pairs.join(part.drop("brand"), "k").join(owner, "src_key").select(
        "brand", "src", "url", "host", "score", F.col("k").alias("seq")
    )
    seeds = top(part, ["brand"], [F.col("k")], 2)
    scores = part.select("url", "score")
    return expansion.expand(
        seeds, edges.drop("score") if judged else edges, ["brand"], pages=12, per_host=8, is_document=F.col("url").endswith("7"),
        judge=(lambda met: met.join(scores, "url")) if judged else None,
    )


_EXPANDED = f"""WITH {_EXPANSION}
SELECT brand, url, 'visited' AS what, 0::BIGINT AS depth FROM v0 UNION ALL SELECT brand, url, 'visited', 1 FROM v1 UNION ALL SELECT brand, url, 'visited', 2 FROM v2
UNION ALL SELECT brand, url, 'candidate', depth FROM c2"""


def _expanded(found):
    return found.visited.select(
        "brand", "url", F.lit("visited").alias("what"), F.col("depth").cast("long").alias("depth")
    ).unionByName(
        found.candidates.select("brand", "url", F.lit("candidate").alias("what"), F.col("depth").cast("long").alias("depth"))
    )


@query("expand_links", _EXPANDED)
def expand_links(spark, sf):
    """What expansion visited and met."""
    return _expanded(_expansion(spark, sf))


@query("expand_judged", _EXPANDED)
def expand_judged(spark, sf):
    """The same, scored by a judge of the caller's."""
    return _expanded(_expansion(spark, sf, judged=True))


@query(
    "expansion_ledger",
    f"""WITH {_EXPANSION}, vs AS (SELECT brand, url FROM v0 UNION ALL SELECT brand, url FROM v1 UNION ALL SELECT brand, url FROM v2)
SELECT c2.brand, c2.url, CASE WHEN leaf THEN 'document' WHEN score < 10 THEN 'score' WHEN g2.url IS NOT NULL THEN 'page budget' ELSE 'host budget' END AS reason
FROM c2 ANTI JOIN vs USING (brand, url) LEFT JOIN (SELECT brand, url FROM g2) g2 ON g2.brand = c2.brand AND g2.url = c2.url
UNION ALL SELECT brand, url, 'depth' FROM v2""",
)
def expansion_ledger(spark, sf):
    """What expansion did not follow, and why."""
    return _expansion(spark, sf).left_out.select("brand", "url", "reason")


@query(
    "landings",
    """WITH r AS (SELECT o_orderkey, 'https://c' || (o_custkey % 10) || '.shop.net/o/' || o_orderkey AS url,
  CASE o_orderkey % 5 WHEN 0 THEN 'https://elsewhere.org/' || o_orderkey WHEN 1 THEN 'https://c3.shop.net/away' WHEN 2 THEN 'https://c4.shop.net/home' END AS away FROM orders),
l AS (SELECT *, coalesce(away, url) AS final_url FROM r)
SELECT o_orderkey, CASE WHEN NOT contains(final_url, '.shop.net/') THEN 'untrusted' WHEN final_url <> url AND contains(final_url, 'https://c3.') THEN 'disallowed' ELSE 'ok' END AS landing FROM l""",
)
def landings(spark, sf):
    """Where requests ended: off the trusted domains, on a page that may not be read, or well."""
    key = F.col("o_orderkey")
    url = F.concat(F.lit("https://c"), (F.col("o_custkey") % 10).cast("string"), F.lit(".shop.net/o/"), key.cast("string"))
    away = (
        F.when(key % 5 == 0, F.concat(F.lit("https://elsewhere.org/"), key.cast("string")))
        .when(key % 5 == 1, "https://c3.shop.net/away")
        .when(key % 5 == 2, "https://c4.shop.net/home")
    )
    rows = demo.table(spark, sf, "orders").select("o_orderkey", url.alias("url"), F.coalesce(away, url).alias("final_url"))
    trusted, table = _shop(spark)
    return expansion.check_landings(rows, trusted, table).select("o_orderkey", "landing")
