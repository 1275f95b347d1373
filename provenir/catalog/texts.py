"""Page text, mention windows, excerpts, countries in texts, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.catalog import demo, query, sql
from provenir.functions import keys, text as tx
from provenir.operators import excerpts as ex, lexicon as lx, pages as pg
from provenir.params import GAP_MARK, CHROME_ELEMENTS, PLACEHOLDER_LINE, ROLES

P = sql.PAGES


def _clean_sql(html: str) -> str:
    out = html
    for element in CHROME_ELEMENTS:
        out = f"regexp_replace({out}, '(?is)<{element}\\b.*?</{element}\\s*>', '', 'g')"
    bare = sql.decode_all(f"regexp_replace({out}, {sql.q(sql.TAG)}, chr(10), 'g')")
    lines = f"string_split_regex({bare}, '\\r\\n|\\r|\\n')"
    trimmed = f"list_transform({lines}, lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_filter({trimmed}, lambda l: l <> ''), chr(10))"


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')"
_UNTR = (
    f"(len(ls) >= 4 AND len(list_filter(ls, lambda l: regexp_matches(l, {sql.q(PLACEHOLDER_LINE)}))) >= 4 "
    f"AND len(list_filter(ls, lambda l: regexp_matches(l, {sql.q(PLACEHOLDER_LINE)}))) * 2 >= len(ls))"
)


@query(
    "clean_text",
    f"""WITH {P}, c AS (SELECT page_id, {_clean_sql('html')} AS text FROM p), l AS (SELECT *, string_split(text, chr(10)) AS ls FROM c)
SELECT page_id, sha256(text) AS hash, length(text) AS chars,
  CASE WHEN length(text) < 400 THEN 'too little readable text' WHEN {_UNTR} THEN 'translation placeholders instead of text' END AS thin FROM l""",
)
def clean_text(spark, sf):
    """Readable text of every page, and why it may be too thin."""
    text = pg.readable_text(F.col("html"))
    rows = demo.pages(spark, sf).select("page_id", text.alias("text"))
    return rows.select(
        "page_id",
        keys.content_hash(F.col("text")).alias("hash"),
        F.length("text").cast("long").alias("chars"),
        tx.thin_reason(F.col("text")).alias("thin"),
    )


@query(
    "placeholder_text",
    f"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[ .,]+([a-z])', CASE WHEN lang = 'en' THEN '.\\1' ELSE ' \\1' END, 'g') AS text FROM documents),
l AS (SELECT doc_id, text, {_LINES} AS ls FROM d)
SELECT doc_id, len(ls) AS lines, {_UNTR} AS untranslated,
  CASE WHEN length(text) < 400 THEN 'too little readable text' WHEN {_UNTR} THEN 'translation placeholders instead of text' END AS thin FROM l""",
)
def placeholder_text(spark, sf):
    """Texts whose lines are translation keys (spaces of English lines become dots)."""
    docs = demo.table(spark, sf, "documents")
    joined = F.when(F.col("lang") == "en", F.regexp_replace(F.lower("text"), "[ .,]+([a-z])", ".$1")).otherwise(
        F.regexp_replace(F.lower("text"), "[ .,]+([a-z])", " $1")
    )
    text = F.col("text")
    return docs.select("doc_id", joined.alias("text")).select(
        "doc_id",
        F.size(tx.plain_lines(text)).cast("long").alias("lines"),
        tx.looks_untranslated(text).alias("untranslated"),
        tx.thin_reason(text).alias("thin"),
    )


TERMS = ["that", "license", "pour", "dans", "sich", "for", "una", "USA"]
_LONG = [t.lower() for t in TERMS if len(t) > 3]
_SHORT = [t.upper() for t in TERMS if len(t) <= 3]


@query(
    "mention_windows",
    f"""WITH t0 AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS toks FROM documents),
t1 AS (SELECT doc_id, n, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM t0),
t2 AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM t1),
m AS (SELECT doc_id, n, e - length(tok) AS s, e FROM t2 WHERE e - length(tok) >= least(100, n) AND (lower(tok) IN ({sql.strings(_LONG)}) OR tok IN ({sql.strings(_SHORT)}))),
w AS (SELECT doc_id, greatest(s - 40, 0) AS s, least(e + 40, n) AS e FROM m UNION ALL SELECT doc_id, 0, least(100, n) FROM t0),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM o)
SELECT doc_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM g GROUP BY doc_id, island""",
)
def mention_windows(spark, sf):
    """Merged windows around every mention of the terms."""
    docs = demo.table(spark, sf, "documents").select("doc_id", "text")
    text = F.col("text")
    pattern = ex.mention_pattern(TERMS)
    head = F.least(F.lit(100), F.length(text)).cast("int")
    first = F.struct(F.lit(0).alias("s"), head.alias("e"))
    spans = ex.windows(text, pattern, head, F.lit(40), first)
    return docs.select("doc_id", F.inline(spans)).select(
        "doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")
    )


# The head, then windows until the budget is full; cut to it; what is left reads on from each span in turn.
_EXCERPT = f"""t0 AS (SELECT doc_id, text, length(text) AS n, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS toks FROM documents),
t1 AS (SELECT doc_id, n, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM t0),
t2 AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM t1),
m AS (SELECT doc_id, greatest(e - length(tok) - 80, 0) AS s, least(e + 80, n) AS e, i FROM t2
  WHERE e - length(tok) >= least(200, n) AND (lower(tok) IN ({sql.strings(_LONG)}) OR tok IN ({sql.strings(_SHORT)}))),
m1 AS (SELECT *, greatest(200, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pm FROM m),
m2 AS (SELECT *, greatest(pm, e) - CASE WHEN s <= pm THEN pm ELSE s END AS inc FROM m1),
m3 AS (SELECT *, 200 + coalesce(sum(inc) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m2),
w AS (SELECT doc_id, s, e FROM m3 WHERE used < 900 UNION ALL SELECT doc_id, 0, least(200, n) FROM t0),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM o),
i0 AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, island),
i1 AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i0),
i2 AS (SELECT doc_id, s, least(e, s + 900 - before) AS e FROM i1 WHERE before < 900),
i3 AS (SELECT i2.*, n, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), n) - e AS gap, 900 - sum(e - s) OVER (PARTITION BY doc_id) AS spare FROM i2 JOIN t0 USING (doc_id)),
i4 AS (SELECT *, e + greatest(0, least(gap, spare - coalesce(sum(gap) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS e2 FROM i3),
i5 AS (SELECT *, coalesce(lag(e2) OVER (PARTITION BY doc_id ORDER BY s), 0) AS last FROM i4),
x0 AS (SELECT doc_id, string_agg(CASE WHEN s > last THEN {sql.q(GAP_MARK)} ELSE '' END || substr(text, (s + 1)::BIGINT, (e2 - s)::BIGINT), '' ORDER BY s) || CASE WHEN max(e2) < max(i5.n) THEN {sql.q(GAP_MARK)} ELSE '' END AS cut
  FROM i5 JOIN t0 USING (doc_id) GROUP BY doc_id),
xc AS (SELECT t0.doc_id, n, CASE WHEN n <= 900 THEN text ELSE cut END AS excerpt FROM t0 LEFT JOIN x0 USING (doc_id))"""


@query("excerpt", f"WITH {_EXCERPT} SELECT doc_id, n AS chars, excerpt FROM xc")
def excerpt(spark, sf):
    """C11: budgeted excerpts of every document."""
    docs = demo.table(spark, sf, "documents").select("doc_id", "text")
    cut = ex.excerpt(F.col("text"), ex.mention_pattern(TERMS), 900, 200, 160)
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), cut.alias("excerpt"))


@query(
    "packets",
    f"""WITH {_EXCERPT}, d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents),
k AS (SELECT source, place, {{'place': place, 'id': 'd' || d.doc_id, 'title': trim(split_part(text, chr(10), 1)), 'url': 'https://x/' || d.doc_id, 'excerpt': excerpt}} AS item
  FROM d JOIN xc USING (doc_id) WHERE place <= 10)
SELECT source, count(*) AS candidates, to_json({{'traveller': {{'name': source}}, 'roles': [{sql.strings(ROLES)}], 'candidates': list_transform(list(item ORDER BY place),
  lambda i: {{'id': i.id, 'title': i.title, 'url': i.url, 'published': NULL::VARCHAR, 'excerpt': i.excerpt}})}})::VARCHAR AS packet FROM k GROUP BY source""",
)
def packets(spark, sf):
    """One decider packet per source, over its ten longest documents, as text."""
    from provenir.operators.ranking import top

    docs = demo.table(spark, sf, "documents")
    best = top(docs.select("doc_id", "source", "n_chars"), ["source"], [-F.col("n_chars"), F.col("doc_id")], 10)
    # The text is read for the shortlisted documents only.
    rows = best.join(docs.select("doc_id", "text"), "doc_id").select(
        "source", "place",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"),
        F.lit("").alias("title"), F.substring_index("text", "\n", 1).alias("text"),
        F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("published"),
        ex.excerpt(F.col("text"), ex.mention_pattern(TERMS), 900, 200, 160).alias("excerpt"),
    )
    corridors = docs.select("source").distinct().withColumn(
        "traveller", F.struct(F.col("source").alias("name"))
    )
    return ex.candidate_packets(rows, corridors, ["source"], ROLES).select(
        "source", F.col("candidates").cast("long").alias("candidates"), "packet"
    )


_MENTION_SQL = f"""w AS (SELECT * FROM {sql.values([(f'N{i}', i, x) for i, x in enumerate(demo.WORDS)], 'code, seq, word')}),
t AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS tok FROM documents),
m AS (SELECT DISTINCT doc_id, lang, code, seq FROM (
  SELECT doc_id, lang, code, seq FROM t JOIN w ON tok = word
  UNION ALL SELECT doc_id, lang, code, seq FROM documents JOIN w ON source = 'src' || seq))"""


@query(
    "country_mentions",
    f"WITH {_MENTION_SQL} SELECT doc_id, code FROM m",
)
def country_mentions(spark, sf):
    """The countries every document refers to, by whole words or path parts."""
    rows = _documents_with_url(spark, sf)
    return lx.country_mentions(rows, ["doc_id"], demo.countries(spark, sf)).select("doc_id", "code")


@query(
    "foreign_country",
    f"""WITH {_MENTION_SQL}
SELECT doc_id, 'NATION_' || min(seq) AS foreign_name FROM m WHERE code NOT IN ('N24', CASE lang WHEN 'en' THEN 'N0' ELSE 'N5' END) GROUP BY doc_id""",
)
def foreign_country(spark, sf):
    """The first country outside its own corridor a document is about."""
    rows = _documents_with_url(spark, sf).withColumn(
        "own", F.when(F.col("lang") == "en", "N0").otherwise("N5")
    ).withColumn("home", F.lit("N24"))
    found = lx.foreign_country(rows, ["doc_id"], demo.countries(spark, sf), ["own", "home"])
    return found.select("doc_id", F.col("foreign").alias("foreign_name"))


def _documents_with_url(spark, sf):
    docs = demo.table(spark, sf, "documents")
    return docs.select(
        "doc_id", "lang", "text",
        F.concat(F.lit("https://host.example/x-"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
    )


@query(
    "snapshot_join",
    """WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN chr(10) || chr(9) || ' ' ELSE chr(9) || text || chr(10) END AS text FROM documents WHERE source <> 'src3'),
j AS (SELECT coalesce(l.doc_id, d.doc_id) AS source_id, l.doc_id IS NULL AS nm, d.doc_id IS NULL AS nf, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM labels l FULL JOIN d ON d.doc_id = l.doc_id),
k AS (SELECT *, CASE WHEN nf THEN 'declared but has no text' WHEN nm THEN 'has a text but is not declared' WHEN text = '' THEN 'the text is empty' WHEN length(text) > 5000 THEN 'the text is too long' END AS problem FROM j)
SELECT source_id, problem, CASE WHEN problem IS NULL THEN sha256(text) END AS hash FROM k""",
)
def snapshot_join(spark, sf):
    """Declared labels against the texts of a snapshot."""
    from provenir.sources.readers import read_snapshot

    manifest = demo.table(spark, sf, "labels").select(F.col("doc_id").alias("source_id"))
    docs = demo.table(spark, sf, "documents").filter(F.col("source") != "src3")
    files = docs.select(
        F.col("doc_id").alias("source_id"),
        F.when(F.col("lang") == "es", "\n\t ").otherwise(F.concat(F.lit("\t"), "text", F.lit("\n"))).alias("content"),
    )
    sources, problems = read_snapshot(manifest, files, 5000, F.lit("2024-01-31").cast("timestamp"))
    return sources.select(
        "source_id", F.lit(None).cast("string").alias("problem"), F.col("content_hash").alias("hash")
    ).unionByName(problems.withColumn("hash", F.lit(None).cast("string")))


@query(
    "step_titles",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
t AS (SELECT doc_id, n, regexp_replace(chr(9) || line || ' ' || chr(9), '^\\s+|\\s+$', '', 'g') AS x FROM l)
SELECT doc_id, n, coalesce(nullif(regexp_replace(rtrim(x, ',;:'), '^\\s+|\\s+$', '', 'g'), ''), x) AS title FROM t""",
)
def step_titles(spark, sf):
    """Step titles tidied (every line of every document)."""
    docs = demo.table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select(
        "doc_id", F.col("n").cast("long").alias("n"), tx.tidy_step_title(F.concat(F.lit("\t"), "line", F.lit(" \t"))).alias("title")
    )
