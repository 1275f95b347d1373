"""Crawl policies (RFC 9309): bodies to rules, and the verdict for a URL.

A policy body is bounded (``LIMITS.policy_bytes``), so one origin's rules may be one array at rest. URLs
never meet that array. Every rule begins with literal characters; the distinct paths of an origin are cut
into the prefixes whose lengths its rules have, and meet the rules in an equality join on origin and
prefix. Wildcards are verified on what was met. Origins of very many paths are dealt over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions import urls
from provenir.operators.freshness import reuse
from provenir.params import LIMITS
from provenir.session import cut_lineage

#: Distinct paths of one origin that share a salt.
HOT = 100_000
_RULES = "array<struct<precedence:int,allow:boolean,pattern:string,regex:string>>"


def pattern_regex(pattern: Column) -> Column:
    """``*`` is any run, a trailing ``$`` anchors, everything else stands for itself."""
    literal = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    starred = F.replace(literal, F.lit("*"), F.lit(".*"))
    return F.concat(
        F.lit("(?s)^"),
        F.when(pattern.endswith("$"), F.regexp_replace(starred, r"\\\$$", "\\$")).otherwise(starred),
    )


def policy_lines(bodies: DataFrame) -> DataFrame:
    """(origin, pos, field, value, block) of the agent and rule lines.

    An agent line that follows a rule line opens a new block.
    """
    lines = bodies.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw"))
    text = urls.strip(F.substring_index("raw", "#", 1))
    split = lines.filter(text.contains(":")).select(
        "origin",
        "pos",
        F.lower(urls.strip(F.substring_index(text, ":", 1))).alias("field"),
        urls.strip(F.regexp_replace(text, "^[^:]*:", "")).alias("value"),
    )
    known = split.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("origin").orderBy("pos")
    opens = (F.col("field") == "user-agent") & F.lag("field").over(order).isin("allow", "disallow")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn(
        "block", F.sum("_opens").over(so_far)
    ).drop("_opens")


def rules_for(bodies: DataFrame, agent: str) -> DataFrame:
    """The rules that speak to one agent: its own blocks, or those of ``*``, never both."""
    token = agent.lower()
    lines = policy_lines(bodies)
    agents = (
        lines.filter(F.col("field") == "user-agent")
        .select("origin", "block", F.lower("value").alias("agent"))
        .filter(F.col("agent").isin(token, "*"))
        .distinct()
    )
    named = agents.groupBy("origin").agg(F.bool_or(F.col("agent") == token).alias("_named"))
    blocks = agents.join(named, "origin").filter(
        F.col("agent") == F.when(F.col("_named"), F.lit(token)).otherwise(F.lit("*"))
    )
    rules = lines.filter((F.col("field") != "user-agent") & (F.col("value") != ""))
    return rules.join(blocks.select("origin", "block", "agent"), ["origin", "block"]).select(
        "origin",
        "agent",
        (F.col("field") == "allow").alias("allow"),
        F.col("value").alias("pattern"),
        pattern_regex(F.col("value")).alias("regex"),
        F.length("value").alias("length"),
        "pos",
    )


def policies(bodies: DataFrame, agent: str, maximum: int = LIMITS.policy_bytes) -> DataFrame:
    """One row per origin: open, closed, or rules, longest first and allow first on ties.

    ``bodies``: origin, status, bytes, body.
    """
    ok = F.col("status").between(200, 299)
    state = (
        F.when(F.col("status") >= 500, "closed")
        .when(~ok, "open")
        .when(F.col("bytes") > maximum, "closed")
        .otherwise("rules")
    )
    detail = F.when(
        F.col("status") >= 500, F.format_string("answered HTTP %d", F.col("status"))
    ).when(ok & (F.col("bytes") > maximum), "is larger than the size limit for a crawl policy")
    judged = bodies.withColumn("state", state).withColumn("detail", detail)
    rules = rules_for(judged.filter(F.col("state") == "rules"), agent)
    ordered = (
        rules.groupBy("origin")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.col("length")).alias("precedence"),
                        (~F.col("allow")).alias("_deny"),
                        "pattern",
                        "regex",
                    )
                )
            ).alias("_r")
        )
        .select(
            "origin",
            F.transform(
                "_r",
                lambda r: F.struct(
                    r["precedence"].alias("precedence"),
                    (~r["_deny"]).alias("allow"),
                    r["pattern"].alias("pattern"),
                    r["regex"].alias("regex"),
                ),
            )
            .cast(_RULES)
            .alias("rules"),
        )
    )
    return cut_lineage(judged.select("origin", "state", "detail").join(ordered, "origin", "left"))


def reusable(asks: DataFrame, fetched: DataFrame, hours: float = LIMITS.policy_hours) -> DataFrame:
    """Add ``policy``: reused, or fetch when an origin's last fetched policy is ``hours`` old or there is none.

    ``asks``: origin, at (microseconds), ask. ``fetched``: origin, at, ask. ``held`` is the policy found.
    """
    looked = reuse(asks, fetched, ["origin"], "at", "ask", {"_fresh": hours})
    return looked.withColumn("policy", F.when(F.col("_fresh"), "reused").otherwise("fetch")).drop("_fresh")


def literal_prefix(pattern: Column) -> Column:
    """What a matching path begins with: the pattern before its first ``*`` or its closing ``$``."""
    return F.regexp_replace(F.substring_index(pattern, "*", 1), r"\$$", "")


def governing(paths: DataFrame, table: DataFrame, hot: int = HOT) -> DataFrame:
    """(origin, _path, policy, detail) of each distinct path whose origin has a policy.

    ``paths``: origin, _path. ``table`` as made by ``policies``. ``hot``: paths of an origin in one salt.
    """
    sizes = paths.groupBy("origin").agg(F.ceil(F.count("*") / hot).cast("int").alias("_salts"))
    large = sizes.filter("_salts > 1")
    salted = paths.join(large, "origin", "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("_path"), F.col("_salts")).cast("int"), F.lit(0))
    )
    policy = table.join(large, "origin", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    rules = policy.filter(F.col("state") == "rules").select("origin", "_salt", F.inline("rules")).withColumn("_prefix", literal_prefix(F.col("pattern")))
    lengths = rules.groupBy("origin", "_salt").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    asked = salted.select("origin", "_salt", "_path").join(lengths, ["origin", "_salt"])
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    asked = asked.select("origin", "_salt", "_path", F.explode(fitting).alias("_n"))
    asked = asked.select("origin", "_salt", "_path", F.substring("_path", F.lit(1), F.col("_n")).alias("_prefix"))
    met = asked.join(rules, ["origin", "_salt", "_prefix"])
    matched = met.filter((F.col("pattern") == F.col("_prefix")) | F.rlike("_path", F.col("regex")))
    best = matched.groupBy("origin", "_path").agg(F.min(F.struct("precedence", (~F.col("allow")).alias("_denied"))).alias("_best"))
    judged = salted.join(policy.select("origin", "_salt", "state", "detail"), ["origin", "_salt"]).join(best, ["origin", "_path"], "left")
    verdict = (
        F.when(F.col("state") == "closed", "unreadable")
        .when((F.col("state") == "rules") & F.col("_best._denied"), "disallowed")
        .otherwise("allowed")
    )
    return judged.select("origin", "_path", verdict.alias("policy"), "detail")


def verdicts(rows: DataFrame, table: DataFrame, url: str = "url", hot: int = HOT) -> DataFrame:
    """Add ``origin``, ``detail`` and ``policy``: allowed, disallowed or unreadable.

    The longest matching rule decides, an allowing one among equals; an origin without a row is allowed.
    """
    keyed = rows.withColumn("origin", urls.origin(F.col(url))).withColumn("_path", urls.policy_path(F.col(url)))
    # Only paths whose origin has a policy take part; each is written once, as three joins read them.
    asked = keyed.select("origin", "_path").join(table.select("origin"), "origin", "left_semi")
    judged = governing(cut_lineage(asked.distinct()), table, hot)
    return (
        keyed.join(judged, ["origin", "_path"], "left")
        .withColumn("policy", F.coalesce("policy", F.lit("allowed")))
        .drop("_path")
    )


def policy_reason(policy: Column, detail: Column) -> Column:
    """What stopped a page, in words true of the verdict."""
    return F.when(policy == "disallowed", "its crawl policy does not permit this client").when(
        policy == "unreadable", F.concat(F.lit("its crawl policy "), detail)
    )
