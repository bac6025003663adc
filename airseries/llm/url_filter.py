"""URL filter with redirect equivalence (DataFrame operations only).

Every page url is judged by host/path rules. Redirects (``<meta http-equiv=
refresh>``) and canonical links (``<link rel=canonical>``) found in the html
join urls into aliases; connected components carry a block decision to the
aliases no rule speaks about. An explicit allow wins: a page with a rule of its
own keeps that rule's verdict, and a component with both an allowed and a
blocked url leaves its unruled members allowed.

Defined results: a NULL url (or one without ``://``) has empty host and path, no
rule and no aliases, verdict ``allow``; NULL or empty html has no links;
repeated rows are each judged and returned; other columns are ignored; an empty
table gives an empty result. Fragments do not tell urls apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import written
from airseries.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are part of every row's expression; a longer list belongs in a table.
MAX_RULES = 2_000


class Rule(NamedTuple):
    action: str  # "block" or "allow"
    host: str
    path: str


def host_of(url: Column) -> Column:
    """Host of a url: after the first ``://`` up to ``/ ? #``, ASCII lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of a url: after the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, action) of the longest fitting rule (a tie goes to allow), else NULL.

    The list is ordered once, so the first fitting WHEN is the longest rule."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit a row expression")
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.action != "allow", r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,action:string>")


def _resolved(link: Column, url: Column) -> Column:
    """``link`` as an absolute url seen from ``url``; NULL if it cannot be one."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == ""), None)
            .otherwise(F.concat(folder, link)))


def _key(url: Column) -> Column:
    """Identity of a url: no fragment, scheme and host in lower case."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (u, v) url pairs joined by a redirect or a canonical link."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    wanted = F.filter(tags, lambda t: t.rlike(
        r"(?is)rel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b"))
    canonical = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    raw = F.when(F.col("tag").rlike(r"(?is)http-equiv"), refresh).otherwise(canonical)
    link = F.replace(F.trim(raw), F.lit("&amp;"), F.lit("&"))
    return (pages.where(F.col(url).contains("://") & F.col(html).isNotNull())
            .select(F.col(url).alias("url"), F.explode(wanted).alias("tag"))
            .select("url", link.alias("link"))
            .select(_key(F.col("url")).alias("u"), _key(_resolved(F.col("link"), F.col("url"))).alias("v"))
            .where("v IS NOT NULL AND u <> v").distinct())


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id",
               url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (NULL without aliases)."""
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    judged = src.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("_own", rule_for(F.col("host"), F.col("path"), rules))
    own = [F.col("_own.rule").alias("rule"), F.col("_own.action").alias("_own_action")]
    judged = judged.select("page_id", "url", "host", "path", *own)
    edges = written(alias_edges(src), "aliases")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule",
                             F.coalesce("_own_action", F.lit("allow")).alias("verdict"),
                             F.lit(None).cast("string").alias("component"))
    cc = components(edges)
    act = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    fate = (cc.withColumn("_act", act).groupBy("component")
            .agg(F.max((F.col("_act") == "allow").cast("int")).alias("_allowed"),
                 F.max((F.col("_act") == "block").cast("int")).alias("_blocked"))
            .where("_blocked = 1 AND coalesce(_allowed, 0) = 0").select("component", F.lit(True).alias("_bad")))
    by_url = written(cc.join(fate, "component", "left"), "alias-fate")
    keyed = judged.withColumn("node", F.when(F.col("url").contains("://"), _key(F.col("url"))))
    verdict = F.coalesce("_own_action", F.when(F.col("_bad"), F.lit("block")), F.lit("allow"))
    return (keyed.join(by_url, "node", "left")
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component"))
