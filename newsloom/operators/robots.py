"""robots.txt as relations: cached records with a time to live, rules, and the verdict for each url."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import robots_url

TTL = 86_400


def rules(robots: DataFrame) -> DataFrame:
    """(robots_url, at, allow, prefix): the rules of the group for all agents, in file order."""
    lines = robots.select(F.col("url").alias("robots_url"), F.posexplode(F.split("robots_text", "\n")).alias("at", "line"))
    parts = lines.select("robots_url", "at", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("value"))
    # the agent that a line stands under is the last one named before it
    agents = F.filter(F.transform(F.split("robots_text", "\n"), lambda x, k: F.struct(k.alias("at"), F.trim(F.regexp_extract(x, r"(?i)^\s*user-agent\s*:\s*([^#]*)", 1)).alias("agent"))), lambda a: a["agent"] != "")
    under = robots.select(F.col("url").alias("robots_url"), agents.alias("agents"))
    found = parts.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).join(under, "robots_url")
    agent = F.element_at(F.filter("agents", lambda a: a["at"] < F.col("at")), -1)["agent"]
    return found.where(agent == "*").select("robots_url", "at", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix"))


def verdicts(urls: DataFrame, robots: DataFrame, now: int, ttl: int = TTL, url_col="url") -> DataFrame:
    """urls with can_fetch: the first rule that is a prefix of the path decides; no fresh record, or no rule, allows."""
    path = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    rows = urls.withColumns({"robots_url": robots_url(F.col(url_col)), "__path": F.when(path == "", "/").otherwise(path)})
    fresh = robots.where(F.col("last_checked") > now - ttl)
    known = fresh.select(F.col("url").alias("robots_url"), "allow_all", "disallow_all")
    rule = rules(fresh).groupBy("robots_url").agg(F.sort_array(F.collect_list(F.struct("at", "allow", "prefix"))).alias("rules"))  # a file's own rules: bounded by the file
    out = rows.join(known, "robots_url", "left").join(rule, "robots_url", "left")
    hit = F.get(F.filter("rules", lambda r: F.startswith(F.col("__path"), r["prefix"])), 0)["allow"]
    can = F.when(F.col("allow_all"), True).when(F.col("disallow_all"), False).otherwise(F.coalesce(hit, F.lit(True)))
    return out.withColumn("can_fetch", F.coalesce(can, F.lit(True))).drop("__path", "rules", "allow_all", "disallow_all")
