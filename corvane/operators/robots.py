"""Robots files: rules, matching and decisions (Q12-Q15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let, lines, trim_space

TTL_SECONDS = 3600


def rule_lines(robots: Column, agent: str) -> Column:
    """Array of (allow, rule) of the group that applies to an agent, in order.

    The agent's own group beats the one for all; a later group of the same name
    replaces an earlier one; of stacked User-agent lines only the last has rules.
    A group is found by the places of the User-agent lines; no array grows line by line.
    """

    def read(raw: Column) -> Column:
        def of(line: Column) -> Column:
            kind = F.when(F.startswith(line, F.lit("User-agent:")), "agent").when(F.startswith(line, F.lit("Disallow:")), "deny").when(F.startswith(line, F.lit("Allow:")), "allow")
            return F.struct(kind.alias("kind"), trim_space(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))

        return let(trim_space(raw), of)

    def group(rows: Column) -> Column:
        def last(name: str) -> Column:
            return F.array_max(F.transform(rows, lambda r, i: F.when((r["kind"] == "agent") & (F.lower(r["value"]) == name), i)))

        def inside(first: Column) -> Column:
            following = F.array_min(F.transform(rows, lambda r, i: F.when((r["kind"] == "agent") & (i > first), i)))
            return F.slice(rows, first + 2, F.coalesce(following, F.size(rows)) - first - 1)

        return let(F.coalesce(last(agent.lower()), last("*")), lambda first: F.when(first.isNotNull(), inside(first)))

    found = let(F.transform(lines(F.coalesce(robots, F.lit(""))), read), group)
    rules = F.transform(F.filter(found, lambda r: r["kind"].isin("allow", "deny")), lambda r: F.struct((r["kind"] == "allow").alias("allow"), r["value"].alias("rule")))
    return F.coalesce(rules, F.array().cast("array<struct<allow:boolean,rule:string>>"))


def parse_rules(robots: Column, agent: str) -> Column:
    """(allow, disallow): the rules of the group that applies to an agent."""

    def of(found: Column) -> Column:
        pick = lambda allow: F.transform(F.filter(found, lambda r: r["allow"] == F.lit(allow)), lambda r: r["rule"])
        return F.struct(pick(True).alias("allow"), pick(False).alias("disallow"))

    return let(rule_lines(robots, agent), of)


def path_matches(path: Column, rule: Column) -> Column:
    """A prefix; with stars, its parts in order anywhere."""
    pattern = F.concat(F.lit(r"(?s)\Q"), F.replace(rule, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"))
    return F.when(F.contains(rule, F.lit("*")), F.rlike(path, pattern)).otherwise(F.startswith(path, rule))


def is_allowed(path: Column, rules: Column) -> Column:
    """The longest matching rule decides, an allow rule of the same length too; empty rules count for nothing."""
    longest = lambda kind: F.coalesce(F.array_max(F.transform(F.filter(rules[kind], lambda r: (r != "") & path_matches(path, r)), F.octet_length)), F.lit(0))
    allow, deny = longest("allow"), longest("disallow")
    return F.when((allow >= deny) & (allow > 0), True).otherwise(deny == 0)


def decide(pages: DataFrame, robots: DataFrame, agent: str, domain: str = "domain", path: str = "path") -> DataFrame:
    """pages with ``allowed``; a domain without a robots file, and a null path, allow all.

    A path is looked up, not compared: rules are rows, and a (domain, path) asks for its
    beginnings of the lengths that the domain's rules have, in one equi-join, so its cost
    is the number of lengths and not of rules.  Of a rule with stars, the part that the
    fewest of its domain's rules have is looked up in the same way, anywhere in the path;
    only rules whose part occurs are tried.  Two robots files of a domain count as one set of rules.
    """
    rules = robots.select(F.col(domain).alias("_d"), F.explode(rule_lines(F.col("robots_text"), agent)).alias("r")).where("r.rule <> ''").select("_d", "r.*").distinct()
    starred = F.contains("rule", F.lit("*"))
    parts = rules.where(starred).select("_d", "allow", "rule", F.explode(F.array_distinct(F.split("rule", r"\*"))).alias("_part"))
    shared = parts.groupBy("_d", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counted = parts.hint("merge").join(shared, ["_d", "_part"])
    # An empty part is in every path.
    rarest = F.min(F.struct((F.col("_part") == "").alias("empty"), "_n", (-F.length("_part")).alias("size"), "_part"))
    stars = counted.groupBy("_d", "allow", "rule").agg(rarest.alias("least")).select("_d", F.col("least._part").alias("_part"), "allow", "rule")
    plain = rules.where(~starred).groupBy("_d", F.col("rule").alias("_part")).agg(*[F.max(F.when(F.col("allow") == F.lit(a), F.octet_length("rule"))).alias(n) for n, a in (("_allow", True), ("_deny", False))])
    asked = pages.select(F.col(domain).alias("_d"), F.col(path).alias("_p")).where("_d is not null and _p is not null").distinct()

    def lengths(looked_up: DataFrame) -> DataFrame:
        return looked_up.groupBy("_d").agg(F.collect_set(F.length("_part")).alias("_lengths"))

    p = F.col("_p")
    beginnings = F.transform(F.filter("_lengths", lambda n: n <= F.length(p)), lambda n: F.left(p, n))
    inside = F.array_distinct(F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length(p)), lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda at: F.substr(p, at, n)))))
    found = asked.join(lengths(plain), "_d").select("_d", "_p", F.explode(beginnings).alias("_part")).hint("merge").join(plain, ["_d", "_part"]).select("_d", "_p", "_allow", "_deny")
    tried = asked.join(lengths(stars), "_d").select("_d", "_p", F.explode(inside).alias("_part")).hint("merge").join(stars, ["_d", "_part"]).where(path_matches(p, F.col("rule")))
    size = lambda allow: F.when(F.col("allow") == F.lit(allow), F.octet_length("rule"))
    found = found.unionByName(tried.select("_d", "_p", size(True).alias("_allow"), size(False).alias("_deny")))
    found = found.groupBy("_d", "_p").agg(F.coalesce(F.max("_allow"), F.lit(0)).alias("_a"), F.coalesce(F.max("_deny"), F.lit(0)).alias("_n"))
    allowed = F.when((F.col("_a") >= F.col("_n")) & (F.col("_a") > 0), True).otherwise(F.col("_n") == 0)
    verdicts = found.select("_d", "_p", allowed.alias("allowed"))
    joined = pages.join(verdicts, (pages[domain] == verdicts["_d"]) & (pages[path] == verdicts["_p"]), "left")
    return joined.withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_d", "_p")


def fresh(robots: DataFrame, now: Column) -> DataFrame:
    """Robots files that were fetched within the last hour."""
    return robots.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= TTL_SECONDS)
