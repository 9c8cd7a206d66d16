"""Robots rules: files → groups → one policy row per file → verdict per URL.

A file holds for one origin (scheme and authority); `site` names it in all tables here.

A robots file is one row, so its lines, groups and rules are bounded by that document. URLs
meet the policy through one N:1 join on the site, and no URL is multiplied by the number of
rules. Before the join the rules of a file are put in order of their prefixes, once a file: the
rules that match a URL are then found by binary search, so ten thousand rules cost a URL little
more than ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import let, record
from ..functions.text import strip, unquote
from ..functions.urls import host_of, origin_of, same_site
from ..sources.tables import robots_lines


def _rule_events(robots: DataFrame) -> DataFrame:
    """Agent, rule and blank lines with the number of the group they belong to."""
    code = F.regexp_replace("line", "(?s)#.*$", "")
    name = F.lower(strip(F.substring_index(code, ":", 1)))
    value = unquote(strip(F.regexp_extract(code, "(?s)^[^:]*:(.*)$", 1)))
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(~code.contains(":"), None)
        .when(name == "user-agent", "agent")
        .when(name.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    lines = (
        robots_lines(robots)
        .select("site", "line_no", kind.alias("kind"), name.alias("name"), value.alias("value"))
        .filter(F.col("kind").isNotNull())
    )
    by_line = Window.partitionBy("site").orderBy("line_no")
    starts = (F.col("kind") == "agent") & (
        F.coalesce(F.lag("kind").over(by_line), F.lit("none")) != "agent")
    above = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(by_line)
    return lines.withColumns({
        "group_id": F.sum(starts.cast("bigint")).over(by_line),
        # a blank line ends the group: rules below it belong to nobody
        "live": (F.col("kind") == "agent") | ((F.col("kind") == "rule") & (above == "agent")),
    }).filter("live")


def robots_groups(robots: DataFrame) -> DataFrame:
    """site, group_id, agents ARRAY, rules ARRAY<STRUCT<rule_pos, allow, prefix>>.

    Groups without any rule line are dropped. A group of crawl-delay lines only stays, with no
    rules: it allows everything to its agents.
    """
    is_path_rule = F.col("name").isin("allow", "disallow")
    rule = F.struct(
        F.col("line_no").cast("bigint").alias("rule_pos"),
        ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"),
        F.regexp_replace("value", ";?\\??#?$", "").alias("prefix"),
    )
    return (
        _rule_events(robots)
        .groupBy("site", "group_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "agent", F.col("value")))).alias("agents"),
            F.array_sort(F.collect_list(F.when(is_path_rule, rule))).alias("rules"),
            F.bool_or(F.col("kind") == "rule").alias("_has_rule"),
        )
        .filter("_has_rule")
        .drop("_has_rule")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per rule: site, group_id, agents (comma list), rule_pos, allow, prefix."""
    return robots_groups(robots).select(
        "site", "group_id", F.array_join("agents", ",").alias("agents"), F.inline("rules"))


def load_status(status: Column) -> Column:
    """What a robots response means before any rule is read."""
    return (
        F.when(status.isNull(), "unreachable")
        .when(status.isin(401, 403), "deny_all")
        .when(status.between(400, 499), "allow_all")
        .when(status.between(200, 299), "parsed")
        .otherwise("unparsed")
    )


def robots_policy(robots: DataFrame, agent: str) -> DataFrame:
    """site → robots_status and the rules that hold for `agent` (NULL when no group does).

    Named groups come first, in file order; then the first group that names `*`.
    """
    token = F.lit(agent.split("/")[0].lower())
    default = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.contains(token, F.lower(a)))
    chosen = (
        robots_groups(robots)
        .withColumn("_default", default)
        .filter(F.col("_default") | named)
        .groupBy("site")
        .agg(F.min_by("rules", F.struct("_default", "group_id")).alias("rules"))
    )
    return (
        robots.select("site", load_status(F.col("status")).alias("robots_status"))
        .join(chosen, "site", "left")
    )


def robots_target(url: Column) -> Column:
    """The part of the URL that rules are matched against, decoded."""
    rest = F.regexp_extract(
        unquote(url), "(?s)^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?(.*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(rest, ";?\\??#?$", ""), F.lit("")), F.lit("/"))


def rule_index(rules: Column) -> Column:
    """Rules as a tree of prefixes: STRUCT<nodes, depth, steps>.

    `nodes` are the distinct prefixes in order, each with the node of the longest shorter prefix it
    starts with (`up`, -1 without one) and the earliest rule among itself and all nodes above
    (`rule`). `depth` is the longest way up, `steps` the strides of a binary search. NULL without rules.
    """
    ordered = F.array_sort(F.transform(rules, lambda r: record(
        prefix=r["prefix"], rule=record(rule_pos=r["rule_pos"], allow=r["allow"]))))

    def first_of_each(all_: Column) -> Column:
        return F.filter(all_, lambda r, i: (i == 0) | (r["prefix"] != F.get(all_, i - 1)["prefix"]))

    open_node = "array<struct<at:int,prefix:string,rule:struct<rule_pos:bigint,allow:boolean>>>"
    node = "array<struct<prefix:string,up:int,rule:struct<rule_pos:bigint,allow:boolean>>>"

    def step(acc: Column, r: Column) -> Column:
        """Nodes that are open at a prefix are those it starts with, the longest last."""
        def added(above: Column) -> Column:
            parent = F.get(above, F.size(above) - 1)
            rule = F.least(r["rule"], F.coalesce(parent["rule"], r["rule"]))
            return record(
                above=F.array_append(above, record(at=F.size(acc["nodes"]), prefix=r["prefix"], rule=rule)),
                nodes=F.array_append(acc["nodes"], record(
                    prefix=r["prefix"], up=F.coalesce(parent["at"], F.lit(-1)), rule=rule)),
                depth=F.greatest(acc["depth"], F.size(above) + 1))

        return let(F.filter(acc["above"], lambda o: F.startswith(r["prefix"], o["prefix"])), added)

    tree = F.aggregate(
        let(ordered, first_of_each),
        record(above=F.array().cast(open_node), nodes=F.array().cast(node), depth=F.lit(0)), step)
    strides = F.transform(
        F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftright", F.lit(1 << 30), k))
    return F.when(F.size(rules) > 0, let(tree, lambda t: record(
        nodes=t["nodes"], depth=t["depth"], steps=F.filter(strides, lambda n: n <= F.size(t["nodes"])))))


def first_rule(target: Column, index: Column) -> Column:
    """Whether the first rule whose prefix the target starts with allows it; NULL if none does.

    Every such prefix is the last one not behind the target in order, or a node above that one.
    """
    def found(target: Column) -> Column:
        nodes = index["nodes"]
        last = F.aggregate(index["steps"], F.lit(0), lambda n, k: F.when(
            F.coalesce(F.get(nodes, n + k - 1)["prefix"] <= target, F.lit(False)), n + k).otherwise(n)) - 1
        match = F.aggregate(F.sequence(F.lit(1), index["depth"]), last, lambda n, _: F.when(
            (n < 0) | F.startswith(target, F.get(nodes, n)["prefix"]), n).otherwise(F.get(nodes, n)["up"]))
        return F.get(nodes, match)["rule"]["allow"]

    return let(target, found)


def robots_allowed(url: Column, status: Column, index: Column) -> Column:
    """First matching rule decides (`index`: rule_index() of the file's rules); no rule, no group
    or no file allows."""
    return (
        F.when(status.isNull() | status.isin("unreachable", "allow_all"), True)
        .when(status == "parsed", F.coalesce(first_rule(robots_target(url), index), F.lit(True)))
        .otherwise(False)
    )


def indexed(policy: DataFrame) -> DataFrame:
    """The policy with its rules as an index; made per file, before any URL meets it."""
    return policy.withColumn("rules", rule_index(F.col("rules")))


def robots_gate(urls: DataFrame, policy: DataFrame) -> DataFrame:
    """urls (…, url, site) → `robots_status`, `robots_ok`; `site` is the origin_of() the url."""
    return urls.join(indexed(policy), "site", "left").select(
        *urls.columns,
        F.coalesce("robots_status", F.lit("unreachable")).alias("robots_status"),
        robots_allowed(F.col("url"), F.col("robots_status"), F.col("rules")).alias("robots_ok"),
    )


def seed_policies(seeds: DataFrame, policy: DataFrame) -> DataFrame:
    """seed_id, seed_host, robots_status, rules (an index): the seed's own file judges all its URLs."""
    return (
        seeds.select("seed_id", F.col("host").alias("seed_host"), origin_of(F.col("url")).alias("site"))
        .join(indexed(policy), "site", "left")
        .select("seed_id", "seed_host", "robots_status", "rules")
    )


def selectable_verdict(urls: DataFrame, seeds: DataFrame, policy: DataFrame) -> DataFrame:
    """urls (seed_id, pos, url) → `selectable`, `reason` (other_host, robots, ok)."""
    on_site = same_site(host_of(F.col("url")), F.col("seed_host"))
    allowed = robots_allowed(F.col("url"), F.col("robots_status"), F.col("rules"))
    return (
        urls.join(seed_policies(seeds, policy), "seed_id")
        .withColumn("reason", F.when(~on_site, "other_host").when(~allowed, "robots").otherwise("ok"))
        .select(*urls.columns, (F.col("reason") == "ok").alias("selectable"), "reason")
    )
