"""URL filter: nested host and path rules as intervals, met by a sorted sweep.

A rule ``(host, path, verdict)`` fits its host and every subdomain where the path starts with the rule's.
With host labels reversed (``org.example.``) a host is a prefix of its subdomains, so a url is placed under
each ancestor host that has rules; there its path meets the rules' path prefixes, which are intervals in
sorted order. The intervals of one node are nested or disjoint. A sweep over points and rules sorted together
carries the last rule that started, and with it the stack of rules open there; the point pops those that do
not cover it, and the top is the longest rule at that node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, free, let

#: points of one node swept by one task; a node with more is split by a hash of the path
SWEEP_ROWS = 8192
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is NULL or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return ascii_lower(host), path


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per (node, path): its verdict and the stack of rules of that node open at its start, itself last."""
    r = (rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
         .groupBy(ascii_lower(F.col("host")).alias("node"), F.col("path").alias("key")).agg(F.max("verdict").alias("verdict")))
    lens = r.select("node", F.length("key").alias("n")).distinct()
    prefixes = (r.join(lens, "node").where(F.col("n") <= F.length("key"))
                .select("node", "key", F.expr("substring(key, 1, n)").alias("open")))
    opened = r.select("node", F.col("key").alias("open"), F.struct(
        F.length("key").alias("n"), F.col("key").alias("path"), F.col("verdict").alias("verdict")).alias("rule"))
    return (prefixes.join(opened, ["node", "open"])
            .groupBy("node", "key").agg(F.array_sort(F.collect_list("rule")).alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT,
               sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every page.

    ``rules`` has host, path and verdict; rules with a NULL or an empty host are ignored, and of rules with the same
    host and path the greater verdict ("block") holds. The longest fitting rule (host and path together) wins; where none
    fits, ``rule`` is NULL and ``verdict`` is ``default``. NULL urls have empty parts and fit no rule. Every input row comes
    out once, repeated rows too; columns of the input that are named like the four new ones are replaced.
    """
    host, path = url_parts(F.col(url))
    h, p, w = (free(c, pages) for c in ("_host", "_path", "_won"))
    pages = pages.withColumn(h, host).withColumn(p, path)
    urls = pages.select(F.col(h).alias("_host"), F.col(p).alias("_path")).distinct().where(F.col("_host") != "")
    stacks = _rule_stacks(rules)
    depth = stacks.agg(F.max(F.size(F.split("node", r"\.")))).first()[0] or 0  # one number
    # each distinct url once, under every ancestor host that may have rules
    reversed_host = F.reverse(F.split("_host", r"\."))
    nodes = let(reversed_host, lambda a: F.transform(
        F.sequence(F.lit(1), F.least(F.size(a), F.lit(max(depth, 1)))),
        lambda k: F.array_join(F.reverse(F.slice(a, 1, k)), ".")))
    points = urls.select("_host", "_path", F.explode(nodes).alias("node"))
    points = points.join(stacks.select("node").distinct(), "node", "left_semi")
    # hot nodes are split; their rules go to each part
    sizes = points.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(sweep_rows)).cast("int").alias("parts"))
    points = (points.join(sizes, "node")
              .withColumn("part", F.pmod(F.xxhash64("_host", "_path"), F.col("parts").cast("bigint")).cast("int")))
    starts = stacks.join(sizes, "node").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    events = points.select("node", "part", F.col("_path").alias("key"), F.lit(1).alias("kind"), "_host", F.lit(None).cast(
        stacks.schema["stack"].dataType).alias("stack")).unionByName(
        starts.select("node", "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("_host"), "stack"))
    sweep = Window.partitionBy("node", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    top = F.expr("try_element_at(filter(open, r -> startswith(key, r.path)), -1)")
    won = (swept.withColumn("top", top).where("top is not null")
           .groupBy(F.col("_host").alias(h), F.col("key").alias(p))
           .agg(F.max(F.struct((F.length("node") + F.col("top.n")).alias("n"), F.length("node").alias("m"),
                               F.concat("node", "top.path").alias("rule"), F.col("top.verdict").alias("verdict"))).alias(w)))
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", h, p)]
    return pages.join(won, [h, p], "left").select(
        *keep, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{w}.rule").alias("rule"),
        F.coalesce(F.col(f"{w}.verdict"), F.lit(default)).alias("verdict"))
