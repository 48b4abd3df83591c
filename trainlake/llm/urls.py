"""URL filters: host-suffix and path-prefix expressions against a table of rules.

Each distinct URL is expanded into the expressions a rule could have, which
are joined with the rules on the first bytes of their digests; the full
digests and then the rules' precedence decide.  Path prefixes are only made
in lengths that rules have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import unused

# Hex digits of the digest that the join uses.
SHORT = 8
# Rules up to which their table (about 200 bytes each) is sent to every task.
BROADCAST_RULES = 20_000
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) rules as a table; the path starts with a slash."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def split_url(url):
    """host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add host, path, rule (host and path of the deciding rule, or null) and verdict to every row.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's.  The longest fitting rule (host and path together, then host, then
    block before allow) decides; without one the verdict is "allow".

    Defined cases: a null URL or one without ``://`` has empty host and path and
    no rule; equal URLs get equal verdicts; rules with a null part are ignored
    and repeated rules count once; an empty page or rule table works.  Input
    columns of the new names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url("url")
    split = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))

    text = F.concat("host", "path")
    own = rules.na.drop(subset=["action", "host", "path"]).select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
    own = own.select(
        F.substring(F.sha2(text, 256), 1, SHORT).alias("short"), F.sha2(text, 256).alias("digest"), text.alias("rule"), "action",
        F.length(text).alias("size"), F.length("host").alias("host_size"), F.length("path").alias("path_size"),
    )
    # Distinct path lengths of the rules: at most the longest path.
    sizes = sorted(r["path_size"] for r in own.select("path_size").distinct().collect())
    if own.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        own = F.broadcast(own)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = split.filter("host != ''").select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    expressions = expressions.select("url", F.explode("prefixes").alias("prefix"), "suffix").select("url", F.sha2(F.concat("suffix", "prefix"), 256).alias("full"))
    expressions = expressions.withColumn("short", F.substring("full", 1, SHORT))

    hits = expressions.join(own, "short").filter("full = digest")
    order = F.struct("size", "host_size", (F.col("action") == "block").alias("blocks"), "rule", "action")
    decided = hits.groupBy("url").agg(F.max(order).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    key = unused("_url", pages)
    judged = split.join(decided, "url", "left").select(F.col("url").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))
    joined = pages.join(judged, F.col("url").eqNullSafe(F.col(key)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", "rule", "verdict")
