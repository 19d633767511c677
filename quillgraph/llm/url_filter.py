"""URL filtering by rules and, where no rule fits, by a tree of path templates for each host.

The tree has a level for each path segment, however many. A segment of digits, or of hexadecimal digits of some length, is variable by its form; one whose
siblings are many and mostly unlike each other is variable by count: both become a wildcard. Branches whose share of bad labels doesn't
differ significantly from that of all their siblings are merged into the wildcard as well. A template is rejected if its labelled share
of bad pages, smoothed by the share of its host and that by the share of all, is REJECT or more; a host without a labelled page is left alone.
What the rules decide is the label; further labels can be given.

Only DataFrame functions. Pages are summed by host and path before the tree is made; one join hands the templates back. A path alone in its
branch has wildcards from there on, so there are as many rounds as the longest beginning that two paths of a host share, and one more.
Nulls: a null url has an empty host and path and is allowed; repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import Cut

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SMOOTH = 4.0
REJECT = 0.5
#: Siblings that a segment must have to be variable, and their least share of the pages below.
SIBLINGS, UNLIKE = 20, 0.5
#: Standard errors between a branch's share and its siblings' for it to stay by itself.
DIFFERENT = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(?:\d+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,})(?:\.\w+)?$"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or its parent domains and begins the path, and what it says."""
    rule = verdict = None
    for say, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def segments(path: Column) -> Column:
    """The segments that aren't empty, those that are variable by form as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike(VARIABLE), "*").otherwise(x))


def _key(host: Column, segs: Column) -> Column:
    return F.concat(host, F.lit("/"), F.array_join(segs, "/"))


def branches(sums: DataFrame) -> DataFrame:
    """host, segs, labelled, bad, template for each row of sums (host, segs, n, labelled, bad)."""
    todo, done, d = sums.withColumn("template", F.lit("")), None, 0
    while True:
        todo = todo.withColumn("seg", F.coalesce(F.get("segs", F.lit(d)), F.lit("")))
        at = todo.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("paths"))
        above = at.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("paths").alias("all_paths"), F.count_if(F.col("seg") != "").alias("kinds"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        both = at.join(above, ["host", "template"])
        share, pooled = F.col("bad") / F.col("labelled"), F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-4)) / F.col("labelled"))
        unlike = F.coalesce((F.col("labelled") > 0) & (F.abs(share - pooled) > DIFFERENT * error), F.lit(False))
        many = (F.col("kinds") >= SIBLINGS) & (F.col("kinds") >= UNLIKE * F.col("all_n"))
        own = F.when(F.col("seg") == "", "").when((F.col("seg") == "*") | many | ~unlike, "/*").otherwise(F.concat(F.lit("/"), "seg"))
        step = both.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_s"), own.alias("own"), (F.col("all_paths") == 1).alias("alone"))
        now = todo.join(step, (todo.host == F.col("_h")) & (todo.template == F.col("_t")) & (todo.seg == F.col("_s")))
        rest = F.repeat(F.lit("/*"), F.greatest(F.size("segs") - d, F.lit(0)).cast("int"))
        template = F.concat("template", F.when(F.col("alone"), rest).otherwise(F.col("own")))
        ends = F.col("alone") | (F.col("seg") == "")
        # a row for each path that isn't done yet; the next level reads it twice
        now = Cut(now.select("host", "segs", "n", "labelled", "bad", template.alias("template"), ends.alias("ends")), "templates").df
        ended = now.where("ends").drop("ends")
        done = ended if done is None else done.unionByName(ended)
        todo, d = now.where("not ends").drop("ends"), d + 1
        if todo.isEmpty():
            return done


def templates(sums: DataFrame) -> DataFrame:
    """host, segs, labelled, bad, template, purity (null for a host without a labelled page) for each row of sums (host, segs, n, labelled, bad)."""
    now = branches(sums)
    total = sums.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = sums.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    prior = F.coalesce(F.col("tb") / F.nullif(F.col("tl"), F.lit(0)), F.lit(0.0))
    hosts = hosts.crossJoin(F.broadcast(total.select(F.col("l").alias("tl"), F.col("b").alias("tb"))))  # one row
    hosts = hosts.select(F.col("host").alias("_h"), F.when(F.col("l") > 0, (F.col("b") + SMOOTH * prior) / (F.col("l") + SMOOTH)).alias("host_share"))
    pure = now.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    pure = pure.join(hosts, pure.host == hosts["_h"]).select(F.col("host").alias("_h"), F.col("template").alias("_t"), ((F.col("b") + SMOOTH * F.col("host_share")) / (F.col("l") + SMOOTH)).alias("purity"))
    return now.join(pure, (now.host == F.col("_h")) & (now.template == F.col("_t"))).drop("_h", "_t")


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, template, purity for each row. labels: id and bad (0 or 1), for pages that no rule decides."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    own = pages.select(F.col(id_col).alias("i"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("*", rule.alias("rule"), said.alias("said"), segments(F.col("path")).alias("segs"))
    bad = F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int"))
    if labels is not None:
        given = labels.groupBy(F.col(labels.columns[0]).alias("_g")).agg(F.max(labels.columns[1]).cast("int").alias("_bad"))
        own = own.join(given, own.i == F.col("_g"), "left").drop("_g")
        bad = F.coalesce(bad, F.col("_bad"))
    sums = own.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    sums = Cut(sums, "paths").df
    made = templates(sums).select(_key(F.col("host"), F.col("segs")).alias("k"), "template", "purity")
    out = own.join(made, _key(F.col("host"), F.col("segs")) == made.k)
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("i").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
