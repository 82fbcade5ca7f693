"""URL verdicts from rules and a path-template tree, in DataFrame operations only.

Rules decide the urls they fit; those urls also serve as labels. Segments that look generated (numbers, hashes, mixtures of
digits and letters) become ``*`` at once, which gives a path its shape. Per host, the shapes form a tree. A node whose labels are
all of one kind (or that has none, or one shape) is a leaf: it is a template. Any other node is split by the first segment in
which its shapes differ; a path that ends there is a branch too. Branches whose labels don't differ significantly
from what the node's rate lets expect merge into ``~``, unlabelled ones among them; the others keep their name. So a
template may have wildcards before a segment that tells.

The smoothed purity of a branch is ``(blocked labels + strength * purity of the node) / (labels + strength)``, and ``prior`` stands
for what is above a host: an unlabelled branch is judged as its node. A template with a purity of ``reject`` or more is blocked.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged with others of that
kind; a host without labels has the purity ``prior``; very long paths have as many segments as they have; a tie in significance
merges; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.plans.durable import durable, join_checked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A path segment with a digit run, a long hexadecimal run, or an escape is taken for generated.
GENERATED = r"^(.*[0-9].*|[0-9a-f]{16,}|.*%[0-9a-fA-F]{2}.*|.{64,})$"


def parts(url: Column) -> tuple[Column, Column]:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def fitting(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, else null. A rule is a domain and the start of a path, such as ``org/es/``."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first, so it goes on last
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), "")


def _split(shapes: DataFrame, strength: float, significance: float) -> tuple[DataFrame, DataFrame]:
    """The shapes whose node is a leaf, with its template, and the others with the node of the branch that they follow.

    shapes: host, shape, seen, bad, and of the node: template, purity, and ``at``, the segments behind it.
    """
    node = ["host", "template"]
    rest = F.slice("shape", F.col("at") + 1, F.size("shape"))
    nodes = shapes.groupBy(*node).agg(F.sum("seen").alias("n_seen"), F.sum("bad").alias("n_bad"), F.min(rest).alias("low"), F.max(rest).alias("high"))
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))  # what the least and the greatest share, all do
    one = F.col("low") == F.col("high")
    share = F.when(one, F.size("low")).otherwise((differ - 1).cast("int"))
    leaf = (F.col("n_bad") == 0) | (F.col("n_bad") == F.col("n_seen")) | one
    below = F.concat("template", _joined(F.slice("low", F.lit(1), share)), F.when(leaf & ~one, "/~").otherwise(""))
    nodes = durable(nodes.select(*node, "n_seen", "n_bad", share.alias("share"), leaf.alias("leaf"), below.alias("below")), "url-nodes")
    met = join_checked(shapes, nodes, node)
    ended = met.filter("leaf").select("host", "shape", F.col("below").alias("template"), "purity")
    segment = F.coalesce(F.try_element_at("shape", F.col("at") + F.col("share") + 1), F.lit(""))  # "": the path ends here
    met = met.filter(~F.col("leaf")).withColumn("segment", segment).withColumn("at", F.col("at") + F.col("share") + 1)

    of_node = [*node, "below", "n_seen", "n_bad", "purity"]
    branches = met.groupBy(*of_node, "segment").agg(F.sum("seen").alias("b_seen"), F.sum("bad").alias("b_bad"))
    p = (F.col("n_bad") + 0.5) / (F.col("n_seen") + 1.0)
    off = F.col("b_bad") - F.col("b_seen") * p
    alike = off * off <= F.col("b_seen") * p * (1.0 - p) * F.lit(significance * significance)
    branches = durable(branches.withColumn("alike", alike), "url-branches")
    counts = branches.groupBy(*node).agg(F.count_if("alike").alias("n_alike"), F.count("*").alias("n_all"))
    name = F.when(F.col("alike") & (F.col("n_alike") > 1), "~").otherwise(F.col("segment"))
    named = durable(join_checked(branches, counts, node).withColumn("name", name), "url-names")
    child = named.groupBy(*of_node, "name", "n_all").agg(F.sum("b_seen").alias("c_seen"), F.sum("b_bad").alias("c_bad"), F.count("*").alias("n_in"))
    purity = F.when(F.col("n_in") == F.col("n_all"), F.col("purity")).otherwise((F.col("c_bad") + strength * F.col("purity")) / (F.col("c_seen") + strength))
    child = child.select(*node, "name", F.concat("below", F.lit("/"), "name").alias("next"), purity.alias("next_purity"))
    to = join_checked(named.select(*node, "segment", "name"), child, [*node, "name"]).select(*node, "segment", "next", "next_purity")
    went = join_checked(met.select(*node, "segment", "shape", "seen", "bad", "at"), durable(to, "url-children"), [*node, "segment"])
    return ended, went.select("host", "shape", "seen", "bad", F.col("next").alias("template"), F.col("next_purity").alias("purity"), "at")


def judge(pages: DataFrame, rules: dict[str, str], strength: float = 2.0, prior: float = 0.5, reject: float = 0.8, significance: float = 1.96) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for a table with ``page_id, url``."""
    host, path = parts(F.col("url"))
    verdict = reduce(lambda c, r: c.when(F.col("rule") == r, rules[r]), rules, F.when(F.lit(False), ""))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    shape = F.transform(segments, lambda s: F.when(s.rlike(GENERATED), "*").otherwise(s))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", fitting(F.col("host"), F.col("path"), rules)).withColumn("label", verdict).withColumn("shape", shape)
    shapes = durable(seen.groupBy("host", "shape").agg(F.count("label").alias("seen"), F.count_if(F.col("label") == "block").alias("bad")), "url-shapes")
    hosts = shapes.groupBy("host").agg(((F.sum("bad") + strength * prior) / (F.sum("seen") + strength)).alias("purity"))
    open_ = durable(join_checked(shapes, hosts, ["host"]).select("host", "shape", "seen", "bad", F.lit("").alias("template"), "purity", F.lit(0).alias("at")), "url-level0")
    done: list[DataFrame] = []
    while not open_.isEmpty():  # once for each level at which some host's labels still differ
        ended, open_ = (durable(part, "url-level") for part in _split(open_, strength, significance))
        done.append(ended)
    if not done:
        done = [open_.select("host", "shape", "template", "purity")]
    out = join_checked(seen, durable(reduce(DataFrame.unionByName, done), "url-templates"), ["host", "shape"])
    method = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity")
