"""URL filters: host and path rules first, boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule decides, which are its labelled URLs. Features: lengths, depth, digit and
hyphen ratios, character entropy, parameter count, and how often the other labelled URLs whose hosts have the same last
one and two labels are blocked (smoothed, counted over all labelled rows but the row itself). Everything but the fit of
the trees is DataFrame expressions.

Training takes at most ``PER_CLASS`` URLs of each verdict, chosen by hash over all that a rule decides; of rows with one
page_id, one.

Defined results: host and path of a null url, or one without "://", are empty; no rule fits them and the trees judge
them by their (empty) features. Where no rule decides both verdicts, the method's verdict is allow. Rules of equal
length go by their text. Repeated rows get equal verdicts. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, table

PER_CLASS = 8192
TREES, DEPTH = 20, 4
SMOOTHING = 10.0
#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def parsed(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c)))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0))
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1))) - total / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    url = F.coalesce(url, F.lit(""))
    share = lambda text, kind: F.length(F.regexp_replace(text, f"[^{kind}]", "")) / F.greatest(F.length(text), F.lit(1))
    parts = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    numbers = [F.length(url), F.length(host), F.length(path), parts(path, "/"), parts(host, "."), share(url, "0-9"), share(host, "0-9"), parts(host, "-"), _entropy(url), _entropy(host), F.when(query == "", 0).otherwise(parts(query, "&") + 1), F.length(query), url.startswith("https:").cast("int")]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in numbers]


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, per_class: int = PER_CLASS) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"suffix": F.substring_index("host", ".", -2), "top": F.substring_index("host", ".", -1)})
    blocked = (F.col("ruled.verdict") == "block").cast("double")
    known = rows.where("ruled is not null")
    # one pass over the labelled rows: counts by suffix, from which those of the last label are summed
    counts = hold(known.groupBy("suffix", "top").agg(F.sum(blocked).alias("b"), F.count("*").alias("n")))
    total = counts.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    if not total.n or not 0 < total.b < total.n:
        return rows.select("page_id", "host", "path", "ruled.rule", F.coalesce("ruled.verdict", F.lit("allow")).alias("verdict"))
    base = total.b / total.n
    own = F.col("ruled").isNotNull().cast("double")
    rates = []
    for key in ("suffix", "top"):
        b, n = f"{key}_b", f"{key}_n"
        rows = rows.join(counts.groupBy(key).agg(F.sum("b").alias(b), F.sum("n").alias(n)), key, "left")
        rates.append((F.coalesce(b, F.lit(0.0)) - own * F.coalesce(blocked, F.lit(0.0)) + SMOOTHING * base) / (F.coalesce(n, F.lit(0)) - own + SMOOTHING))
    numbers = lexical(F.col("url"), F.col("host"), F.col("path")) + rates
    dense = rows.select("page_id", "host", "path", "ruled", F.array(*numbers).alias("numbers"))
    y = (F.col("ruled.verdict") == "block").cast("double").alias("y")
    picked = known.where("page_id is not null").groupBy(y, F.pmod(F.xxhash64("page_id"), F.lit(per_class)).alias("slot")).agg(F.min_by("page_id", F.xxhash64("page_id", F.lit(7))).alias("page_id")).select("page_id")
    sample = dense.join(F.broadcast(picked.distinct()), "page_id", "left_semi").where("ruled is not null")
    sample = sample.groupBy("page_id").agg(F.min(F.struct(y, "numbers")).alias("row")).select("row.y", array_to_vector("row.numbers").alias("features"))
    sample = hold(sample)
    if sample.select("y").distinct().count() < 2:
        return dense.select("page_id", "host", "path", "ruled.rule", F.coalesce("ruled.verdict", F.lit("allow")).alias("verdict"))
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, minInstancesPerNode=5).fit(sample)
    said = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return trees.transform(dense.withColumn("features", array_to_vector("numbers"))).select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", said).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
