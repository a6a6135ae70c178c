"""Url verdicts: host and path rules, then boosted trees on lexical features."""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
LABELLED_ROWS = 20_000  # most rows the trees are fitted on, chosen by hash of the url
SMOOTHING = 20.0
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&#:%"
FEATURES = ("length", "host_length", "path_length", "depth", "dots", "hyphens", "digits",
            "digit_ratio", "entropy", "parameters", "query_length", "fragment", "suffix_rate",
            "suffix2_rate", "suffix_size")


def host_and_path(url):
    """(host, path) columns of a url column; both empty without `://` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    # A-Z only: lower() would also fold other letters
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host, path, rules=RULES):
    """(rule, verdict) columns of the longest rule that fits; null where none does.

    A rule `host/path` fits its host and all its subdomains where the path starts with the rule's.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = (((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at])))
                & F.startswith(path, F.lit(rule[at:])))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _count(text, what):
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def lexical(frame: DataFrame) -> DataFrame:
    """Adds the lexical features of `url`, `host` and `path`, and the url's one- and two-part suffix."""
    url = F.lower(F.coalesce("url", F.lit("")))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", "")).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.array(*[F.lit(c) for c in SYMBOLS]), F.lit(0.0),
        lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return frame.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": _count(F.col("path"), "/"),
        "dots": _count(F.col("host"), "."), "hyphens": _count(F.col("host"), "-"),
        "digits": digits, "digit_ratio": digits / n, "entropy": entropy,
        "parameters": _count(query, "="), "query_length": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2),
    })


def _rates(labelled, suffix, rate):
    """Smoothed share of blocked urls per suffix, over all labelled rows."""
    base = labelled.agg(F.avg("label").alias("base"))
    return labelled.groupBy(suffix).agg(F.sum("label").alias("hit"), F.count("*").alias("n")).join(
        base).select(suffix, ((F.col("hit") + SMOOTHING * F.col("base")) / (F.col("n") + SMOOTHING))
                     .alias(rate), F.log1p("n").alias(f"{suffix}_n"))


class UrlModel:
    """Suffix statistics and boosted trees fitted on labelled urls."""

    def __init__(self, suffixes, doubles, base, trees):
        self.suffixes, self.doubles, self.base, self.trees = suffixes, doubles, base, trees

    def features(self, frame):
        joined = frame.join(self.suffixes, "suffix", "left").join(self.doubles, "suffix2", "left")
        return joined.withColumns({
            "suffix_rate": F.coalesce("suffix_rate", F.lit(self.base)),
            "suffix2_rate": F.coalesce("suffix2_rate", F.lit(self.base)),
            "suffix_size": F.coalesce("suffix_n", F.lit(0.0))}).drop("suffix_n", "suffix2_n")

    def score(self, frame):
        """Adds `block_score`, the probability of a block."""
        featured = self.features(lexical(frame))
        if self.trees is None:
            return featured.withColumn("block_score", F.lit(self.base))
        packed = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)
        return self.trees.transform(packed).withColumn(
            "block_score", vector_to_array("probability")[1])


def train(labelled: DataFrame, rows=LABELLED_ROWS, trees=20, depth=4) -> UrlModel:
    """A model from (url, host, path, label), label 1 for block.

    Suffix statistics cover all rows; the trees are fitted on at most `rows`, the smallest by hash of
    the url. With one label or none every score is the share of blocks (0 without rows).
    """
    known = materialize(lexical(labelled).withColumn("label", F.col("label").cast("double")))
    seen = known.agg(F.avg("label").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).first()
    model = UrlModel(_rates(known, "suffix", "suffix_rate"), _rates(known, "suffix2", "suffix2_rate"),
                     float(seen["m"] or 0.0), None)
    if seen["a"] == seen["b"]:
        return model
    sample = known.orderBy(F.xxhash64("url"), "url").limit(rows)
    packed = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        materialize(model.features(sample).select(*FEATURES, "label")))
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=2, stepSize=0.2).fit(packed)
    return model


def judge_urls(pages: DataFrame, page_id="page_id", url="url", rules=RULES, labelled=None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    The longest fitting rule decides; where none fits, the trees do (block from 0.5). `labelled` has
    (url, label); by default the urls that a rule decides are the labelled ones. Null urls, and those
    without `://`, have empty host and path and no rule, and are judged by their features. Repeated
    rows are judged alike, each for itself. An empty table gives no rows. Other columns are not read.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    named = named.withColumn("host", host).withColumn("path", path)
    rule, decided = match_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumn("rule", rule).withColumn("decided", decided)
    if labelled is None:
        known = named.where("decided is not null").select(
            "url", "host", "path", (F.col("decided") == "block").cast("double").alias("label"))
    else:
        known = labelled.select("url", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))],
                                "label").where("label is not null")
    scored = train(known).score(named)
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("decided", learned).alias("verdict"), "block_score")
