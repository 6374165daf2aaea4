"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with
the rule's; the longest rule that fits decides. Other urls are judged by a logistic
regression on the hashed character n-grams of host and path, trained from a small
labelled URL table (a file of site names, or any table given); names without a word in
common with a labelled one are judged by chance n-grams, see ``held_out_figures``. All is DataFrame functions and Spark's own estimators: a scan of the
url column, no shuffle, and a model whose size is fixed.

A null url, or one without ``://``, has an empty host and path; no rule fits it and its
only n-grams are those of the empty strings' marks. A label other than 0 and 1 isn't
learnt from. Repeated rows are judged one by one; an empty table gives an empty result.
Extra columns aren't read. Rules are a short list that is part of the settings.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Table of site names (name, label 1 to block or 0 to allow, topic), written by hand by topic and not from
#: any given pages. The labelled table has each under several hosts and paths, so that what all sites share
#: carries no weight.
SITES = Path(__file__).with_name("labelled_sites.csv")
#: Parts the names are cut into, each left out once by ``held_out_figures``.
FOLDS = 5
HOSTS = ("{}.example.com", "www.{}.example.org", "{}.example.net", "blog.{}.org", "m.{}.net")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "")
SIZES = (3, 4, 5)
BUCKETS = 1 << 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], then: int) -> Column:
    """Of the longest rule that fits: its verdict (``then`` = 0) or its text (1); else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule[1].partition("/")
        fits = (host == name) | F.endswith(host, F.lit(f".{name}"))
        found = F.when(fits & F.startswith(path, F.lit(f"/{start}")), F.lit(rule[then])).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, each marked as of host or path."""

    def of(mark: str, value: Column, n: int) -> Column:
        text = F.concat(F.lit("^"), value, F.lit("$"))
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))

    return F.concat(*[of(mark, value, n) for mark, value in (("h", host), ("p", path)) for n in SIZES])


def hashing() -> HashingTF:
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BUCKETS, binary=True)


def labelled_urls(spark: SparkSession, sites: str | Path = SITES) -> DataFrame:
    """(name, url, label) of a table of names: every name under a few hosts and paths, in turn."""
    rows = []
    with open(sites, encoding="utf-8", newline="") as file:
        for n, site in enumerate(csv.DictReader(file)):
            for k in range(3):
                host, path = HOSTS[(n + k) % len(HOSTS)], PATHS[(n * 3 + k) % len(PATHS)]
                rows.append((site["name"], f"https://{host.format(site['name'])}{path.format(7919 * (n + 1) % 9973)}", int(site["label"])))
    one = [F.struct(F.lit(name).alias("name"), F.lit(url).alias("url"), F.lit(label).alias("label")) for name, url, label in rows]
    return spark.range(1).select(F.inline(F.array(*one)))


def train(labelled: DataFrame, url: str = "url", label: str = "label") -> LogisticRegressionModel:
    host, path = split_url(F.col(url))
    rows = labelled.where(F.col(label).isin(0, 1)).select(grams(host, path).alias("__grams"), F.col(label).cast("double").alias("__label"))
    estimator = LogisticRegression(featuresCol="__features", labelCol="__label", regParam=1e-3, maxIter=40, standardization=False)
    return estimator.fit(hashing().transform(rows))


def judge(urls: DataFrame, model: LogisticRegressionModel, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, score (P(block)) and verdict."""
    host, path = split_url(F.col(url))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict")]
    split = urls.select(*kept, host.alias("host"), path.alias("path"))
    split = split.withColumn("__grams", grams(F.col("host"), F.col("path")))
    model = model.copy().setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(hashing().transform(split)).withColumn("score", vector_to_array("__p")[1])
    by_rule = [longest_rule(F.col("host"), F.col("path"), rules, k) for k in (0, 1)]
    verdict = F.coalesce(by_rule[0], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(*kept, "host", "path", by_rule[1].alias("rule"), "score", verdict.alias("verdict"))


def held_out_figures(labelled: DataFrame, name: str = "name", url: str = "url", label: str = "label", threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall of blocking, without rules, each name judged by a model that hasn't seen it; and the urls judged."""
    hits = blocked = wanted = n = 0
    for k in range(FOLDS):
        out = fold(name, FOLDS) == k
        rows = judge(labelled.where(out), train(labelled.where(~out), url, label), url, (), threshold)
        block, bad = F.col("verdict") == "block", F.col(label) == 1
        r = rows.select(*[F.count_if(c) for c in (block & bad, block, bad)], F.count(F.lit(1))).first()
        hits, blocked, wanted, n = hits + r[0], blocked + r[1], wanted + r[2], n + r[3]
    return {"precision": hits / max(1, blocked), "recall": hits / max(1, wanted), "urls": n}


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op4_url_filter": (op4_url_filter, None)}
