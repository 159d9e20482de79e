"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as Spark expressions. The model is trained on a small labelled table of URLs with the DataFrame
API's own logistic regression, by a call of this module, which keeps its weights in a file beside it; of a fixed number,
they go into the plan as one literal.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and the verdict that the
model gives to an empty URL. Every row is returned, repeated rows too. Extra columns are not looked at.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_table import labelled_urls

#: (host, path prefix, verdict). Fixed values.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Buckets of host n-grams, and as many of path n-grams; sizes of n-grams.
DIMENSIONS, SIZES = 1 << 14, (3, 4, 5)
#: How much more harmless URLs weigh in the fit, its L2 penalty, and where the weights that ``python -m glossaria.llm.url_filter`` has learned are kept.
CAUTION, PENALTY, WEIGHTS = 3.0, 1e-4, Path(__file__).with_name("url_weights.json")


def host(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end; A-Z lower-cased."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, written as host and path; null where none does."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p) for h, p, _ in longest]
    return F.coalesce(*(F.when(cond, F.lit(name)) for cond, name in fits))


def buckets(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The distinct buckets of all character n-grams of ``text`` between two marks."""
    marked = F.concat(F.lit("^"), F.lower(text), F.lit("$"))

    def grams(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(marked.substr(i, F.lit(size))), F.lit(dimensions)).cast("int"))

    return F.array_distinct(F.concat(*(grams(n) for n in SIZES)))


@dataclass
class UrlModel:
    """Weights of the buckets of hosts and paths, and the intercept. Of a fixed size, so it goes into plans as text."""

    hosts: list[float]
    paths: list[float]
    intercept: float

    def score(self, host: Column, path: Column) -> Column:
        """Likelihood of block. Each part adds its buckets' weights, divided by the root of their number."""

        def part(text: Column, weights: list[float]) -> Column:
            found = buckets(text, len(weights))
            table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
            return F.aggregate(found, F.lit(0.0), lambda total, i: total + F.get(table, i)) / F.sqrt(F.size(found))

        return 1 / (1 + F.exp(-(part(host, self.hosts) + part(path, self.paths) + F.lit(self.intercept))))


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, penalty: float = PENALTY, caution: float = CAUTION) -> UrlModel:
    """Learns from rows (url, label); label 1: block. All rows of label 0 weigh ``caution`` times as much as those of 1."""
    url = F.col("url")
    found = labelled.select("label", *(buckets(part, dimensions).cast("array<string>").alias(n) for n, part in (("h", host(url)), ("p", path(url))))).coalesce(1).cache()
    counters = {n: CountVectorizer(inputCol=n, outputCol=f"{n}_all", vocabSize=dimensions, binary=True).fit(found) for n in "hp"}
    shares = found
    for n, counter in counters.items():
        shares = Normalizer(inputCol=f"{n}_all", outputCol=f"{n}_part", p=2.0).transform(counter.transform(shares))
    shares = VectorAssembler(inputCols=["h_part", "p_part"], outputCol="features").transform(shares)
    sizes = {r["label"]: r["count"] for r in shares.groupBy("label").count().collect()}
    shares = shares.withColumn("weight", F.when(F.col("label") == 1, 1.0 / max(1, sizes.get(1.0, 0))).otherwise(caution / max(1, sizes.get(0.0, 0))))
    model = LogisticRegression(regParam=penalty, maxIter=100, standardization=False, weightCol="weight").fit(shares)
    found.unpersist()
    weights, learned = [[0.0] * dimensions for _ in "hp"], iter(model.coefficients.toArray().tolist())
    for part, counter in zip(weights, counters.values(), strict=True):
        for bucket, weight in zip(counter.vocabulary, learned, strict=False):
            part[int(bucket)] = round(weight, 5)
    return UrlModel(*weights, float(model.intercept))


@cache
def pretrained() -> UrlModel:
    """The kept weights: what ``train`` learns from ``labelled_urls``. A change of the table or the fit needs them anew."""
    kept = json.loads(WEIGHTS.read_text())
    weights = {n: [0.0] * kept["dimensions"] for n in ("hosts", "paths")}
    for n, values in weights.items():
        for bucket, weight in kept[n]:
            values[bucket] = weight
    return UrlModel(weights["hosts"], weights["paths"], kept["intercept"])


def keep(model: UrlModel) -> None:
    some = {n: [[i, w] for i, w in enumerate(ws) if w] for n, ws in (("hosts", model.hosts), ("paths", model.paths))}
    WEIGHTS.write_text(json.dumps({"dimensions": len(model.hosts), "intercept": model.intercept, **some}, separators=(",", ":")) + "\n")


def url_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path and the rule that fits, for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (likelihood of block) for every row."""
    judge = model or pretrained()
    rows = url_parts(pages, id_col, url_col, rules).withColumn("score", judge.score(F.col("host"), F.col("path")))
    by_rule = F.create_map(*(F.lit(x) for h, p, v in rules for x in (h + p, v)))
    verdict = F.coalesce(F.element_at(by_rule, F.col("rule")), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


if __name__ == "__main__":
    keep(train(labelled_urls(SparkSession.builder.master("local[4]").getOrCreate())))
