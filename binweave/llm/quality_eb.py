"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A classifier gives each document the log odds of being of good quality and of being toxic.
Sums over paths and hosts (grouped aggregation, combined before the shuffle) then give
posteriors: a host's rate is shrunk to the corpus, a path's to its host, each with a beta
prior whose weight comes from the spread of the rates less the noise within sites (see
shrink.py); a sparse site stays close to its prior. The document's odds are moved by the
odds of its path over those of the corpus. Documents have no URL: a host is a source, and
the languages within a source stand for its paths; both are parameters.

The classifier is fitted on a bounded sample of labelled rows (``sample``, the rows of least
hash); everything else covers all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, guarded, lean, materialise
from .host_rules import SPACES, SYMBOLS
from .mixing import uniform
from .shrink import posterior, prior_weight

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 4000
#: Words, for each label, whose presence the classifier weighs.
LEXICON = 60
EDGES = b".,;:!?\"'()"
FEATURES = 9
HEADS = ("quality", "toxic")


def distinct_words(text: str | None) -> set[bytes]:
    """Lower-cased words without marks at their ends."""
    return {w.strip(EDGES) for w in set((text or "").encode().lower().split())} - {b""}


def shape(text: str | None) -> list[float]:
    """Numbers that describe a text's form; those of an empty text are 0."""
    words = (text or "").split()
    if not words:
        return [0.0] * FEATURES
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    return [
        math.log1p(n) / 10,
        chars / n / 10,
        upper / n,
        sum(map(text.count, SYMBOLS)) / n,
        text.count("!") / n,
        text.count("|") / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(words)) / n,
        sum(1 for w in words if w[:1].isdigit()) / n,
    ]


class Model:
    """Log odds of good quality and of toxicity: logistic regression on the shape and on
    the log odds of the lexicon's words that a text holds (their sum, and the largest)."""

    def __init__(self, lexicons: dict[str, dict[bytes, float]], weights: dict[str, np.ndarray] | None = None):
        self.lexicons, self.weights = lexicons, weights or {}

    def rows(self, texts) -> dict[str, np.ndarray]:
        out: dict[str, list] = {head: [] for head in HEADS}
        for t in texts:
            form, words = shape(t), distinct_words(t)
            for head in HEADS:
                lexicon = self.lexicons[head]
                odds = [lexicon[w] for w in lexicon.keys() & words]
                out[head].append([1.0, *form, max(-6.0, min(6.0, sum(odds))), max(odds, key=abs, default=0.0)])
        return {head: np.array(x, dtype=float).reshape(-1, FEATURES + 3) for head, x in out.items()}

    def score(self, texts) -> dict[str, np.ndarray]:
        return {h: np.clip(x @ self.weights[h], -12, 12) for h, x in self.rows(texts).items()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Newton steps; a small ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """A model fitted on at most ``sample`` labelled documents: rows (key, quality, toxic) of
    least hash. Rows whose key or labels are null don't count; labels that repeat a key count
    once, the larger of each; of documents that repeat a key the least text counts; equal
    hashes go by key; without labels the model gives log odds 0. Lexicons and weights are
    fitted on the same rows: fitting each half's weights with the other half's lexicons gave
    no better results on held-out labels."""
    chosen = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    chosen = chosen.groupBy(F.col(key).alias("__k")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(uniform(F.col("__k"), "fit"), "__k").limit(sample)
    # at most ``sample`` rows
    chosen = docs.select(F.col(f"`{key}`").alias("__k"), F.col(text).alias("text")).join(F.broadcast(chosen), "__k").where("text is not null")
    chosen = chosen.groupBy("__k").agg(F.min("text").alias("text"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = materialise(chosen, "labelled")
    model = Model(_lexicons(chosen, lexicon))

    def numbers(batches):
        for pdf in batches:
            x = model.rows(pdf["text"])
            yield pd.DataFrame({"q": pdf["quality"], "t": pdf["toxic"], "xq": list(x["quality"]), "xt": list(x["toxic"])})

    held = chosen.select("text", "quality", "toxic").mapInPandas(numbers, "q double, t double, xq array<double>, xt array<double>").toPandas()  # at most ``sample`` rows
    for head, x, y in (("quality", "xq", "q"), ("toxic", "xt", "t")):
        both = held[y].nunique() > 1
        model.weights[head] = logistic(np.stack(held[x].to_numpy()), held[y].to_numpy()) if both else np.zeros(FEATURES + 3)
    return model


def _lexicons(rows: DataFrame, size: int) -> dict[str, dict[bytes, float]]:
    """For each head the log odds of the words that tell its labels apart most surely."""
    words = F.pandas_udf(lambda ts: pd.Series([sorted(w.decode("utf-8", "ignore") for w in distinct_words(t)) for t in ts], dtype=object), "array<string>")
    n, *good = rows.agg(F.count("*"), *[F.coalesce(F.sum(h), F.lit(0)) for h in HEADS]).first()
    seen = rows.select(*HEADS, F.explode(words("text")).alias("word"))
    seen = seen.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).where("n >= 4")
    out = {}
    for head, g in zip(HEADS, good):
        a, b = F.col(head) + 0.5, F.col("n") - F.col(head) + 0.5
        odds = F.ln(a / F.lit(g + 1.0)) - F.ln(b / F.lit(n - g + 1.0))
        top = seen.select("word", odds.alias("odds"), (F.abs(odds) / F.sqrt(1 / a + 1 / b)).alias("z")).where("z > 3")
        out[head] = {r["word"].encode(): r["odds"] for r in top.orderBy(F.desc("z"), "word").limit(size).collect()}
    return out


def scores(model: Model, text: Column) -> Column:
    """A struct of probabilities; of null and empty texts too, as their form has it. Texts
    that repeat score alike; very long ones are scored whole."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame({h: 1 / (1 + np.exp(-x)) for h, x in model.score(texts).items()})

    return F.pandas_udf(lean(run), "quality double, toxic double")(text)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def site_posteriors(scored: DataFrame, host: str = "source", path: str = "lang", score: str = "__s") -> tuple[DataFrame, dict[str, float]]:
    """Rows (__h, __p, host_quality, host_toxic, path_quality, path_toxic) for the sites of rows
    that hold a struct of probabilities, and the corpus's mean of each."""
    sums = [x for h in HEADS for x in (F.sum(f"{score}.{h}").alias(h), F.sum(F.col(f"{score}.{h}") * F.col(f"{score}.{h}")).alias(f"{h}_2"))]
    paths = materialise(scored.groupBy(F.col(f"`{host}`").alias("__h"), F.col(f"`{path}`").alias("__p")).agg(F.count("*").alias("n"), *sums), "paths")
    sums = [F.sum(c).alias(f"h_{c}") for h in HEADS for c in (h, f"{h}_2")]
    hosts = materialise(paths.groupBy("__h").agg(F.sum("n").alias("hn"), *sums), "sites")
    totals = hosts.agg(F.sum("hn"), *[F.sum(f"h_{h}") for h in HEADS]).first()
    everything = {h: (totals[i + 1] / totals[0] if totals[0] else 0.5) for i, h in enumerate(HEADS)}
    host_weight = {h: prior_weight(hosts, "hn", f"h_{h}", f"h_{h}_2") for h in HEADS}
    path_weight = {h: prior_weight(paths, "n", h, f"{h}_2", ["__h"]) for h in HEADS}
    by_host = [posterior(F.col(f"h_{h}"), F.col("hn"), F.lit(everything[h]), host_weight[h]).alias(f"host_{h}") for h in HEADS]
    hosts = hosts.select(F.col("__h").alias("__hh"), *by_host)
    by_path = [posterior(F.col(h), F.col("n"), F.col(f"host_{h}"), path_weight[h]).alias(f"path_{h}") for h in HEADS]
    posts = paths.join(hosts, F.col("__h").eqNullSafe(F.col("__hh"))).select("__h", "__p", *[f"host_{h}" for h in HEADS], *by_path)
    return posts, everything


def classified(scored: DataFrame, host: str = "source", path: str = "lang", score: str = "__s") -> DataFrame:
    """Rows that hold a struct of probabilities, with the struct __quality in its place. They
    are read twice: pass a written table."""
    posts, everything = site_posteriors(scored, host, path, score)
    posts = posts.select("__h", "__p", F.struct(*posts.columns[2:]).alias("__post"))
    rows = scored.join(posts, F.col(f"`{host}`").eqNullSafe(F.col("__h")) & F.col(f"`{path}`").eqNullSafe(F.col("__p")), "left")
    combined = {}
    for h in HEADS:
        z = logit(F.col(f"{score}.{h}")) + logit(F.coalesce(F.col(f"__post.path_{h}"), F.lit(everything[h]))) - logit(F.lit(everything[h]))
        combined[h] = 1 / (1 + F.exp(-z))
    fields = [F.col(f"{score}.{h}").alias(f"doc_{h}") for h in HEADS] + [F.col(f"__post.{x}_{h}").alias(f"{x}_{h}") for x in ("host", "path") for h in HEADS]
    fields += [combined[h].alias(h) for h in HEADS] + [((combined["quality"] >= 0.5) & (combined["toxic"] < 0.5)).alias("kept")]
    return rows.withColumn("__quality", F.struct(*fields)).drop(score, "__h", "__p", "__post")


@guarded
def classify(docs: DataFrame, model: Model, text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """docs with a struct __quality: for each head the document's own probability, the
    posteriors of host and path, and the combined probability; and kept: quality at least
    one half and toxicity below it. A null host or path is one of its own; an empty table
    stays empty; rows that repeat count as often as they come; columns whose names clash
    with internal ones pass unchanged. Texts are scored once: the rows are written and read
    again."""
    return classified(materialise(docs.withColumn("__s", scores(model, F.col(text))), "scored"), host, path)


def op1_quality_eb(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = materialise(docs.select("doc_id", "source", "lang", scores(model, F.col("text")).alias("__s")), "scored")
    return classified(scored).select("doc_id", "__quality.*")
