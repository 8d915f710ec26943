"""Quality classification by hierarchical empirical Bayes.

Three levels: all documents, hosts, and paths within a host. A classifier on surface features of the whole text gives
each document its evidence, the log likelihood ratio of good against bad text. Hosts and paths sum up their documents'
probabilities (one grouped aggregation); a host's rate is shrunk toward the global rate and a path's toward its host's,
the more the fewer documents they have. How much is learned from the spread of the rates between hosts and between
paths (method of moments). A document's probability combines its evidence with the rate of its path, from which its
own part has been taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, drawn_rows, fold, map_batches, stash
from gridspark.llm.toxicity import TRAIN_CHARS, logistic_fit

#: Labelled documents of each class that the fit reads, about, whole; TRAIN_CHARS characters at most in all.
TRAIN_DOCS = 3000
#: Host and path tables up to this number of rows are broadcast, larger ones joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bounds of the strength (in documents) of a prior, for where the spread says nothing.
WEAKEST, STRONGEST = 2.0, 1e6
UPPER, LETTERS, DIGITS = (bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(48, 58)))
SYMBOLS, SHOUTS = b"#$%&*|<>{}[]~^_=+\\/@", b"!?"


def features(text: str) -> list[float]:
    """Shares of kinds of characters and of repeated words in a whole text."""
    data = text.encode("utf-8")
    n = max(len(data), 1)
    share = lambda kinds: 1 - len(data.translate(None, kinds)) / n if data else 0.0
    words = data.split()
    m = len(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / max(m - 1, 1)
    return [1.0, share(UPPER), share(LETTERS), share(DIGITS), share(SYMBOLS), share(SHOUTS), again, len(set(words)) / max(m, 1), np.log1p(m) / 10, min(n / max(m, 1), 40) / 40]


def fit(rows: list[tuple[str, int]]) -> dict | None:
    """Weights and the share of good texts among (text, quality) rows; None without both classes."""
    y = np.array([q for _, q in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([features(t or "") for t, _ in rows])
    centre, width = x.mean(axis=0), x.std(axis=0) + 1e-6
    centre[0], width[0] = 0.0, 1.0
    return {"centre": centre, "width": width, "weights": logistic_fit((x - centre) / width, y), "prior": float(np.log(y.mean() / (1 - y.mean())))}


def sample(docs: DataFrame, labels: DataFrame, usable) -> list[tuple[str, int]]:
    """Texts and labels with the smallest hashes of the id in each class."""
    return [(text, quality) for _, text, quality in drawn_rows(docs, labels, usable, "quality", {1: TRAIN_DOCS, 0: TRAIN_DOCS}, TRAIN_CHARS)]


def evidence(docs: DataFrame, model: dict | None, host: str, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, host, path, evidence (log likelihood ratio) of every row; nulls are a host, path or text of their own ("")."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in by_size(batches, 1):
            if model is None:
                found = np.zeros(b.num_rows)
            else:
                x = np.array([features(t or "") for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
                found = np.clip(((x - model["centre"]) / model["width"]) @ model["weights"] - model["prior"], -12, 12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(found, pa.float64())], names=["id", "host", "path", "evidence"])

    chosen = docs.select(docs[id_col].alias("id"), docs["text"].alias("text"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), F.coalesce(docs[path].cast("string"), F.lit("")).alias("path"))
    return map_batches(chosen, run, f"id {kind}, host string, path string, evidence double")


def strength(groups: DataFrame, prior) -> float:
    """Documents that a prior counts for: m(1-m) / between-group variance - 1, the variance freed of its sampling part.

    groups: good (sum of probabilities), n; prior: the rate that each group is shrunk to.
    """
    r = groups.select("n", (F.col("good") / F.col("n")).alias("rate"), prior.alias("m")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("rate") - F.col("m"), 2)).alias("spread"), F.sum(F.col("m") * (1 - F.col("m"))).alias("noise"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("scale"), F.count("*").alias("k")
    ).first()
    if not r["n"] or r["k"] < 2:
        return STRONGEST
    between = (r["spread"] - r["noise"]) / r["n"]
    return float(min(max(r["scale"] / r["n"] / between - 1, WEAKEST), STRONGEST)) if between > 0 else STRONGEST


def classify(docs: DataFrame, model: dict | None, host: str, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score (probability of good quality).

    Sums are taken over decimals, so rates do not depend on the order of rows. Rows are kept as often as they come;
    an empty table gives no rows; without a model the evidence is 0 and every score is one half.
    """
    scored = stash(evidence(docs, model, host, path, id_col), "evidence")
    prior = model["prior"] if model else 0.0
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    rated = scored.withColumn("p", p)
    paths = stash(rated.groupBy("host", "path").agg(F.sum(F.col("p").cast("decimal(18,9)")).cast("double").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = whole["good"] / whole["n"] if whole["n"] else 0.5
    of_hosts = strength(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n")), F.lit(rate))
    both = stash(paths.join(hosts, "host"), "groups")
    of_paths = strength(both.select("good", "n", "host_good", "host_n"), (F.col("host_good") + F.lit(of_hosts * rate)) / (F.col("host_n") + F.lit(of_hosts)))
    if both.count() <= BROADCAST_ROWS:
        both = F.broadcast(both)
    own = rated.join(both, ["host", "path"])
    host_rate = (F.col("host_good") - F.col("p") + F.lit(of_hosts * rate)) / (F.col("host_n") - 1 + F.lit(of_hosts))
    path_rate = (F.col("good") - F.col("p") + F.lit(of_paths) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(of_paths))
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    rates = own.withColumn("host_rate", bounded(host_rate)).withColumn("path_rate", bounded(path_rate))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return rates.select(F.col("id").alias("doc_id"), "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"))


def held_out(doc_id="doc_id"):
    """Rows whose labels the fit never sees."""
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))
