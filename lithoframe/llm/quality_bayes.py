"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is the log odds that a logistic model gives its text statistics. A site's rate of good documents is shrunk towards the
rate of the whole corpus, and a path's rate towards its site's, the more the fewer documents there are; how much is estimated from the spread
between sites and between paths. The rate of the path, without the document itself, is the prior that the evidence is added to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import bounded_sample, small_side, stage
from lithoframe.llm.quality_rules import COUNTS, best_threshold, ratios, text_counts
from lithoframe.llm.toxicity import held_out


def text_features(counts: pd.DataFrame) -> np.ndarray:
    """Statistics of a text for the logistic model, on scales on which they are roughly even."""
    n = np.maximum(counts["n_words"].to_numpy(float), 1)
    r = ratios(counts)
    return np.column_stack([np.log(r[:, [0, 1, 2]] + 0.01), r[:, 3:], np.log(n), counts["n_repeat_words"].to_numpy(float) / n, counts["n_dup_lines"].to_numpy(float) / np.maximum(counts["n_lines"].to_numpy(float), 1)])


class Logistic:
    """Ridge logistic regression on standardised features and their squares, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, self.w = self._inputs(x), np.zeros(2 * x.shape[1] + 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            move = np.linalg.solve(hessian, z.T @ (y - p) - ridge * self.w)
            self.w += move
            if np.abs(move).max() < 1e-6:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), z, z * z])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.w, -30, 30))), 1e-6, 1 - 1e-6)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def shrinkage(groups: DataFrame, most: float = 1e4) -> float:
    """How many documents the rate of the level above weighs: by moments, from (n, s, up) rows of group size, sum of rates and rate above."""
    m = groups.filter("n >= 2").withColumn("v", F.col("up") * (1 - F.col("up")))
    got = m.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("up")) ** 2).alias("spread"), F.sum("v").alias("noise"), F.sum(F.col("n") * F.col("v")).alias("whole")).first()
    if not got["whole"]:
        return most
    between = max(0.0, got["spread"] - got["noise"]) / got["whole"]  # 1 / (1 + shrinkage), as spread = noise + sum of n * v / (1 + shrinkage)
    return float(np.clip(1 / between - 1, 1.0, most)) if between > 0 else most


def site_quality(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", sample: int = 20_000, keep: float = 0.998) -> DataFrame:
    """documents, labels(doc_id, quality 0/1) -> doc_id, held_out, evidence, site_rate, path_rate, score, kept.

    `site` and `path` name the columns of the two levels; a path belongs to its site. The logistic model is fitted on about `sample` distinct
    labelled rows at most that are not held out (picked by a hash); rates count all documents, a known label in place of the model's probability. score is the
    posterior probability of good quality; kept: it is at least the value that a share of `keep` of the labelled good rows
    reaches. Without labels of both kinds scores are 0.5 and all rows are kept. Null and empty texts have statistics of 0; null sites and paths are groups of their own. Repeated
    rows count repeatedly; an empty table gives none; other columns are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    places = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("\x01null")).alias("site"), F.coalesce(F.col(path).cast("string"), F.lit("\x01null")).alias("path"), "text")
    counts = places.mapInArrow(_with_counts, "doc_id long, site string, path string, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = stage(counts.join(known, "doc_id", "left"), "counts")
    seen = bounded_sample(stage(counts.filter("quality is not null"), "labelled"), sample).toPandas().sort_values(["doc_id", "site", "path", *COUNTS], ignore_index=True)
    if seen["quality"].nunique() < 2:
        return counts.select("doc_id", held_out("doc_id").alias("held_out"), *(F.lit(v).alias(k) for k, v in (("evidence", 0.0), ("site_rate", 0.5), ("path_rate", 0.5), ("score", 0.5))), F.lit(True).alias("kept"))
    model = Logistic(text_features(seen), seen["quality"].to_numpy(float))

    def judge(frames):
        for f in frames:
            yield f.assign(p=model(text_features(f)))[["doc_id", "site", "path", "quality", "p"]]

    rows = stage(counts.mapInPandas(judge, "doc_id long, site string, path string, quality int, p double").withColumn("v", F.coalesce(F.col("quality").cast("double"), F.col("p"))), "rates")
    paths = stage(rows.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    corpus = total["s"] / total["n"]
    sites = stage(paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s")), "sites")
    k1 = shrinkage(sites.select(F.col("site_n").alias("n"), F.col("site_s").alias("s"), F.lit(corpus).alias("up")))
    rate = lambda s, n, up, k: (k * up + s) / (k + n)
    both = stage(paths.join(sites, "site"), "levels")
    k2 = shrinkage(both.select("n", "s", rate(F.col("site_s"), F.col("site_n"), F.lit(corpus), k1).alias("up")))
    out = rows.join(small_side(both), ["site", "path"])
    site_rate = rate(F.col("site_s") - F.col("v"), F.col("site_n") - 1, F.lit(corpus), k1)
    out = out.withColumn("site_rate", site_rate).withColumn("path_rate", rate(F.col("s") - F.col("v"), F.col("n") - 1, F.col("site_rate"), k2))
    share = float(seen["quality"].mean())
    out = out.withColumn("evidence", _logit(F.col("p")) - F.lit(float(np.log(share / (1 - share)))))
    out = out.withColumn("score", 1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("path_rate")))))
    bins = out.filter("quality is not null").groupBy(F.floor((1 - F.col("score")) * 2000).cast("int").alias("bin"), "quality").count().toPandas()
    table = np.zeros((2, 2001))
    np.add.at(table, (bins["quality"].to_numpy(int), bins["bin"].to_numpy(int).clip(0, 2000)), bins["count"].to_numpy())
    most = best_threshold(np.arange(2001) / 2000, table[1], table[0], keep)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "evidence", "site_rate", "path_rate", "score", (1 - F.col("score") <= most).alias("kept"))


def _with_counts(batches):
    for batch in batches:
        rows = [text_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS)))], ["doc_id", "site", "path", *COUNTS])
