"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, so an unseen misspelling shares most of its vector
with the word it comes from. A document is the weighted average of its words, each weighing exp(u @ word): u is learnt with the embeddings and
the softmax, so that a few telling words outweigh thousands of others. With two classes, embeddings E, the softmax's w1 - w0 and u meet in two scalars an
n-gram, E @ (w1 - w0) and E @ u: training and scoring gather and scatter these, with exact gradients for all three.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
BUCKETS, DIM = 1 << 17, 8


def subwords(word: str) -> list[int]:
    """Buckets of the character n-grams (3 to 5) of <word>, and of the whole."""
    w = f"<{word}>".encode()
    n = len(w)
    return [crc32(w[i : i + k]) & (BUCKETS - 1) for k in (3, 4, 5) for i in range(n - k + 1)] + [crc32(w) & (BUCKETS - 1)]


@dataclass
class Model:
    weight: np.ndarray  # of each n-gram bucket: E @ (w1 - w0)
    pull: np.ndarray  # of each n-gram bucket: E @ u
    bias: float

    def scorer(self, most: int = 300_000):
        """A function from a text to its score; words met before are kept, `most` of them."""
        weight, pull, known = self.weight.tolist(), self.pull.tolist(), {}
        s, t = np.zeros(most), np.zeros(most)

        def learn(words: list[str]) -> None:
            for w in words:
                if w not in known:
                    at, k = subwords(w), len(known)
                    s[k], t[k], known[w] = sum([weight[i] for i in at]) / len(at), sum([pull[i] for i in at]) / len(at), k

        def score(text: str | None) -> float:
            words = _WORD.findall(text.lower()) if text else []
            z = self.bias
            if words:
                new = set(words).difference(known)
                if len(known) + len(new) > most:
                    known.clear()
                    new = set(words)
                if len(new) > most:  # more words in one text than are kept
                    bags = [subwords(w) for w in words]
                    sw, tw = (np.array([sum([x[i] for i in at]) / len(at) for at in bags]) for x in (weight, pull))
                else:
                    learn(sorted(new))
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    sw, tw = s[at], t[at]
                a = np.exp(tw - tw.max())
                z += float(a @ sw / a.sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


NOTHING = (np.zeros(BUCKETS), np.zeros(BUCKETS), -30.0)


def train(texts: list[str], toxic: np.ndarray, weights: np.ndarray, epochs: int = 80, rate: float = 0.05, decay: float = 1e-7, seed: int = 3) -> Model:
    """Full-batch descent with momentum on the weighted cross entropy.

    A step is scaled by the usual gradient of its entry (Adam) plus a share of the largest of the array: n-grams that many
    toxic texts share move most, and those of rare words, where there is little to learn from, hardly move.
    """
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in _WORD.findall((t or "").lower())], np.int32) for t in texts]
    use = [i for i, d in enumerate(docs) if len(d)]
    if not use:
        return Model(*NOTHING)
    toxic, weights = toxic[use].astype(float), weights[use] / weights[use].sum()
    words = np.concatenate([docs[i] for i in use])
    count = np.array([len(docs[i]) for i in use])
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    grams = [np.array(subwords(w), np.int32) for w in ids]
    g_count = np.array([len(g) for g in grams])
    g_start, grams = np.concatenate([[0], np.cumsum(g_count)[:-1]]), np.concatenate(grams)
    rng = np.random.default_rng(seed)
    at = {"e": rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), "w": rng.normal(0, 1, DIM).astype(np.float32), "u": rng.normal(0, 1, DIM).astype(np.float32), "b": np.full(1, -3.0, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in at.items()} for _ in range(2))

    def to_grams(by_word: np.ndarray) -> np.ndarray:
        return np.bincount(grams, np.repeat(np.bincount(words, by_word, len(ids)) / g_count, g_count), BUCKETS).astype(np.float32)

    for epoch in range(1, epochs + 1):
        s, t = ((np.add.reduceat((at["e"] @ at[k])[grams], g_start) / g_count)[words] for k in ("w", "u"))
        a = np.exp(t - np.repeat(np.maximum.reduceat(t, start), count))
        a /= np.repeat(np.add.reduceat(a, start), count)
        mean = np.add.reduceat(a * s, start)
        dz = weights * (1 / (1 + np.exp(-np.clip(at["b"][0] + mean, -30, 30))) - toxic)
        ds = np.repeat(dz, count) * a
        gs, gt = to_grams(ds), to_grams(ds * (s - np.repeat(mean, count)))
        grad = {"e": gs[:, None] * at["w"] + gt[:, None] * at["u"] + decay * at["e"], "w": at["e"].T @ gs, "u": at["e"].T @ gt, "b": np.array([dz.sum()], np.float32)}
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            size = np.sqrt(v[k] / (1 - 0.99**epoch))
            at[k] -= rate * (m[k] / (1 - 0.9**epoch)) / (size + 0.05 * size.max() + 1e-12)
    seen = np.bincount(grams, minlength=BUCKETS) > 0  # what no text had stays neutral
    return Model(np.where(seen, at["e"] @ at["w"], 0.0), np.where(seen, at["e"] @ at["u"], 0.0), float(at["b"][0]))


def held_out(doc_id) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 2500, longest: int = 100_000) -> Model:
    """Learn from a bounded sample of the labelled rows that are not held out: about `positives` toxic and `negatives` clean doc_ids, picked by a hash of doc_id.

    Each doc_id gives one text (the smallest, if there are several), of `longest` characters at most: this bounds what the driver reads. Rows of a class weigh as much as all of
    it, so scores keep the share of toxic documents. Without rows of both classes nothing is toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(*NOTHING)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    below = {k: int(min(1.0, most / sizes[k]) * (1 << 30)) for k, most in ((1, positives), (0, negatives))}
    chosen = known.filter(u < F.when(F.col("toxic") == 1, below[1]).otherwise(below[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.char_length("text") <= longest)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    toxic = np.array([r["toxic"] for r in rows])
    if len(set(toxic.tolist())) < 2:
        return Model(*NOTHING)
    share = {k: sizes[k] / (toxic == k).sum() for k in sizes}
    return train([r["text"] for r in rows], toxic, np.array([share[k] for k in toxic.tolist()]))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted (score >= 0.3).

    The score depends on the text alone. Null and empty texts, and texts without a word, get the score of an empty text. Repeated rows get
    equal scores; an empty table gives none; other columns are ignored.
    """
    weight, pull, bias = model.weight.astype(np.float32), model.pull.astype(np.float32), model.bias

    def run(batches):
        score = Model(weight, pull, bias).scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int"))
