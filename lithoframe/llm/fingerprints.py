"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so it grows with its document, the sketch of a union
comes from the sketches alone, and containment can be estimated between documents of very unequal length.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.llm.common import ascii_words, placed_rows, shingle_set, with_field

FRACTION = 0.25
#: As many blocks as one job divides its rows into at most. Their bounds are in the plan, and a row for each is collected and broadcast.
MOST_BLOCKS = 8192


def sketch(text: str | None, fraction: float = FRACTION) -> np.ndarray:
    """Sorted hashes of the 5-word shingles below the fraction; of a text so short that none is, its smallest. Empty without words."""
    return _below(shingle_set(ascii_words(text)), fraction)


def _below(s: np.ndarray, fraction: float) -> np.ndarray:
    """The sorted hashes below the fraction; the smallest if none is."""
    n = int(np.searchsorted(s, np.uint64(min(int(fraction * 2**64), 2**64 - 1)), "right"))
    return s[: max(n, min(1, len(s)))]


def encode(s: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, big-endian and ascending."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both documents' shingles together. A hash above the fraction, which stands for a document with none below, goes where the other has one."""
    return _below(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a, which lacks nothing."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: 1 if both are empty, 0 if one is."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> the rows with a column `fingerprint`, in place of one that docs may have. Null and empty texts have the empty string."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encode(sketch(t)) for t in batch.column("text").to_pylist()], pa.string())], [*batch.schema.names, "fingerprint"])

    docs = docs.drop("fingerprint")
    return docs.mapInArrow(run, with_field(docs, "fingerprint", T.StringType()))


def in_order(docs: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """documents -> doc_id, text, block, halo: dealt into blocks by descending doc_id and sorted, so that a row follows its predecessor.

    Bounds of the blocks are quantiles of doc_id, as many as texts of `block_bytes` need and at least two for each shuffle partition, but MOST_BLOCKS at most: beyond
    that blocks grow, which costs a task time and not memory, as rows are sorted with spilling and stream through it. A doc_id (or null) that fills blocks is
    divided by a hash of its rows' places in their files, which orders rows of one doc_id. Each block is a partition and ends with a copy of the
    first row of the block after it (of the first block, for the last one), marked as halo. So texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = placed_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("_doc.*", F.coalesce("_doc.doc_id", F.lit(-(2**63))).alias("at"), F.xxhash64("_file", "_at").alias("g"))
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = min(MOST_BLOCKS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // block_bytes)))
    cuts = Counter(int(x) for x in docs.agg(F.percentile_approx("at", [k / count for k in range(1, count)], 10 * count).alias("q")).first()["q"] or [])
    # A block begins at (at, g): at a quantile, and k more times inside one that several quantiles fall on.
    bounds = sorted(((at, -(2**63) + 2**64 * k // n) for at, n in cuts.items() for k in range(n)), key=lambda b: (-b[0], b[1]))
    docs = docs.withColumn("block", _passed(bounds))
    # One row a block, MOST_BLOCKS at most.
    heads = docs.groupBy("block").agg(F.min(F.struct(F.bitwise_not("at").alias("order"), "g")).alias("h")).orderBy("block").select("block", "h.order", "h.g").collect()
    before = spark.createDataFrame([(-h["order"] - 1, h["g"], k, (k - 1) % len(heads)) for k, h in enumerate(heads)], "at long, g long, block int, before int")
    number = spark.createDataFrame([(h["block"], k) for k, h in enumerate(heads)], "block int, n int")
    docs = docs.join(F.broadcast(number), "block").drop("block").withColumnRenamed("n", "block").join(F.broadcast(before), ["at", "g", "block"], "left")
    own = F.struct("block", F.lit(False).alias("halo"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("block"), F.lit(True).alias("halo"))))
    docs = docs.select("doc_id", "text", "at", "g", F.explode(places).alias("p")).select("doc_id", "text", "at", "g", "p.block", "p.halo")
    return docs.repartitionById(max(1, len(heads)), F.col("block")).sortWithinPartitions("halo", F.desc("at"), "g").drop("at", "g")


def _passed(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds come at or before a row, found in a list of every so many bounds and then among those between two."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    kind = "array<struct<at: bigint, g: bigint>>"
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    said = lambda part: "array(" + ", ".join(f"struct({_long(a)}, {_long(g)})" for a, g in part) + ")"
    before = lambda b: (b["at"] > F.col("at")) | ((b["at"] == F.col("at")) & (b["g"] <= F.col("g")))
    coarse = F.size(F.filter(F.expr(said([r[0] for r in rows])).cast(kind), before))
    fine = F.element_at(F.expr(f"array({', '.join(map(said, rows))})").cast(f"array<{kind}>"), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, before)))


def _long(n: int) -> str:
    return f"{n}L" if n > -(2**63) else "(-9223372036854775807L - 1L)"


def _compare(batches):
    """Rows in order -> each row with its edited text's and its successor's figures. A row waits for the one after it."""
    last = None  # block, doc_id, text, sketch

    for batch in batches:
        out = []
        for doc_id, text, block, halo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if halo and (last is None or last[0] != block):
                continue
            own = sketch(text)
            if last is not None and last[0] == block:
                n = len(last[2])
                edited = last[2][: n - n // 2] + text[: n // 2]
                other = sketch(edited)
                out.append((last[1], n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(last[3]), encode(other), likeness(last[3], other), likeness(last[3], own)))
            last = None if halo else (block, doc_id, text, own)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_and_next(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's successor has the next smaller doc_id; the first follows the last. Its edited text has the last half of its code points
    replaced by the first as many (or all) of the successor's. Nulls are empty texts; a null doc_id comes
    last; rows of one doc_id follow each other in the order of a hash of their places in the files. A single document is its own successor. An empty table gives none; other
    columns are ignored.
    """
    return in_order(docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
