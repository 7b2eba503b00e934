"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature of
176 values costs 88 hash evaluations a shingle. The values are dealt into 44 bands of 4, each of four different permutations. Two documents that agree in
a band are candidates; at a similarity of 0.75 a pair shares no band with probability (1 - 0.75**4)**44 = 6e-8.
Candidates are confirmed on their full shingle sets.

Work is bounded without a cap: equal sets become one class first. In each bucket the members meet the bucket's
smallest class only, at first one such class each, and then those that are still apart from it. What is left over are the buckets whose members are in different components. There an
exact similarity join takes over: shingles are ordered from rare to frequent, and two sets of the similarity asked for share one of the first quarter of each
(prefix filter), at places that leave room for enough others (position filter). Marks of each set in 1024 cells bound what two sets can share. Documents that merely share a passage, or loose copies of one text, have their own rare shingles first,
so they don't meet, and no link is lost.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import Scratch, ascii_words, list_array, mix64, odd_constants, placed_rows, shingle_set, small_side
from lithoframe.llm.graph import connected_components

BANDS, ROWS, WIDTH, CELLS, MARKS = 44, 4, 5, 1 << 18, 1024
_WORDS = [f"w{k}" for k in range(MARKS // 64)]
_MUL, _ADD = odd_constants(BANDS * ROWS // 2, 11), odd_constants(BANDS * ROWS // 2, 13)
_IN_BAND, _BAND = odd_constants(ROWS, 17), odd_constants(BANDS, 19)
_SUMS = odd_constants(2, 23)


def minmax_signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingle hashes under each permutation; shingles must not be empty. The maxima are turned by half a band, so that no band has both values of one permutation."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(_MUL), np.uint64)
    for at in range(0, len(shingles), 512):
        h = shingles[None, at : at + 512] * _MUL[:, None] + _ADD[:, None]
        h ^= h >> np.uint64(32)
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, np.roll(high, BANDS // 2)])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band. A band takes values of different permutations; its number is part of its key."""
    rows = signature.reshape(ROWS, BANDS).T
    return mix64((rows * _IN_BAND[None, :]).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def _signatures(batches):
    for batch in batches:
        n, h1, h2, bands = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(ascii_words(text), WIDTH)
            n.append(len(s))
            h1.append(int(mix64(s * _SUMS[0]).sum(dtype=np.uint64).view(np.int64)))
            h2.append(int(mix64(s + _SUMS[1]).sum(dtype=np.uint64).view(np.int64)))
            bands.append(band_keys(minmax_signature(s)) if len(s) else np.zeros(0, np.int64))
        keys = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), list_array(bands, pa.int64())], [*keys, "n", "h1", "h2", "bands"])


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) % CELLS


def _cell_counts(batches):
    """Texts -> (cell, times): in how many sets of the batch a shingle of the cell occurs."""
    for batch in batches:
        times = np.zeros(CELLS, np.int64)
        for text in batch.column("text").to_pylist():
            times += np.bincount(_cells(shingle_set(ascii_words(text), WIDTH)), minlength=CELLS)
        cell = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(times[cell], pa.int64())], ["cell", "times"])


def cell_marks(shingles: np.ndarray) -> np.ndarray:
    """The cells of MARKS that a set's shingles fall in, as bits in 64-bit words. A cell that x has and y lacks holds a shingle that x has and y lacks."""
    bits = np.zeros(MARKS, np.uint8)
    bits[(shingles >> np.uint64(24)) % np.uint64(MARKS)] = 1
    return np.packbits(bits).view(np.int64)


def prefix_length(n: int) -> int:
    """How many shingles of n, in any one order, must be looked at: a set of similarity 0.75 has at least three quarters of the n."""
    return n - -(-3 * n // 4) + 1


def _prefixes(order: np.ndarray):
    """Texts -> (rep, n, c, h, at, marks): the first shingles of each set in the order of their cells' rank, then of themselves, their places, and the set's marks."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first in range(0, len(texts), 256):
                part, firsts, marks = batch.slice(first, 256), [], []
                for text in texts[first : first + 256]:
                    s = shingle_set(ascii_words(text), WIDTH)
                    firsts.append(s[np.lexsort((s, order[_cells(s)]))][: prefix_length(len(s))])
                    marks.append(cell_marks(s))
                marks = np.array(marks)
                sizes = [len(x) for x in firsts]
                of = pa.array(np.repeat(np.arange(len(firsts)), sizes))
                at = np.concatenate([np.arange(k) for k in sizes]) if sizes else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in ("rep", "n", "c")), pa.array(np.concatenate(firsts).view(np.int64)), pa.array(at, pa.int64()), *(pa.array(np.repeat(marks[:, k], sizes)) for k in range(len(_WORDS)))], ["rep", "n", "c", "h", "at", *_WORDS])

    return run


def _confirm(batches):
    """Pairs with both texts -> those with 100 * intersection >= 75 * union. Rows come sorted by b, so its set is kept."""
    kept: OrderedDict = OrderedDict()

    def shingles(key, text):
        if key not in kept:
            kept[key] = shingle_set(ascii_words(text), WIDTH)
            if len(kept) > 64:
                kept.popitem(last=False)
        return kept[key]

    for batch in batches:
        a, b, ta, tb = (batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b"))
        good = []
        for i in range(len(a)):
            x, y = shingles(a[i], ta[i]), shingles(b[i], tb[i])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                good.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _labelled(docs: DataFrame, keys: tuple[str, ...], hot: int) -> DataFrame:
    """docs with long columns doc_id and keys -> row, doc_id, keys, n, component: the component's smallest row, the row's own if it has no link; and low: the component's smallest doc_id."""
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    # 128 bits of the text name it where it is read again
    digests = [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]
    schema = "doc_id long, " + "".join(f"{k} long, " for k in keys) + "t1 long, t2 long, n long, h1 long, h2 long, bands array<long>"
    sign = docs.select("doc_id", *keys, *digests, text.alias("text")).mapInArrow(_signatures, schema)
    sign = scratch.stage(sign.withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = sign.filter("n > 0")
    classes = full.groupBy("n", "h1", "h2").agg(F.min(F.struct("row", "t1", "t2")).alias("r"), F.min("doc_id").alias("low"), F.count("*").alias("members"), F.first("bands").alias("bands"))
    classes = scratch.stage(classes.select("n", "h1", "h2", F.col("r.row").alias("rep"), "r.t1", "r.t2", "low", "members", "bands"), "classes")

    # One exchange by band serves both the hubs and the join with them.
    in_band = classes.select("rep", "n", F.explode("bands").alias("band")).repartition("band")
    hubs = in_band.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    buckets = scratch.stage(in_band.join(hubs, "band").select("band", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    wanted = classes.select("rep", "t1", "t2").join(buckets.select("rep").distinct(), "rep")
    texts = docs.select(*digests, text.alias("text")).join(wanted, ["t1", "t2"]).groupBy("rep").agg(F.first("text").alias("text"))
    texts = scratch.stage(texts, "texts")

    pairs = buckets.filter("rep <> hub and 4 * least(n, hub_n) >= 3 * greatest(n, hub_n)").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = scratch.stage(pairs, "pairs")
    one = pairs.groupBy("a").agg(F.min("b").alias("b"))
    first = scratch.stage(_links(one, texts), "links")
    part = connected_components(first)
    other = pairs.join(one, ["a", "b"], "left_anti")
    for k in ("a", "b"):
        other = other.join(part.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}")), k, "left")
    other = other.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    first = scratch.stage(first.unionByName(_links(other, texts)), "links")
    part = connected_components(first)

    named = buckets.join(part, buckets.rep == part.id, "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    rest = scratch.stage(texts.join(named.join(mixed, "band").select("rep", "n", "c").distinct(), "rep"), "rest")
    times = np.zeros(CELLS, np.int64)
    for r in rest.select("text").mapInArrow(_cell_counts, "cell int, times long").groupBy("cell").agg(F.sum("times").alias("times")).toLocalIterator():
        times[r["cell"]] = r["times"]  # CELLS numbers, whatever the data
    prefixes = scratch.stage(rest.mapInArrow(_prefixes(times), "rep long, n long, c long, h long, at long, " + ", ".join(f"{w} long" for w in _WORDS)), "prefixes")
    x, y = (prefixes.select("h", *(F.col(k).alias(f"{k}_{s}") for k in ("rep", "n", "c", "at", *_WORDS))) for s in ("x", "y"))
    alone = [" + ".join(f"bit_count({w}_{s} & ~{w}_{t})" for w in _WORDS) for s, t in ("xy", "yx")]
    # What two sets can share: this shingle and what can follow it in the shorter rest, and no more than their marks allow.
    most = f"least(n_x - at_x, n_y - at_y, n_x - ({alone[0]}), n_y - ({alone[1]}))"
    across = x.join(y, "h").filter(f"rep_x < rep_y and c_x <> c_y and 4 * least(n_x, n_y) >= 3 * greatest(n_x, n_y) and 175 * {most} >= 75 * (n_x + n_y)")
    across = scratch.stage(across.select(F.col("rep_y").alias("a"), F.col("rep_x").alias("b")).distinct(), "across")
    second = _links(across, rest)
    component = connected_components(first.unionByName(second))
    scratch.drop(texts, rest, prefixes, buckets)

    # Classes of one member without a link are left out: their rows are themselves. Large classes meet their rows without a shuffle.
    moved = classes.join(component, classes.rep == component.id, "left").filter("members > 1 or id is not null").select("n", "h1", "h2", "members", "low", F.coalesce("component", "rep").alias("component"))
    lows = moved.groupBy("component").agg(F.min("low").alias("low"))
    moved = scratch.stage(moved.drop("low").join(lows, "component"), "moved")
    keys_ = ["n", "h1", "h2"]
    big, small = (moved.filter(f"members {op} {hot}").select(*keys_, F.col("component").alias("c"), F.col("low").alias("l")) for op in (">=", "<"))
    met = full.select("row", "doc_id", *keys, *keys_).join(small_side(big), keys_, "left")
    cold = met.filter("c is null").drop("c", "l").join(small, keys_, "left")
    alone = sign.filter("n = 0").select("row", "doc_id", *keys, *keys_, F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("l"))
    out = met.filter("c is not null").unionByName(cold).unionByName(alone)
    return out.select("row", "doc_id", *keys, "n", F.coalesce("c", "row").alias("component"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("l")).alias("low"))


def near_duplicates(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept.

    Two documents are linked if the sets of their 5-word shingles (A-Z lower-cased; the whole sequence if there are
    fewer words) have 100 * |intersection| >= 75 * |union|. component_id is the smallest doc_id reachable by links,
    kept says that it is the document's own. Null and empty texts, and texts of white space, have no shingle and no
    link: they are kept. Repeated rows give repeated rows. Each row counts by its own text: rows with a null doc_id, or with the doc_id of another text, are linked like
    others; null is never the smallest, and of a group without a doc_id all rows are kept. Classes of `hot` rows and more are not shuffled by class. An empty table gives none; other columns are ignored.
    """
    rows = _labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), (), hot)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("low")).alias("kept"))


def deduplicate(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """documents -> the same columns, one row of each group of near duplicates (one with the smallest doc_id, null being the largest).

    Each row is compared by its own text: null and repeated doc_ids count like others. Rows without text stay. Rows that go are looked up by their place in the files that docs is read from, so the texts of those that stay meet a narrow table, or a small one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = placed_rows(docs)
    part = _labelled(rows.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "_doc.text", "_file", "_at"), ("_file", "_at"), hot)
    part = scratch.stage(part.select("row", "component", F.col("doc_id").isNull().alias("odd"), "doc_id", "_file", "_at"), "parts")
    first = part.groupBy("component").agg(F.min(F.struct("odd", "doc_id", "row"))["row"].alias("row"))
    gone = scratch.stage(part.join(first.select("row"), "row", "left_anti").select("_file", "_at"), "gone")
    return rows.join(small_side(gone), ["_file", "_at"], "left_anti").select("_doc.*")
