"""Ranked lexical search over an index stratified by document length.

Documents of one length normaliser m form a stratum. A stratum is stored in blocks of some thousand documents, each with its postings by term and, within
a term, by tf: what a term adds to a score depends on tf and m alone, so it is computed once for each tf of a block. The largest tf of each term bounds what
any document of a stratum can reach; items visit strata from the highest bound down and leave out those that can't reach their tenth best score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import Scratch, small_side

C = F.col
#: What does not belong to a term: ASCII other than letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text as they are split: A-Z lower-cased, what breaks terms a space. Bytes of other characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
LISTS = "array<struct<term: string, tf: int, at: array<int>>>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> item_id, term, each once. Rows of one item_id are one item; null texts have no terms."""
    words = F.split(F.translate(C("text").cast("string"), _UPPER, _LOWER), BREAK)
    return items.select("item_id", F.explode(F.array_distinct(F.filter(words, lambda w: w != ""))).alias("term")).distinct()


def counted_terms(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, terms, tfs of the documents with at least one term: n counts all terms of the whole text with repeats; terms and tfs are those in the vocabulary (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if words:
                    held = Counter(words)
                    kept = held.keys() if vocabulary is None else held.keys() & vocabulary
                    kept = sorted(kept)
                    rows.append((doc_id, len(words), kept, [held[t] for t in kept]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<int>")


def stratified_index(counted: DataFrame, n_docs: int, n_terms: int, block_docs: int = 4096) -> DataFrame:
    """counted_terms()'s rows -> m, docs, lists: blocks of one m. docs are the block's doc_ids, lists its postings by (term, tf), each with places in docs.

    Rows are ranged by m and a hash, so that a stratum of any size spreads over tasks; a block ends with its stratum, at `block_docs` documents or at the end of a task.
    """
    m = F.expr(f"10 + (90BD * cast(n as decimal(14,0)) * cast({n_docs} as decimal(18,0))) div cast({max(1, n_terms)} as decimal(20,0))").alias("m")
    rows = counted.filter(F.size("terms") > 0).select(m, F.xxhash64("doc_id", "terms").alias("deal"), "doc_id", "terms", "tfs")

    def block(m: int, docs: list, terms: list[list[str]], tfs: list[np.ndarray]) -> tuple:
        sizes = [len(t) for t in terms]
        words, code = np.unique(np.concatenate([np.array(t, object) for t in terms]), return_inverse=True)
        tf, place = np.concatenate(tfs), np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        order = np.lexsort((place, tf, code))
        code, tf, place = code[order], tf[order], place[order]
        first = np.nonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])]))[0]
        return m, docs, words[code[first]].tolist(), tf[first], first, place

    def out(blocks: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(b[2]) for b in blocks]).astype(np.int32)
        starts = np.concatenate([b[4] + shift for b, shift in zip(blocks, np.cumsum([0] + [len(b[5]) for b in blocks[:-1]]), strict=True)])
        places = np.concatenate([b[5] for b in blocks])
        at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(places)).astype(np.int32)), pa.array(places, pa.int32()))
        lists = pa.StructArray.from_arrays([pa.array([t for b in blocks for t in b[2]], pa.string()), pa.array(np.concatenate([b[3] for b in blocks]), pa.int32()), at], ["term", "tf", "at"])
        return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int64()), pa.array([b[1] for b in blocks], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), lists)], ["m", "docs", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, terms, tfs = None, [], [], []
        for batch in batches:
            done = []
            for at, doc_id, t, f in zip(*(batch.column(k).to_pylist() for k in ("m", "doc_id", "terms", "tfs")), strict=True):
                if docs and (at != now or len(docs) >= block_docs):
                    done.append(block(now, docs, terms, tfs))
                    docs, terms, tfs = [], [], []
                now = at
                docs.append(doc_id)
                terms.append(t)
                tfs.append(np.array(f, np.int32))
            if done:
                yield out(done)
        if docs:
            yield out([block(now, docs, terms, tfs)])

    dealt = rows.repartitionByRange("m", "deal").sortWithinPartitions("m", "deal")
    return dealt.select("m", "doc_id", "terms", "tfs").mapInArrow(run, f"m long, docs array<long>, lists {LISTS}")


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term of weight 1 adds for each tf in the stratum m."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Items:
    """Items with the weights of their terms, as tasks use them."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        """rows: (number of the item, term, weight)."""
        self.words = {t: k for k, t in enumerate(sorted({r[1] for r in rows}))}
        self.terms: dict[int, list[int]] = {}
        self.weight = np.zeros(len(self.words), np.int64)
        for item, term, w in rows:
            self.terms.setdefault(item, []).append(self.words[term])
            self.weight[self.words[term]] = w
        self.terms = {k: np.array(v) for k, v in self.terms.items()}

    def best(self, m: int, terms: list[str], tfs: np.ndarray) -> dict[int, int]:
        """The highest score that documents of m with these tfs can have, by item; items without a term there are left out."""
        top = np.zeros(len(self.words), np.int64)
        known = [k for k, t in enumerate(terms) if t in self.words]
        np.maximum.at(top, [self.words[terms[k]] for k in known], impacts(tfs[known], m))
        reach = top * self.weight
        return {item: int(total) for item, own in self.terms.items() if (total := reach[own].sum())}


def stratum_bounds(index: DataFrame, items: Items) -> DataFrame:
    """item, m, bound, docs: the highest score that a document of a stratum can have for an item, and the stratum's size. Only terms and tfs of the index are read."""
    tops = index.select("m", F.explode(F.arrays_zip(C("lists.term").alias("term"), C("lists.tf").alias("tf"))).alias("l")).groupBy("m", "l.term").agg(F.max("l.tf").alias("tf"))
    size = index.groupBy("m").agg(F.sum(F.size("docs")).alias("docs"))
    rows = tops.groupBy("m").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs")).join(small_side(size, 1_000_000), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, terms, tfs, docs in zip(*(batch.column(k).to_pylist() for k in ("m", "terms", "tfs", "docs")), strict=True):
                out += [(item, m, bound, docs) for item, bound in items.best(m, terms, np.array(tfs)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["item", "m", "bound", "docs"])

    return rows.select("m", "terms", "tfs", "docs").mapInArrow(run, "item long, m long, bound long, docs long")


def visited(index: DataFrame, visits: DataFrame, items: Items, k: int) -> DataFrame:
    """visits(item, m, least) -> item, doc_id, score: of the documents in the strata that an item visits those that are among its k best of a task, and no worse than `least`.

    Each block is read once for all its items. A block that can't reach an item's k-th best score so far is passed over.
    """
    rows = index.join(small_side(visits.groupBy("m").agg(F.collect_list(F.struct("item", "least")).alias("wanted")), 20_000), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # item -> score, doc_id, whether it has none
        least: dict[int, int] = {}
        for batch in batches:
            lists = batch.column("lists")
            ends, parts = lists.offsets.to_numpy(), lists.values
            terms, tfs, places = parts.field("term"), parts.field("tf").to_numpy(), parts.field("at")
            cuts, flat = places.offsets.to_numpy(), places.values.to_numpy()
            for b, (m, docs, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "docs", "wanted")), strict=True)):
                own = slice(int(ends[b]), int(ends[b + 1]))
                names, tf = terms[own].to_pylist(), tfs[own]
                worth = impacts(tf, m)
                reach = items.best(m, names, tf)
                by_term: dict[int, list[int]] = {}
                for j, t in enumerate(names):
                    if t in items.words:
                        by_term.setdefault(items.words[t], []).append(j)
                posts = {}
                for t, js in by_term.items():
                    spans = [flat[cuts[own.start + j] : cuts[own.start + j + 1]] for j in js]
                    posts[t] = np.concatenate(spans), np.repeat(worth[js] * items.weight[t], [len(s) for s in spans])
                ids = np.array([-1 if d is None else d for d in docs], np.int64)
                none = np.array([d is None for d in docs])
                for ask in sorted(wanted, key=lambda a: -reach.get(a["item"], 0)):
                    item = ask["item"]
                    floor = max(1, ask["least"], least.get(item, 1))
                    if reach.get(item, 0) < floor:
                        continue
                    held = [posts[t] for t in items.terms[item] if t in posts]
                    # Sums of whole numbers below 2^53 are exact in doubles.
                    score = np.bincount(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), len(docs)).astype(np.int64)
                    hit = np.nonzero(score >= floor)[0]
                    if not len(hit):
                        continue
                    s, d, z = score[hit], ids[hit], none[hit]
                    if item in found:
                        s, d, z = (np.concatenate(p) for p in zip(found[item], (s, d, z), strict=True))
                    top = np.lexsort((d, z, -s))[:k]
                    found[item] = s[top], d[top], z[top]
                    if len(top) == k:
                        least[item] = int(s[top[-1]])
        for item, (s, d, z) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item), pa.int64()), pa.array(d, pa.int64(), mask=z), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return rows.select("m", "docs", "lists", "wanted").mapInArrow(run, "item long, doc_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(C("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_block: int = 1000, most_terms: int = 1_000_000, seed_docs: int = 1000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by doc_id, null last.

    The index covers every document with at least one term; of the terms it holds those that occur in items, or all if these are more than `most_terms`. Items
    are searched `item_block` at a time, so the driver and the tasks hold that many. Null texts have no terms; repeated rows are documents of their own; rows
    of one item_id are one item, and a null item_id is an item too. Empty tables give no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = scratch.stage(item_terms(items), "item_terms")
    words = asked.select("term").distinct()
    few = words.limit(most_terms + 1).count() <= most_terms
    vocabulary = frozenset(r.term.encode() for r in words.collect()) if few else None
    counted = scratch.stage(counted_terms(docs, vocabulary), "counted")
    whole = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    index = scratch.stage(stratified_index(counted, whole["docs"], whole["terms"]), "index")
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * whole["docs"] + 2.0) / (2.0 * C("df") + 1.0)))
    asked = scratch.stage(asked.join(df, "term").select("item_id", "term", weight.alias("w")), "weights")
    scratch.drop(counted)

    ids = asked.select("item_id").distinct()
    blocks = max(1, -(-ids.count() // item_block))
    results = []
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        numbers = {item: number for number, item in enumerate(dict.fromkeys(r.item_id for r in mine))}
        queries = Items([(numbers[r.item_id], r.term, r.w) for r in mine])
        bounds = scratch.stage(stratum_bounds(index, queries), "bounds")
        downward = Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
        ordered = scratch.stage(bounds.withColumn("before", F.coalesce(F.sum("docs").over(downward), F.lit(0))), "order")
        begun = scratch.stage(_first(visited(index, ordered.filter(C("before") < seed_docs).select("item", "m", F.lit(0).cast("long").alias("least")), queries, k), k), "begun")
        tenth = begun.filter(C("rank") == k).select("item", C("score").alias("least"))
        rest = ordered.filter(C("before") >= seed_docs).join(small_side(tenth), "item", "left").na.fill(0, ["least"]).filter(C("bound") >= C("least"))
        more = visited(index, rest.select("item", "m", "least"), queries, k)
        best = scratch.stage(_first(begun.drop("rank").unionByName(more), k), "best")
        names = spark.createDataFrame([(number, item) for item, number in numbers.items()], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        results.append(best.join(F.broadcast(names), "item").select("item_id", C("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
