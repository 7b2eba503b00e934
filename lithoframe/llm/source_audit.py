"""Source divergence audit: how the word use of a source differs from that of its language and of the language's other sources.

Terms get whole rates per billion, smoothed by one count a term, so every value is exact. What a pair of sources differs by is a sum over all terms, got
from a frequent-pattern tree: a term's row (its sources with nonzero counts, in order) is a path, equal beginnings of rows are one node with a
multiplicity, and the counts of two sources meet once for each node and ancestor, not once for each term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import small_side, stage

C = F.col
#: What becomes of a byte of a text: A-Z are lower-cased, 0 stands for what does not belong to a term (ASCII other than letters).
_KEPT = np.array([k + 32 if 65 <= k <= 90 else k if k >= 128 or 97 <= k <= 122 else 0 for k in range(256)], np.uint8)
#: Most rows and bytes of text that are counted at once: so many rows, languages and terms multiply to less than 63 bits.
_ROWS, _BYTES = 1 << 16, 1 << 24
#: A cell of a row is a long: the source's number above, its count in the lower bits (17 million million occurrences).
_BITS = 44


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def split_terms(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of all texts (none is null) in order, A-Z lower-cased, and how many each text has. UTF-8 has no ASCII byte inside other characters, so bytes are looked at alone."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = _KEPT[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]  # a term doesn't go on from one text into the next
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(stops) + 1 - starts, out=places[1:])
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return terms, np.diff(np.searchsorted(starts, ends))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows lang, at, text -> lang, term, docs, cells: a term of a language, the number of the rows that hold it, and a cell for each source with its occurrences, in order."""
    terms, lengths = split_terms(batch["text"])
    coded, langs = terms.dictionary_encode(), batch["lang"].dictionary_encode()
    ats, at_of = np.unique(batch["at"].to_numpy(), return_inverse=True)
    n_terms, n_docs, n_ats = max(1, len(coded.dictionary)), max(1, len(lengths)), max(1, len(ats))
    spread = lambda of_doc: np.repeat(of_doc, lengths)
    which = spread(langs.indices.to_numpy().astype(np.int64)) * n_terms + coded.indices.to_numpy()

    keys = np.sort(which * n_docs + spread(np.arange(len(lengths))))
    held = keys[_heads(keys)] // n_docs
    docs = np.diff(np.append(_heads(held), len(held)))

    keys = np.sort(which * n_ats + spread(at_of))
    heads = _heads(keys)
    times, keys = np.diff(np.append(heads, len(keys))), keys[heads]
    cells, which = (ats[keys % n_ats] << _BITS) + times, keys // n_ats
    heads = _heads(which)
    which = which[heads]
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(cells)), pa.int32()), pa.array(cells, pa.int64()))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(which // n_terms)), coded.dictionary.take(pa.array(which % n_terms)), pa.array(docs, pa.int64()), lists], ["lang", "term", "docs", "cells"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch counted in slices of _ROWS rows and about _BYTES of text at most; a longer text is a slice of its own."""
    for batch in batches:
        sizes, at = pc.binary_length(batch["text"]).to_numpy(), 0
        ends = np.cumsum(sizes, dtype=np.int64)
        while at < len(sizes):
            most = (ends[at - 1] if at else 0) + _BYTES
            end = min(max(at + 1, int(np.searchsorted(ends, most, "right"))), at + _ROWS)
            yield _counted(batch.slice(at, end - at))
            at = end


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, docs, cells: the terms of slices of documents, in how many documents of the slice each is, and its cells, one a source. Null columns read as ''. A term has a row for each slice that holds it.

    groups are numbered_groups(docs), staged.
    """
    said = lambda k: F.coalesce(C(k).cast("string"), F.lit("")).alias(k)
    rows = docs.select(said("lang"), said("source"), said("text")).join(small_side(groups), ["lang", "source"])
    return rows.select("lang", "at", "text").mapInArrow(_count_batches, "lang string, term string, docs long, cells array<long>")


def numbered_groups(docs: DataFrame) -> DataFrame:
    """lang, source, at: every group that occurs, numbered by source within its language."""
    said = lambda k: F.coalesce(C(k).cast("string"), F.lit("")).alias(k)
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    limit = 1 << (63 - _BITS)
    return docs.select(said("lang"), said("source")).distinct().withColumn("at", F.when(at < limit, at).otherwise(F.raise_error(f"a language has more than {limit:,} sources")))


def term_rows(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term, total, row of the terms in at least `least_docs` documents of their language; row is an array of cells in the order of sources. All that counts say of a term meets in one exchange."""
    cells = counts.repartition("lang", "term").select("lang", "term", "docs", F.posexplode("cells").alias("k", "cell"))
    cells = cells.select("lang", "term", at(C("cell")).alias("at"), count(C("cell")).alias("n"), F.when(C("k") == 0, C("docs")).otherwise(0).alias("docs"))
    found = cells.groupBy("lang", "term", "at").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cell = F.shiftleft(C("at"), _BITS) + C("n")
    found = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(cell)).alias("row"))
    return found.filter(C("docs") >= least_docs).drop("docs")


def at(cell: Column) -> Column:
    return F.shiftright(cell, _BITS)


def count(cell: Column) -> Column:
    return cell.bitwiseAND((1 << _BITS) - 1)


def rate(n: str, total: str, terms: str) -> str:
    """SQL for 1 + floor(10^9 (n + 1) / (total + terms)). The product is a decimal, so a corpus of any size stays exact."""
    return f"(1 + 1000000000BD * (cast({n} as decimal(20,0)) + 1) div (cast({total} as decimal(20,0)) + {terms}))"


def gap(p: str, q: str) -> str:
    """SQL for floor((p - q)^2 / q); rates are at most a billion and one, so the square is a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def pattern_tree(rows: DataFrame) -> DataFrame:
    """rows(lang, row) -> lang, path, times: the nodes of the tree of all rows, each with the number of terms that pass it. Equal rows are counted before their beginnings are listed."""
    rows = rows.groupBy("lang", "row").agg(F.count("*").alias("times"))
    steps = rows.select("lang", "row", "times", F.explode(F.sequence(F.lit(1), F.size("row"))).alias("depth"))
    return steps.select("lang", F.slice("row", F.lit(1), C("depth")).alias("path"), "times").groupBy("lang", "path").agg(F.sum("times").alias("times"))


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each ordered pair of sources of a language the sum of gap() over all kept terms.

    Were all counts zero, each term would give one value; the tree's nodes add what a source's own counts change, and its nodes with their ancestors
    what two sources' counts change together. Totals are decimals until they are whole.
    """
    nodes = stage(pattern_tree(terms), "nodes")
    last = F.element_at("path", -1)
    single = nodes.groupBy("lang", last.alias("cell")).agg(F.sum("times").alias("times")).select("lang", at(C("cell")).alias("at"), count(C("cell")).alias("n"), "times")
    both = nodes.select("lang", last.alias("low"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("high"), "times")
    both = both.groupBy("lang", "low", "high").agg(F.sum("times").alias("times"))
    known = small_side(groups.select("lang", "at", "total", "terms"))
    side = lambda k: known.select("lang", *(C(c).alias(f"{c}_{k}") for c in ("at", "total", "terms")))
    p = lambda n, k: rate(n, f"total_{k}", f"terms_{k}")
    wide = lambda c: F.expr(f"cast({c} as decimal(38,0))")

    # Rates of a cell and of an absent term, once for each distinct pair of cells.
    cells = both.select("lang", at(C("low")).alias("at_a"), count(C("low")).alias("n_a"), at(C("high")).alias("at_b"), count(C("high")).alias("n_b"), "times")
    cells = cells.join(side("a"), ["lang", "at_a"]).join(side("b"), ["lang", "at_b"])
    cells = cells.select("lang", "at_a", "at_b", "times", *(F.expr(v).alias(k) for k, v in {"pa": p("n_a", "a"), "qa": p("0", "a"), "pb": p("n_b", "b"), "qb": p("0", "b")}.items()))
    twist = lambda x, x0, y, y0: f"({gap(x, y)} - {gap(x, y0)} - {gap(x0, y)} + {gap(x0, y0)})"
    sums = cells.groupBy("lang", "at_a", "at_b").agg(F.sum(wide(twist("pa", "qa", "pb", "qb")) * C("times")).alias("ab"), F.sum(wide(twist("pb", "qb", "pa", "qa")) * C("times")).alias("ba"))
    turned = F.explode(F.array(F.struct(C("at_a").alias("at_s"), C("at_b").alias("at_t"), C("ab").alias("v")), F.struct(C("at_b").alias("at_s"), C("at_a").alias("at_t"), C("ba").alias("v"))))
    together = sums.select("lang", turned.alias("o")).select("lang", "o.*")

    # A source's own counts against the absent term of each other source, and the other way round.
    alone = single.select("lang", C("at").alias("at_a"), "n", "times").join(side("a"), ["lang", "at_a"]).join(side("b"), "lang").filter(C("at_a") != C("at_b"))
    alone = alone.select("lang", "at_a", "at_b", "times", F.expr(p("n", "a")).alias("pa"), F.expr(p("0", "a")).alias("qa"), F.expr(p("0", "b")).alias("qb"))
    alone = alone.groupBy("lang", "at_a", "at_b").agg(F.sum(wide(f"{gap('pa', 'qb')} - {gap('qa', 'qb')}") * C("times")).alias("ab"), F.sum(wide(f"{gap('qb', 'pa')} - {gap('qb', 'qa')}") * C("times")).alias("ba"))
    alone = alone.select("lang", turned.alias("o")).select("lang", "o.*")

    none = side("s").join(side("t"), "lang").filter(C("at_s") != C("at_t"))
    none = none.select("lang", "at_s", "at_t", F.when(C("terms_s") == 0, wide("0")).otherwise(wide(gap(p("0", "s"), p("0", "t"))) * C("terms_s")).alias("v"))
    value = none.unionByName(alone).unionByName(together).groupBy("lang", "at_s", "at_t").agg(F.sum("v").cast("long").alias("value"))
    name = lambda k, c: small_side(groups.select("lang", C("at").alias(f"at_{k}"), C("source").alias(c)))
    return value.join(name("s", "source"), ["lang", "at_s"]).join(name("t", "item"), ["lang", "at_t"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank.

    Part 'pair': each other source of the language, by how far the group's rates are from that source's, summed over all kept terms (0 without any).
    Part 'term': the terms that the group has and uses more than its language does, the first `most_terms` of them. Ranks go by value, then item.
    Null text, lang and source read as ''; repeated rows count as documents of their own; an empty table gives no rows; other columns are ignored. A text
    is split in memory, however long it is.
    """
    numbered = stage(numbered_groups(docs), "groups")
    terms = stage(term_rows(term_counts(docs, numbered), least_docs), "terms")
    cells = terms.select("lang", "term", "total", F.explode("row").alias("cell")).select("lang", "term", "total", at(C("cell")).alias("at"), count(C("cell")).alias("n"))
    used = cells.groupBy("lang", "at").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    groups = numbered.join(small_side(kept), "lang", "left").join(small_side(used), ["lang", "at"], "left").na.fill(0, ["terms", "lang_total", "total"])
    groups = stage(groups, "totals")

    first = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(terms, groups).withColumn("rank", F.row_number().over(first()))
    rated = cells.join(small_side(groups.select("lang", "at", "source", C("total").alias("group_total"), "terms", "lang_total")), ["lang", "at"])
    rated = rated.select("lang", "source", C("term").alias("item"), F.expr(rate("n", "group_total", "terms")).alias("p"), F.expr(rate("total", "lang_total", "terms")).alias("q"))
    rated = rated.filter("p > q").select("lang", "source", "item", F.expr(gap("p", "q")).alias("value"))
    rated = rated.withColumn("rank", F.row_number().over(first())).filter(C("rank") <= most_terms)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", C("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(rated, "term"))
