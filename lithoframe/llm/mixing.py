"""Mixing sources to target weights by entropy balancing.

Among all rates between 0 and the largest number of copies that meet the constraints, the ones closest to the corpus in relative
entropy (over tokens) tilt each document exponentially: rate = exp(a + b * feature), a and b being the duals of its source. The
constraint behind a is the source's token target; the one behind b, kept up to a ridge, is that the tokens which the mix takes of a source have the
mean feature of the whole corpus: by default the logarithm of a document's size, so that sources of short documents don't make the mix short.
Newton iterations on the convex dual, whose value, gradient and curvature are sums by source that Spark aggregates, find the duals.

Rates become whole copies by sequential Poisson sampling: a document's own random number, divided by the fractional part of its rate,
is compared with a threshold of its source that brings the tokens to the target. So copies depend on the row and two small tables
by source alone, and texts are never shuffled. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import WORD, Scratch, placed_rows, small_side

#: Weights of the sources in code point order, repeating; tokens of the mix as a share of all; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Share of a source's tokens by which the ridge lets the feature constraint give way for each unit of its dual.
RIDGE = 0.05
_SOURCES = 50_000


def size(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) rows, one a source -> source, source_size, target.

    A target is the smaller of most * source_size and weight * level, the level being such that targets add up to share * all sizes.
    This is where resharing the excess by weight ends. With the sources sorted by source_size / weight, those below the level
    are filled to their limit. Null is a source, after the others. The windows run over one narrow row a source.
    """
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    per = per.withColumn("below", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("above", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    # The level if this source and those after it stay under their limits; it holds for the first source that then does.
    per = per.withColumn("level", (F.col("total") - most * F.col("below")) / F.col("above"))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct("below", "level"))).over(whole)["level"])
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), (most * F.col("source_size")).cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def tilted(a: Column, b: Column, feature: Column, most: int) -> Column:
    return F.least(F.exp(F.least(a + b * feature, F.lit(50.0))), F.lit(float(most)))


def source_duals(masses: DataFrame, targets: DataFrame, most: int = MOST, ridge: float = RIDGE, steps: int = 80) -> DataFrame:
    """masses(source, feature, mass) staged, the mass being all tokens of the source at that feature; targets -> source, a, b, centre.

    Newton on the dual of each source: the sum of mass * G(a + b * (feature - centre)) - a * target + ridge * source_size * b**2 / 2, where G' = min(most, exp)
    and centre is the mean feature of all tokens. Its gradient vanishes where the tokens meet the target, and their centred features sum up to
    -ridge * source_size * b. A step that doesn't lower the dual is halved. A source without tokens, or whose target is its limit, gets its duals at once.
    All sources move in the same jobs, one grouped aggregation a step.
    """
    scratch = Scratch(masses.sparkSession)
    few = targets.limit(_SOURCES + 1).count() <= _SOURCES
    centre = masses.agg(F.sum(F.col("mass") * F.col("feature")) / F.sum("mass")).first()[0] or 0.0
    full = (F.col("target") >= most * F.col("source_size")) | (F.col("source_size") == 0)
    zero = {k: F.lit(0.0) for k in ("b", "ta", "tb", "ga", "gb")} | {"best": F.lit(math.inf), "value": F.lit(math.inf)}
    at = scratch.stage(targets.withColumns(zero | {"a": F.when(full, 50.0).otherwise(0.0), "done": full}), "duals")
    x, cap = F.col("feature") - centre, math.log(most)
    for _ in range(steps):
        z = F.col("ta") + F.col("tb") * x
        inside = z < cap
        rate = F.when(inside, F.exp(z)).otherwise(float(most))
        dual = F.when(inside, F.exp(z)).otherwise(most * (z - cap) + most)
        m = F.col("mass")
        open_ = at.filter("not done").select(F.col("source").alias("s"), "ta", "tb")
        open_ = F.broadcast(open_) if few else open_
        part = masses.join(open_, F.col("source").eqNullSafe(F.col("s")))
        curve = F.when(inside, m * rate).otherwise(0.0)
        sums = part.groupBy("s").agg(F.sum(m * dual).alias("v"), F.sum(m * rate).alias("got"), F.sum(m * rate * x).alias("gx"), F.sum(curve).alias("h0"), F.sum(curve * x).alias("h1"), F.sum(curve * x * x).alias("h2"))
        nxt = at.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        whole = F.col("source_size").cast("double")
        value = F.col("v") - F.col("ta") * F.col("target") + ridge * whole * F.col("tb") * F.col("tb") / 2
        ga, gb = F.col("got") - F.col("target"), F.col("gx") + ridge * whole * F.col("tb")
        better = value <= F.col("best") + 1e-12 * whole
        # A little of the source's size keeps the curvature invertible where all rates are at the limit.
        haa, hab, hbb = F.col("h0") + 1e-9 * whole, F.col("h1"), F.col("h2") + ridge * whole
        det = haa * hbb - hab * hab
        da, db = (hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det
        longest = F.greatest(F.abs(da), F.abs(db), F.lit(2.0)) / 2.0  # no step beyond 2
        close = better & (F.abs(ga) <= F.greatest(F.col("target") * 1e-9, F.lit(1e-6))) & (F.abs(gb) <= F.greatest(whole * 1e-9, F.lit(1e-6)))
        moved = {
            "a": F.when(better, F.col("ta")).otherwise(F.col("a")),
            "b": F.when(better, F.col("tb")).otherwise(F.col("b")),
            "best": F.when(better, value).otherwise(F.col("best")),
            "ta": F.when(better, F.col("ta") + da / longest).otherwise((F.col("a") + F.col("ta")) / 2),
            "tb": F.when(better, F.col("tb") + db / longest).otherwise((F.col("b") + F.col("tb")) / 2),
        }
        kept = [F.when(F.col("done"), F.col(k)).otherwise(v).alias(k) for k, v in moved.items()]
        nxt = nxt.select("source", "source_size", "target", *kept, (F.col("done") | F.coalesce(close, F.lit(False))).alias("done"))
        old, at = at, scratch.stage(nxt, "duals")
        scratch.drop(old)
        if not at.filter("not done").limit(1).count():
            break
    return at.select("source", "source_size", "target", "a", "b", F.lit(centre).alias("centre"))


def _thresholds(rows: DataFrame, facts: DataFrame, scratch: Scratch, rounds: int = 3, bins: int = 512) -> DataFrame:
    """(source, size, whole, turn) rows staged, facts -> source, upto: the value of turn up to which documents get one more copy.

    Sums of sizes by bins of turn find the bin in which the target is passed, and then its bins, `rounds` times; a row per source and bin is all that is windowed.
    """
    need = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("sure")).withColumnRenamed("source", "s")
    at = facts.join(need, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), (F.col("target") - F.coalesce("sure", F.lit(0))).cast("double").alias("need"), F.lit(0.0).alias("lo"))
    at = scratch.stage(at, "needs")
    few = at.limit(_SOURCES + 1).count() <= _SOURCES
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  (a row a source)
    width = 1.0
    for _ in range(rounds):
        width /= bins
        # Bins are counted from the exact lower end; a row belongs to the interval that the last round chose, its right end excluded.
        part = rows.filter("turn < 1").join(small(at), F.col("source").eqNullSafe(F.col("s"))).withColumn("bin", F.floor((F.col("turn") - F.col("lo")) / width))
        sums = part.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("s", "bin").agg(F.sum("size").alias("m"))
        w = Window.partitionBy("s").orderBy("bin")
        sums = sums.withColumn("upto", F.sum("m").over(w))
        sums = sums.withColumnRenamed("s", "k").join(small(at), F.col("k").eqNullSafe(F.col("s")))
        # the first bin that passes what is needed, or the end
        crossed = sums.filter(F.col("upto") > F.col("need")).groupBy("k").agg(F.min(F.struct("bin", (F.col("upto") - F.col("m")).alias("before"))).alias("c"))
        nxt = at.join(crossed, F.col("s").eqNullSafe(F.col("k")), "left")
        stay = F.col("c").isNull()
        nxt = nxt.select("s", F.when(stay, F.col("need")).otherwise(F.col("need") - F.col("c.before")).alias("need"), F.when(stay, F.col("lo") + width * (bins - 1)).otherwise(F.col("lo") + F.col("c.bin") * width).alias("lo"))
        old, at = at, scratch.stage(nxt, "needs")
        scratch.drop(old)
    # Of the last bin, which holds a document or so, all or none: whichever is nearer.
    last = rows.join(small(at), F.col("source").eqNullSafe(F.col("s"))).filter((F.col("turn") >= F.col("lo")) & (F.col("turn") < F.col("lo") + width)).groupBy("s").agg(F.sum("size").alias("m")).withColumnRenamed("s", "k")
    at = at.join(last, F.col("s").eqNullSafe(F.col("k")), "left")
    return at.select("s", F.when(F.col("need") * 2 > F.coalesce("m", F.lit(0)), F.col("lo") + width).otherwise(F.col("lo")).alias("upto"))


def _with_number(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, a hash of the text, and place) with `turn_of`, a number in (0, 1) of the row's own. Rows without a doc_id, and those that agree in doc_id and text, take their place in the table's files into it."""
    key = F.xxhash64("doc_id", "h", F.when(F.col("twin") | F.col("doc_id").isNull(), F.col("place")))
    return docs.withColumn("turn_of", (F.pmod(key, F.lit(1 << 40)) + 0.5) / float(1 << 40))


def _narrow(feature: str | None) -> list[Column]:
    """What the mix needs of placed_rows(); feature names a column of the documents."""
    text = F.col("_doc.text").cast("string")
    return [
        F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.source").cast("string").alias("source"), size(text).alias("size"), F.xxhash64(text).alias("h"), F.xxhash64("_file", "_at").alias("place"),
        (F.log1p(size(text)) if feature is None else F.col("_doc")[feature].cast("double")).alias("feature"),
    ]


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, feature: str | None, ridge: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The narrow columns of docs (as placed_rows() gives them), the duals of each source, the rows that agree in doc_id and text, and the thresholds of turn, all staged. Texts are neither staged nor shuffled."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stage(docs.select(*_narrow(feature)), "sizes")
    masses = scratch.stage(rows.groupBy("source", "feature").agg(F.sum("size").alias("mass")), "masses")
    targets = scratch.stage(source_targets(masses.groupBy("source").agg(F.sum("mass").alias("source_size")), weights, share, most), "targets")
    facts = scratch.stage(source_duals(masses, targets, most, ridge), "facts")
    twins = scratch.stage(rows.filter("doc_id is not null").groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("_twin_id"), F.col("h").alias("_twin_h")), "twins")
    out = _with_turn(rows, facts, twins, most)
    turns = scratch.stage(out.select("source", "size", F.floor("rate").alias("whole"), "turn"), "turns")
    upto = scratch.stage(_thresholds(turns, facts, scratch), "thresholds")
    scratch.drop(masses, targets, turns)
    return rows, facts, twins, upto


def _with_turn(rows: DataFrame, facts: DataFrame, twins: DataFrame, most: int) -> DataFrame:
    """rows with the facts of their source, rate and turn: the row's own number over the fractional part of its rate, both between 0 and 1 (u / (u + part)); 1 where there is none."""
    out = rows.join(small_side(facts.withColumnRenamed("source", "_s"), _SOURCES), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.join(small_side(twins), (F.col("doc_id") == F.col("_twin_id")) & (F.col("h") == F.col("_twin_h")), "left").withColumn("twin", F.col("_twin_id").isNotNull()).drop("_twin_id", "_twin_h")
    out = _with_number(out).withColumn("rate", F.round(tilted(F.col("a"), F.col("b"), F.col("feature") - F.col("centre"), most), 9))
    part = F.col("rate") - F.floor("rate")
    return out.withColumn("turn", F.when(part > 0, F.col("turn_of") / (F.col("turn_of") + part)).otherwise(1.0))


def _with_copies(out: DataFrame, upto: DataFrame) -> DataFrame:
    out = out.join(small_side(upto, _SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return out.withColumn("copies", (F.floor("rate") + (F.col("turn") < F.col("upto")).cast("int")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, feature: str | None = None, ridge: float = RIDGE) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, rate, copies, taken (copies * size).

    size is the number of words, 0 for null and empty texts, which get copies by their rate but take nothing. A null source is a
    source. feature names a column of documents that tilts the rates within a source (the logarithm of size + 1 by default). Copies are 0 to `most`. Repeated rows
    are documents of their own. An empty table gives none; other columns are ignored. Reruns over the same files agree.
    """
    rows, facts, twins, upto = _planned(placed_rows(docs), weights, share, most, feature, ridge)
    out = _with_copies(_with_turn(rows, facts, twins, most), upto)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, feature: str | None = None, ridge: float = RIDGE) -> DataFrame:
    """documents -> the same columns, each row as many times as the mix takes it.

    docs is read twice: for the plan, and to repeat its rows by their own columns and the small tables of the plan, without a shuffle. Null and repeated doc_ids count like others.
    """
    docs = placed_rows(docs)
    _, facts, twins, upto = _planned(docs, weights, share, most, feature, ridge)
    out = _with_copies(_with_turn(docs.select("_doc", *_narrow(feature)), facts, twins, most), upto).filter("copies > 0")
    return out.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_doc.*")
