"""Personal data: base patterns, and identifiers discovered from the contexts that they occur in.

Spans of the base patterns are seeds. What stands before and after a word, with the shape of the
word, is a lexical pattern; so is what stands before or after a word of any shape, if three different seeds stand there and enough of its occurrences
in the corpus are beside seeds. Patterns and instances form a graph: a pattern is as good as the instances that it
extracts, an instance as good as the patterns that extract it, seeds being certain. After a few rounds, good patterns give
away identifiers that no base pattern knows. These back patterns of the next generation, which are induced anew from all that is known by then, until
nothing new is found or the generations are used up. What is found later scores less, as each pattern scores less than its instances do.

Words of the whole corpus are only ever counted, or looked up in small tables: a pattern for any shape is tested on counts first, so that the
graph holds a few edges a seed and never the neighbourhood of common words. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import Scratch, small_side, stage

KINDS = ["email", "ip", "card", "phone", "context"]
_LOCAL, _LABEL, _SPACE = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", r"\x20\x09-\x0D"
#: The base patterns with possessive quantifiers, which match the same here without recursion. A look-behind keeps the search linear
#: in long runs: a match begins where its run does, or where the match before it ended. Cards have 14 digits at least.
PATTERNS = [
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_NEEDS = ["@", ".", None, "+"]
#: Words with a number or an at sign: those of base spans, and all that can have the shape of one.
_TOKEN = rf"(?<![^{_SPACE}])[^\p{{N}}@{_SPACE}]*+[\p{{N}}@][^{_SPACE}]*+"
_MARKED, _TRIM = r"[\p{N}@]", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_GAP = rf"[{_SPACE}]+"
_OPEN, _SHUT = "\x01", "\x02"
SPAN = "struct<start: int, kind: int, stop: int>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: an expression named in a lambda is computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, pattern: str) -> Column:
    """The text before the first match, and then for each match the match, a mark, and the text up to the next. Lengths are those of the text, but for the marks."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN, -1)


def _starts(pieces: Column) -> Column:
    """Where each match starts, in code points."""
    first = F.struct(F.char_length(pieces[0]).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.char_length(p) - 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), first, step)["out"]


def _luhn(digits: Column) -> Column:
    def value(k):
        d = F.substring(digits, F.char_length(digits) - k, F.lit(1)).cast("int") * (1 + k % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.char_length(digits) - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _good(kind: int, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == 1:
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == 2:
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == 3 else F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of the four base kinds in a text that holds no mark, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    matched = lambda p: F.substring_index(p, _SHUT, 1)

    def of(kind: int) -> Column:
        rest = lambda pieces: F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        rows = _let(_pieces(text, PATTERNS[kind]), lambda x: F.zip_with(_starts(x), rest(x), lambda at, p: F.struct(at.alias("at"), matched(p).alias("m"))))
        good = F.filter(rows, lambda r: _good(kind, r["m"]))
        spans = F.transform(good, lambda r: F.struct(r["at"].alias("start"), F.lit(kind).alias("kind"), (r["at"] + F.char_length(r["m"])).alias("stop")))
        may = text.rlike(r"[0-9]") if _NEEDS[kind] is None else F.instr(text, _NEEDS[kind]) > 0
        return F.when(may & text.rlike(PATTERNS[kind]), spans).otherwise(none)

    found = [of(kind) for kind in range(4)]
    return F.array_sort(F.concat(*found))


def unmarked(text: Column) -> Column:
    """A text of the same length whose characters 01 and 02, which no pattern matches, are 03. Few texts hold one, and looking for it is far cheaper than translating."""
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT))
    return F.when(marked, F.translate(text, _OPEN + _SHUT, "\x03\x03")).otherwise(F.coalesce(text, F.lit("")))


def candidates(text: Column, base: Column) -> Column:
    """Words with a number or an at sign: their core, its span and shape, the whole words beside them ('' where that is such a word too), and whether a base span meets them."""

    def row(pieces, at, k):
        token, rest, before = F.substring_index(pieces[k + 1], _SHUT, 1), F.substring_index(pieces[k + 1], _SHUT, -1), F.substring_index(pieces[k], _SHUT, -1)
        core = F.regexp_replace(token, _TRIM, "")
        start = at + F.char_length(F.regexp_extract(token, r"^[^\p{L}\p{N}]+", 0))
        left = F.lower(F.substring_index(F.rtrim(before), " ", -1))
        right = F.lower(F.substring_index(F.ltrim(rest), " ", 1))
        shape = F.regexp_replace(F.regexp_replace(core, r"\p{L}+", "a"), r"\p{N}", "9")
        seed = F.exists(base, lambda b: (b["start"] < at + F.char_length(token)) & (b["stop"] > at))
        return F.struct(start.alias("start"), (start + F.char_length(core)).alias("stop"), core.alias("core"), left.alias("left"), right.alias("right"), shape.alias("shape"), seed.alias("seed"))

    none = F.array().cast("array<struct<start: int, stop: int, core: string, left: string, right: string, shape: string, seed: boolean>>")
    pieces = _pieces(F.regexp_replace(text, r"[\x09-\x0D]", " "), _TOKEN)
    return F.when(text.rlike(_MARKED), _let(pieces, lambda x: F.transform(_starts(x), lambda at, k: row(x, at, k)))).otherwise(none)


def _sides() -> Column:
    return F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("right").alias("word")))


def _core(word: str = "word") -> Column:
    return F.regexp_replace(word, _TRIM, "")


def _beside(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(rid, t) rows, near(side, near) small -> rid, k, word, side, near: the k-th word of a text (what lies between white space) that stands after (l) or before (r) one of near."""
    words = F.split("t", _GAP, -1)
    n, edge = F.size("w"), F.array(F.lit(""))
    around = F.arrays_zip(F.col("w").alias("near"), F.concat(edge, F.slice("w", 1, n - 1)).alias("before"), F.concat(F.slice("w", 2, n), edge).alias("after"))
    flat = rows.select("rid", words.alias("w")).select("rid", F.posexplode(around).alias("k", "x"))
    found = flat.withColumn("near", F.lower("x.near")).join(near, "near")
    after = F.col("side") == "l"
    return found.select("rid", F.when(after, F.col("k") + 1).otherwise(F.col("k") - 1).alias("k"), F.when(after, F.col("x.after")).otherwise(F.col("x.before")).alias("word"), "side", "near").filter("word <> ''")


def _words_beside(texts: DataFrame, cores: DataFrame) -> DataFrame:
    """(rid, t) rows, cores(core) small -> core, side, near: the words before (l) and after (r) each occurrence of a core as a word of a text."""
    words = F.split("t", _GAP, -1)
    n, edge = F.size("w"), F.array(F.lit(""))
    around = F.arrays_zip(F.col("w").alias("word"), F.concat(edge, F.slice("w", 1, n - 1)).alias("left"), F.concat(F.slice("w", 2, n), edge).alias("right"))
    flat = texts.select(words.alias("w")).select(F.explode(around).alias("x")).select(_core("x.word").alias("core"), F.lower("x.left").alias("left"), F.lower("x.right").alias("right"))
    return flat.join(cores, "core").select("core", F.explode(_sides()).alias("s")).select("core", "s.side", F.col("s.word").alias("near")).filter("near <> ''")


def backed_graph(edges: DataFrame, known: DataFrame, least_seeds: int) -> DataFrame:
    """edges(pattern, core), known(core, base) -> pattern, core, base: the edges of patterns that extract `least_seeds` different known instances.

    Other patterns may extract nothing, so they have no say; counting them away first leaves a graph of a few edges a pattern in use.
    base tells whether the instance is a seed of the base patterns.
    """
    backed = edges.join(small_side(known.select("core")), "core").groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= least_seeds).select("pattern")
    backed = stage(backed, "backed")
    return edges.join(small_side(backed), "pattern").join(small_side(known), "core", "left").select("pattern", "core", F.coalesce("base", F.lit(False)).alias("base"))


def scored_patterns(graph: DataFrame, rounds: int = 3, prior: float = 1.0) -> DataFrame:
    """backed_graph(), staged -> pattern, conf.

    A pattern's confidence is the sum of its instances' scores over their number plus `prior`; a base seed scores 1, another
    instance the best confidence among its patterns (0 before the first round). Each round is two joins.
    """
    score = graph.groupBy("core").agg(F.max(F.col("base").cast("double")).alias("score"))
    for k in range(rounds):
        conf = graph.join(score, "core").groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("conf"))
        if k < rounds - 1:
            score = graph.join(conf, "pattern").groupBy("core").agg(F.when(F.max("base"), 1.0).otherwise(F.max("conf")).alias("score"))
    return conf


def find_spans(docs: DataFrame, **options) -> DataFrame:
    """documents -> doc_id, base and extra: see row_spans(). Repeated rows
    give repeated rows with equal spans; null doc_ids are kept. An empty table gives none; other columns are ignored."""
    return row_spans(docs.select("doc_id", "text"), **options).select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "base", "extra")


def row_spans(docs: DataFrame, confidence: float = 0.75, least_seeds: int = 3, selective: float = 0.25, generations: int = 3) -> DataFrame:
    """documents -> _doc (a struct of the row), base and extra: arrays of (start, kind, stop) in code points, sorted.

    extra holds words that no base span meets. A word with a number or an at sign is in it if a pattern of `confidence` at least, with `least_seeds`
    distinct known instances, extracts it. Any other word is in it where the word before or after is such a pattern for all shapes, if half of the word's occurrences stand so:
    else it is a word of the language. A neighbour of `least_seeds` distinct known instances is a pattern for all shapes if a share of `selective` of its occurrences
    in the corpus are beside them; this is counted before any edge is drawn. Base spans are known at first, and what a generation finds is known to the next.
    Each row counts by itself, whatever its doc_id. Empty texts have no span; spans do not join words.
    """
    scratch = Scratch(docs.sparkSession)
    t = unmarked(F.col("_doc.text"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("rid")).withColumn("base", base_spans(t))
    rows = scratch.stage(rows.withColumn("found", candidates(t, F.col("base"))), "spans")
    texts = rows.select("rid", "base", t.alias("t"))
    found = rows.select("rid", F.explode("found").alias("f")).select("rid", "f.*").filter("core <> ''")
    flat = found.select("core", "shape", "seed", F.explode(_sides()).alias("s")).filter("s.word <> ''").select("core", "shape", "seed", "s.side", F.col("s.word").alias("near"))
    edges = scratch.stage(flat.select(F.concat_ws("\x01", "side", "near", "shape").alias("pattern"), "core").distinct(), "graph")
    known = scratch.stage(found.filter("seed").select("core", F.lit(True).alias("base")).distinct(), "known")

    counted = lambda df: df.groupBy("side", "near", "core").agg(F.count("*").alias("times"))
    pairs = fresh = scratch.stage(counted(flat.filter("seed")), "pairs")
    usable = beside = None
    for _ in range(generations):
        new = _selective(scratch, texts, pairs, fresh, usable, least_seeds, selective)
        if not new.isEmpty():
            usable = new if usable is None else usable.unionByName(new)
            more = _beside(texts, small_side(new)).withColumn("core", _core()).filter("core <> ''").withColumn("pattern", F.concat_ws("\x01", "side", "near"))
            more = scratch.stage(more, "beside")
            beside = more if beside is None else beside.unionByName(more)
            edges = edges.unionByName(more.select("pattern", "core").distinct())
        graph = scratch.stage(backed_graph(edges, known, least_seeds), "backed_graph")
        good = scratch.stage(scored_patterns(graph).filter(F.col("conf") >= confidence).select("pattern"), "good")
        sure = graph.join(small_side(good), "pattern").select("core").distinct().join(known.filter("base").select("core"), "core", "left_anti")
        sure = scratch.stage(sure.filter(F.col("core").rlike(_MARKED)), "sure")
        hits = _plain_hits(scratch, texts, beside, good) if beside is not None else None
        first = sure if hits is None else sure.unionByName(hits.select("core").distinct())
        first = scratch.stage(first.join(known.select("core"), "core", "left_anti"), "first")
        if first.isEmpty():
            break
        known = known.unionByName(first.select("core", F.lit(False).alias("base")))
        near = flat.join(small_side(first), "core").select("core", "side", "near")
        plain = first.filter(~F.col("core").rlike(_MARKED))
        if not plain.isEmpty():
            near = near.unionByName(_words_beside(texts, small_side(plain)))
        fresh = scratch.stage(counted(near), "pairs")
        pairs = pairs.unionByName(fresh)

    kind = F.lit(len(KINDS) - 1).alias("kind")
    spans = found.filter("not seed").join(small_side(sure), "core").select("rid", F.struct("start", kind, "stop").alias("span"))
    if hits is not None:
        hits = scratch.stage(hits.groupBy("rid").agg(F.collect_list(F.struct("k", "core", "word")).alias("hits")), "plain_hits")
        pieces = F.transform(F.split("t", rf"(?<=[{_SPACE}])(?=[^{_SPACE}])", -1), F.char_length)
        at = texts.join(small_side(hits), "rid").select("rid", "base", pieces.alias("sizes"), F.explode("hits").alias("h")).select("rid", "base", "sizes", "h.*")
        start = F.aggregate(F.slice("sizes", 1, F.col("k")), F.lit(0), lambda a, x: a + x) + F.char_length(F.regexp_extract("word", r"^[^\p{L}\p{N}]+", 0))
        at = at.select("rid", "base", start.alias("start"), (start + F.char_length("core")).alias("stop"))
        at = at.filter(~F.exists("base", lambda b: (b["start"] < F.col("stop")) & (b["stop"] > F.col("start"))))
        spans = spans.unionByName(at.select("rid", F.struct("start", kind, "stop").alias("span")))
    extra = scratch.stage(spans.groupBy("rid").agg(F.array_sort(F.collect_set("span")).alias("extra")), "extra")
    out = rows.select("rid", "_doc", "base").join(small_side(extra), "rid", "left")
    return out.select("_doc", "base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")).alias("extra"))


def _selective(scratch: Scratch, texts: DataFrame, pairs: DataFrame, fresh: DataFrame, usable: DataFrame | None, least_seeds: int, selective: float) -> DataFrame:
    """pairs(side, near, core, times) of all known instances, fresh those of the newest -> side, near: the neighbours of a fresh one that become patterns for all shapes now."""
    near = pairs.groupBy("side", "near").agg(F.count("*").alias("n"), F.sum("times").alias("beside")).filter(F.col("n") >= least_seeds)
    near = near.join(fresh.select("side", "near").distinct(), ["side", "near"], "left_semi")
    if usable is not None:
        near = near.join(usable, ["side", "near"], "left_anti")
    near = scratch.stage(near, "neighbours")
    if near.isEmpty():
        return near.select("side", "near")
    # The neighbours are words; each word of the corpus is one row of which only the word is kept, and counted before the shuffle.
    words = texts.select(F.explode(F.split(F.lower("t"), _GAP, -1)).alias("near"))
    times = words.join(small_side(near.select("near").distinct()), "near").groupBy("near").agg(F.count("*").alias("all"))
    return scratch.stage(near.join(times, "near").filter(F.col("beside") >= selective * F.col("all")).select("side", "near"), "selective")


def _plain_hits(scratch: Scratch, texts: DataFrame, beside: DataFrame, good: DataFrame) -> DataFrame | None:
    """rid, k, core, word of the words without number or at sign that stand beside a good pattern for all shapes, if half of all occurrences of their core do; None if there is none."""
    hits = scratch.stage(beside.filter(~F.col("core").rlike(_MARKED)).join(small_side(good), "pattern").select("rid", "k", "core", "word").distinct(), "hits")
    cores = scratch.stage(hits.groupBy("core").agg(F.count("*").alias("hits")), "plain")
    if cores.isEmpty():
        return None
    words = texts.select(F.explode(F.split("t", _GAP, -1)).alias("word")).filter("word <> ''").select(_core().alias("core"))
    times = words.join(small_side(cores.select("core")), "core").groupBy("core").agg(F.count("*").alias("all"))
    usual = scratch.stage(cores.join(times, "core").filter("2 * hits >= all").select("core"), "usual")
    return scratch.stage(hits.join(small_side(usual), "core"), "usual_hits")


def _said(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """documents -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_context, spans. See find_spans() for nulls, empty texts and repeated rows."""
    spans = find_spans(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        F.size("extra").cast("long").alias("n_context"),
        _said(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """documents -> the same columns, each span in text replaced by its kind in brackets, n_chars counted anew where there is one.

    Overlapping spans give one mark after another without the text that they share. Each row is cut at the spans of its own text, whatever its doc_id is; texts stay beside their spans and are not shuffled for it.
    """
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, spans = F.col("_doc.text"), F.array_sort(F.concat("base", "extra"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["parts"], F.array(gap, F.element_at(kinds, s["kind"] + 1))).alias("parts"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    out = row_spans(docs, **options).withColumn("_text", F.when(F.size("base") + F.size("extra") > 0, done).otherwise(text))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
