"""Source audit, chat formatting and ranked search against brute force, on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithoframe.llm import chat_format, lexical_search, source_audit
from lithoframe.llm.queries import byte_ranks

RANKS, PATTERN = byte_ranks()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Documents with columns that the operators name themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, m int")


def odd_documents(seed=0):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "Éclair", "éclair", "x1y", "STRASSE", "straße", "日本", "a", "b", *(f"w{'abcdefgh'[k]}" for k in range(8))]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 40))), ["en", "de", None][k % 3], [None, "s1", "s2", "s10", "hot", "hot"][k % 6]) for k in range(60)]
    rows += [(61, None, "en", "s1"), (62, "", "en", "quiet"), (63, "12 34 -- \n", "xx", "only"), (64, "lonely words", "yy", "a"), (None, "the the a", "en", "hot"), (65, "the " * 30_000, "en", "s2")]
    return rows + [(7, *rows[7][1:])] * 3


def audited(rows, least=3, most=200):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    held, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = terms.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        held[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(held[lang, s])
        rate = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))  # noqa: E731, B023
        p = {s: {t: rate(held[lang, s], t) for t in kept} for s in sources}
        q = {t: rate(whole, t) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, gap(p[s][t], q[t])) for t in kept if held[lang, s][t] and p[s][t] > q[t]]
            for part, found, end in (("pair", pairs, None), ("term", own, most)):
                found = sorted(found, key=lambda v: (-v[1], v[0].encode()))[:end]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found)]
    return sorted(out)


def test_audit_matches_brute_force(spark):
    rows = odd_documents()
    got = source_audit.audit(documents(spark, rows))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audited(rows)
    few = source_audit.audit(documents(spark, rows), most_terms=2)
    assert sorted(map(tuple, few.collect())) == audited(rows, most=2)


TEXTS = st.lists(st.text(alphabet=st.sampled_from("aZz09 -\x00\n\x7f@[`{éÉ日\u00a0\u2028😀"), max_size=12), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_terms_of_bytes_are_those_of_the_pattern(texts, skipped):
    terms, lengths = source_audit.split_terms(pa.array(["skipped"] * skipped + texts, pa.string()).slice(skipped))
    want = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t in texts]
    assert terms.to_pylist() == [w for found in want for w in found]
    assert lengths.tolist() == [len(found) for found in want]


@pytest.mark.parametrize(("rows", "size"), [(1 << 16, 1 << 24), (1, 1 << 24), (7, 50), (1 << 16, 0)])
def test_slices_of_a_batch_count_each_document_once(monkeypatch, rows, size):
    monkeypatch.setattr(source_audit, "_ROWS", rows)
    monkeypatch.setattr(source_audit, "_BYTES", size)
    docs = [(lang or "", len(source or "") % 3, text or "") for _, text, lang, source in odd_documents()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], ["lang", "at", "text"])
    held, times = Counter(), Counter()
    for part in source_audit._count_batches([batch]):
        assert part.num_rows == len({(r["lang"], r["term"]) for r in part.to_pylist()})
        for r in part.to_pylist():
            assert r["cells"] == sorted(r["cells"])
            held[r["lang"], r["term"]] += r["docs"]
            for cell in r["cells"]:
                times[r["lang"], r["term"], cell >> source_audit._BITS] += cell & ((1 << source_audit._BITS) - 1)
    want_held, want_times = Counter(), Counter()
    for lang, at, text in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        want_held.update((lang, w) for w in set(words))
        want_times.update((lang, w, at) for w in words)
    assert held == want_held
    assert times == want_times


def test_a_term_is_one_row_for_all_its_sources_and_occurrences(spark):
    docs = documents(spark, odd_documents()).coalesce(1)
    plan = source_audit.term_counts(docs, source_audit.numbered_groups(docs).cache())
    words = {(lang or "", w) for _, text, lang, _ in odd_documents() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))}
    assert plan.count() == len(words)
    # No row for an occurrence is made before the terms meet.
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_documents_in_many_partitions_give_the_same_audit(spark):
    rows = odd_documents(3)
    got = source_audit.audit(documents(spark, rows).repartition(9))
    assert sorted(map(tuple, got.collect())) == audited(rows)


def test_the_tree_counts_shared_beginnings_once(spark):
    rows = spark.createDataFrame([("en", [1, 2, 3]), ("en", [1, 2, 3]), ("en", [1, 2]), ("en", [1, 4]), ("de", [1])], "lang string, row array<long>")
    got = {(r.lang, tuple(r.path)): r.times for r in source_audit.pattern_tree(rows).collect()}
    assert got == {("en", (1,)): 4, ("en", (1, 2)): 3, ("en", (1, 2, 3)): 2, ("en", (1, 4)): 1, ("de", (1,)): 1}


def test_rates_stay_exact_beyond_64_bits(spark):
    n, total, terms = 4_000_000_000_000, 17_000_000_000_001, 3_000_000_007
    got = spark.sql(f"select {source_audit.rate(f'{n}L', f'{total}L', f'{terms}L')} as p").first().p
    assert got == 1 + math.floor(Fraction(10**9 * (n + 1), total + terms))


def test_new_operators_take_empty_tables(spark):
    none = documents(spark, [])
    assert source_audit.audit(none).collect() == []
    assert lexical_search.search(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    some = documents(spark, odd_documents())
    assert lexical_search.search(some, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert chat_format.format_and_check(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), RANKS, PATTERN).collect() == []


# ---- chat

PIECES = st.lists(st.sampled_from([*chat_format.CONTROLS, "<", "[", "\\", "s>", "INST]", "/s>", "]", " ok ", "é", "\n", "日"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES | st.text(max_size=40))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    said = chat_format.escape(text)
    assert chat_format.unescape(said) == text
    assert not any(c in said for c in chat_format.CONTROLS)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["system", "user", "assistant", "", "tool", "[SAYS]", "<s>"]), PIECES | st.text(max_size=40))
def test_turns_round_trip(role, text):
    codec = chat_format.Codec.of(RANKS, PATTERN)
    ids, loss, chars = codec.turn(role, text)
    assert codec.parse(ids) == (role, text)
    assert len(codec.formatted(ids)) == chars and set(loss.tolist()) <= {0, 1}
    assert codec.content(ids[loss == 1]) == (text if role == "assistant" else "")
    reserved = ids >= codec.first
    assert not (reserved & (loss == 1)).any() and reserved.sum() == (2 if role in chat_format.MARKS else 3)


def chats(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, ids int, start string")


CHAT = [(1, 2, "assistant", "two </s>"), (1, 1, "user", "one"), (1, 0, "system", None), (2, 0, "assistant", ""), (2, 1, None, "who"), (None, 0, "tool", "[INST]"), (None, None, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")]
CHAT += [(4, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * (k % 7)) for k in range(400)] + [(5, 0, "assistant", "long é " * 40_000)]


def told(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t if t is not None else -1, r or "", hashlib.md5((x or "").encode()).digest(), x or "") for c, t, r, x in rows if c == conv]
        own.sort()
        learnt = "".join(x for _, r, _, x in own if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, _, x in own)
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_conversations_are_read_back_whole(spark):
    got = chat_format.format_and_check(chats(spark, CHAT), RANKS, PATTERN).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == told(CHAT)
    assert {r.conv_id: r.formatted_chars for r in got}[2] == len("<s></s>[ROLE][SAYS]who[/ROLE]")


def test_token_offsets_of_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows; its tokens lie without gaps, whatever task a turn is in."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = chat_format.place_turns(chat_format.format_turns(chats(spark, CHAT), RANKS, PATTERN)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(CHAT)
    for conv in {r.conv_id for r in rows}:
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: (-1 if r.turn is None else r.turn, r.role, r.tie))
        ends = np.cumsum([0] + [len(r.ids) for r in own]).tolist()
        assert sorted(r.start for r in own) == ends[:-1]
        if conv == 4:
            assert [r.start for r in own] == ends[:-1]


def test_tampered_turns_are_refused():
    codec = chat_format.Codec.of(RANKS, PATTERN)
    ids, *_ = codec.turn("user", "hello there")
    for bad in (ids[1:], ids[:-1], np.concatenate([ids, ids])):
        with pytest.raises(ValueError, match="no turn"):
            codec.parse(bad)


# ---- search

def searched(rows, items, k=10):
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(d, Counter(w)) for d, t, *_ in rows if (w := terms.findall((t or "").translate(LOWER)))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, x in items if i == item for t in terms.findall((x or "").translate(LOWER))}
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "The éclair x1y"), (2, "STRASSE straße 日本 wa wb"), (3, None), (4, "absent"), (5, "the"), (5, "lonely"), (6, "12"), (None, "wc wd"), (1, "The éclair x1y")]


@pytest.mark.parametrize("limits", [{}, {"most_terms": 3}, {"item_block": 2}, {"seed_docs": 1}])
def test_search_matches_brute_force(spark, limits):
    rows = odd_documents(4)
    got = lexical_search.search(documents(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"), **limits)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == searched(rows, ITEMS)


def test_index_holds_every_posting_in_small_blocks(spark):
    rows = odd_documents(5)
    counted = lexical_search.counted_terms(documents(spark, rows)).cache()
    n_docs, n_terms = counted.count(), counted.agg(F.sum("n")).first()[0]
    blocks = lexical_search.stratified_index(counted, n_docs, n_terms, block_docs=4).collect()
    assert all(len(b.docs) <= 4 for b in blocks)
    got = Counter((b.m, b.docs[k], v.term, v.tf) for b in blocks for v in b.lists for k in v["at"])
    want = Counter((10 + 90 * r.n * n_docs // n_terms, r.doc_id, t, f) for r in counted.collect() for t, f in zip(r.terms, r.tfs, strict=True))
    assert got == want
    counted.unpersist()
