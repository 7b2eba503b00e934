"""The registered queries opN_<name> and pipeline: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import chat_format, fingerprints, html_extract, lexical_search, minhash, mixing, pii, quality_bayes, quality_rules, sentencepiece_fst, source_audit, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.isolation_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("n_lines", "n_upper", "n_stops", "n_distinct", "threshold")


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def piece_model() -> bytes:
    """The public 32k piece model of this machine; any BPE model file will do."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.coded(_table(spark, sf_dir, "documents"), piece_model())


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(_table(spark, sf_dir, "documents"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.site_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op11_pattern_tree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def byte_ranks() -> tuple[bytes, str]:
    """The public byte-level vocabulary of this machine and the pattern that splits texts for it; any file of ranks will do."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op12_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.format_and_check(rows, *byte_ranks())


def op13_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

#: Every pair of sources term by term, without the tree.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
r AS (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
 FROM k JOIN v ON v.lang = k.lang JOIN s ON s.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
te AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM r WHERE n > 0 AND p > q),
al AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM te))
SELECT * FROM al WHERE part = 'pair' OR rank <= 200
"""

#: Lengths of the template's marks and one backslash for each control string; the order of equal turns is the operator's.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(t) + len(regexp_extract_all(t, '<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|SAYS)\]')) AS chars,
 CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|SAYS)\]')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(t))) AS turns_sha256,
 coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, md5(t)) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(chars + marks)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

#: Every document scored for every item.
SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
l AS (SELECT id, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0), tot AS (SELECT count(*) AS nd, sum(n) AS nt FROM l),
p AS (SELECT id, doc_id, n, w AS term, count(*) AS tf FROM (SELECT id, doc_id, n, unnest(t) AS w FROM l) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, id, any_value(doc_id) AS doc_id, sum(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd)::BIGINT // nt))))::BIGINT AS score
 FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN tot GROUP BY item_id, id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_minmax_dedup, op2_isolation_rules, op3_subword_toxicity, op4_warc_archive, op5_style_tree, op6_piece_transducer, op7_scaled_sketch, op8_entropy_mix, op9_site_bayes, op10_context_pii, op11_pattern_tree_audit, op12_chat_tokens, op13_stratified_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_archive": WARC_SQL, "op11_pattern_tree_audit": AUDIT_SQL, "op12_chat_tokens": CHAT_SQL, "op13_stratified_search": SEARCH_SQL}
