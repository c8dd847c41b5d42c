"""Registered queries of the training-data operators: name, query over whole tables, SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from odflow.llm import bpe, divergence, html_text, language, media, merkle, near_dedup, packing, quality, suffix_dedup, toxicity, warc
from odflow.llm.common import stored, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_matrix(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.digest(stored(packed))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_sum_of_squares(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.stored_media(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_proofs(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(warc.archived_pages(table(spark, sf_dir, "pages"))).drop("error")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_bpe, op3_best_fit_packing, op4_sum_of_squares_packing, op5_toxicity,
        op6_quality, op7_html_text, op8_language, op9_near_dedup, op10_jpeg_media,
        op11_merkle_manifest, op12_warc, op13_source_divergence,
    )
} | {"pipeline": corpus_pipeline.run}

_SPACES = r"[\x20\x09-\x0D]+"
_QUARTILES = ", ".join(f"quantile_disc({x}, 0.25) AS {x}1, quantile_disc({x}, 0.75) AS {x}3" for x in "abc")
_FENCES = ", ".join(f"{x}1 - 6.0 * ({x}3 - {x}1 + {slack}) AS {x}_lo, {x}3 + 6.0 * ({x}3 - {x}1 + {slack}) AS {x}_hi, {x}1, {x}3" for x, slack in (("a", 0.05), ("b", 0.5), ("c", 0.01)))
_BEYOND = " OR ".join(f"coalesce(r.{x} > w.{x}_hi AND (r.{x} > o.{x}_hi OR o.{x}3 > w.{x}_hi), false)" for x in "abc")



def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_ENCODED = " || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars"))) + " AS head"
#: One byte b of a CRC-32 whose state is c.
_CRC = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, z: xor(a >> 1, 3988292384::UBIGINT * (a & 1)))"

#: SQL twins. Quartiles of small groups are exact in both; the order in which equal texts stand does not matter.
SQL: dict[str, str] = {
    "op6_quality": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, doc_id, lang, source, list_filter(string_split_regex(t, '{_SPACES}'), lambda e: e <> '') AS words, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda e: regexp_matches(e, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM x),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM k),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
f AS (SELECT x.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM x LEFT JOIN rep ON rep.rid = x.rid),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / nullif(n_words, 0) AS a, word_chars / nullif(n_words, 0) AS b, n_dup_lines / nullif(n_words, 0) AS c FROM f),
o AS (SELECT lang, source, {_FENCES} FROM (SELECT lang, source, {_QUARTILES} FROM r WHERE NOT base_failed GROUP BY lang, source)),
w AS (SELECT lang, {_FENCES} FROM (SELECT lang, {_QUARTILES} FROM r WHERE NOT base_failed GROUP BY lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_BEYOND} OR coalesce(r.b < w.b_lo AND (r.b < o.b_lo OR o.b1 < w.b_lo), false)) AS kept
FROM r LEFT JOIN o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source LEFT JOIN w ON r.lang IS NOT DISTINCT FROM w.lang""",
    "op9_near_dedup": rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda e: e <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE unnest(list_transform(range(1, greatest(len(words), 2)), lambda i: words[i] || ' ' || words[i + 1])) END AS g FROM d WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- of two sets that are alike, the prefixes in one order of all shingles share one
f AS (SELECT g, count(*) AS k FROM s GROUP BY g),
p AS (SELECT s.doc_id, s.g, n.n FROM s JOIN f USING (g) JOIN n USING (doc_id) QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY f.k, s.g) <= n.n - ceil(0.8 * n.n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r WHERE e.b < reach.doc_id OR e.b > reach.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id, coalesce(m.r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)""",
    # leaves, then levels of threes until one node is left; the CRC-32 is worked out bit by bit
    "op11_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, * FROM documents),
v AS (SELECT rid, doc_id, source, {_ENCODED}, text, CASE WHEN list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT)), lambda c, b: {_CRC}) % 2 = 1 THEN replace(text, chr(10), '') END AS changed FROM d),
f AS (SELECT rid, doc_id, source, sha256(head || {_encoded('text')}) AS leaf, CASE WHEN changed IS NOT NULL THEN sha256(head || {_encoded('changed')}) END AS changed FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM f),
nodes AS (SELECT source, 0 AS level, place, total, leaf AS hash FROM r UNION ALL SELECT source, level + 1, place // 3, (total + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM nodes WHERE total > 1 GROUP BY source, level, place // 3, total),
sub AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops AS (SELECT 0 AS level, place, total, hash FROM sub UNION ALL SELECT level + 1, place // 3, (total + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM tops WHERE total > 1 GROUP BY level, place // 3, total),
steps AS (SELECT a.source, a.level, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS behind FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.total > 1 GROUP BY ALL),
top_steps AS (SELECT a.level, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS behind FROM tops a JOIN tops b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.total > 1 GROUP BY ALL),
climb AS (SELECT rid, doc_id, source, leaf, place, 0 AS level, coalesce(changed, leaf) AS folded, '' AS siblings FROM r
  UNION ALL SELECT rid, doc_id, c.source, leaf, c.place // 3, c.level + 1, sha256(s.before || folded || s.behind), siblings || s.before || s.behind FROM climb c JOIN steps s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.place = s.place),
done AS (SELECT rid, arg_max(struct_pack(folded, siblings), level) AS x FROM climb GROUP BY rid),
over AS (SELECT r.rid, r.doc_id, r.leaf, sub.hash AS subroot, sub.place, 0 AS level, x.folded AS folded, x.siblings AS siblings FROM r JOIN done USING (rid) JOIN sub ON r.source IS NOT DISTINCT FROM sub.source
  UNION ALL SELECT rid, doc_id, leaf, subroot, o.place // 3, o.level + 1, sha256(s.before || folded || s.behind), siblings || s.before || s.behind FROM over o JOIN top_steps s ON o.level = s.level AND o.place = s.place)
SELECT doc_id, leaf, subroot, (SELECT hash FROM tops WHERE total = 1) AS root, sha256(x.siblings) AS proof_sha256, x.folded AS folded_root, x.folded = (SELECT hash FROM tops WHERE total = 1) AS verified
FROM (SELECT rid, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(subroot) AS subroot, arg_max(struct_pack(folded, siblings), level) AS x FROM over GROUP BY rid)""",
    "op12_warc": """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN nullif(min(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM f""",
    "op13_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS everywhere FROM x GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(everywhere) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, everywhere FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, m.n, 1 + (1000000000::HUGEINT * (m.n + 5)) // (sum(m.n) OVER (PARTITION BY lang, source) + 5 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (everywhere + 5)) // (v.n + 5 * v.v)::HUGEINT AS q FROM m JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
a AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a QUALIFY part = 'pair' OR rank <= 50""",
}
