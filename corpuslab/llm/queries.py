"""Registered queries of the subpackage over the given tables, with DuckDB SQL where SQL has it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import archives, bpe, centroids, embeddings, extraction, infill, language, mixing, pieces, quality, simhash, suffix, urls
from corpuslab.llm.common import spread, table, word_count
from corpuslab.plans.scale import cut_lineage


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    mixed = mixing.mix(sized.withColumn("weight", mixing.length_weight(F.col("size"))))
    return mixed.select("doc_id", "source_size", "target", "taken", "size")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def vocabulary() -> bytes:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.digests(bpe.round_trip(docs, vocabulary(), public_tokenizers.PATTERN))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stats = cut_lineage(quality.add_statistics(docs).select("doc_id", "lang", "_s"))
    judged = quality.judge(stats, quality.fit_cutoffs(stats, table(spark, sf_dir, "labels")))
    return judged.select(
        "doc_id", "_s.n_words", "_s.word_chars", "_s.n_symbols", "_s.n_dup_lines", "_s.n_repeat_words",
        "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = language.train(docs.filter(~language.held_out("doc_id")))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.archive(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of the URL query (fixed values of its contract).
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return suffix.remove_repeats(docs, suffix.repeats(docs)).drop("kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return infill.digests(infill.restore(infill.transform(docs)))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.digests(pieces.encode(docs, model, decoded=True))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return centroids.digests(centroids.cluster(vectors))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_simhash": op8_simhash,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_centroid_clustering": op13_centroid_clustering,
}
def lloyd_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024) -> str:
    """The rounds of the clustering as one chain of common tables."""
    nearest = """(SELECT r, vec_id, x, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS a FROM
  (SELECT r, vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {0})
  GROUP BY r, vec_id, x)"""
    steps = [f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {size}
  AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor({scale} * x) AS BIGINT)) AS x FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m
  FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED {nearest.format(f'c{i}')},
s{i} AS (SELECT a.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY a.c, i),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(t.m, c{i}.m) AS m FROM c{i}
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY c) t USING (c))""")
    return ",\n".join(steps) + f""",
z AS (SELECT vec_id, a.c AS c, a.d AS distance FROM {nearest.format(f'c{rounds}')})
SELECT vec_id, CAST(z.c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM z JOIN c{rounds} ON z.c = c{rounds}.c"""


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_source_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM sized GROUP BY source),
ladder AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place,
    1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0) AS rest,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
  FROM sources
  WINDOW earlier AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(CAST(rest AS DOUBLE) / others, place) FILTER (2.0 * source_size > CAST(rest AS DOUBLE) / others * w) AS level
  FROM ladder),
targets AS (
  SELECT source, source_size,
    CASE WHEN 2.0 * source_size <= level * w THEN 2.0 * source_size ELSE level * w END AS target
  FROM sources, level),
drawn AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (0.25::DOUBLE + 0.75::DOUBLE * CAST(least(size, 200) AS DOUBLE) / 200.0::DOUBLE) AS draw
  FROM sized),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn),
chosen AS (
  SELECT doc_id, size, source_size, target, before,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS epochs
  FROM summed JOIN targets ON summed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, source_size, CAST(target AS DOUBLE) AS target, size,
  CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0
    AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM chosen""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN links USING (vec_id)""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n
  FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)""",
    "op9_quality_rules": f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS_SQL} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, coalesce(lang, '') AS stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    floor(200 * n_symbols / greatest(word_chars, 1)), floor(200 * n_capitals / greatest(word_chars, 1)),
    floor(200 * n_exclaims / greatest(word_chars, 1)), floor(200 * n_dup_lines / greatest(n_lines, 1)),
    floor(200 * n_repeat_words / greatest(n_words, 1))] AS bins FROM s),
truth AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT stratum, r AS rule, bins[r] AS bin, count(*) FILTER (good > 0) AS good, count(*) FILTER (good <= 0) AS bad
  FROM b JOIN truth USING (doc_id), (SELECT unnest(range(1, 6)) AS r) WHERE NOT base_failed GROUP BY ALL),
ladder AS (
  SELECT stratum, rule, bin, sum(good) OVER (PARTITION BY stratum, rule) AS n,
    sum(good) OVER down AS x, sum(bad) OVER down AS y FROM counts
  WINDOW down AS (PARTITION BY stratum, rule ORDER BY bin DESC)),
groups AS (SELECT stratum, rule, max(n) AS n, 0.05 / count(*) OVER () AS level FROM ladder GROUP BY stratum, rule),
pmf AS (
  SELECT stratum, rule, level, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) AS p
  FROM (SELECT *, unnest(range(0, CAST(least(n, ceil(n * 0.01)) AS BIGINT) + 1)) AS i FROM groups)),
cdf AS (SELECT stratum, rule, level, i, sum(p) OVER (PARTITION BY stratum, rule ORDER BY i) AS c FROM pmf),
allowed AS (SELECT stratum, rule, max(i) AS k FROM cdf WHERE c <= level GROUP BY stratum, rule),
cutoffs AS (
  SELECT stratum, rule, max((y - 10 * x, bin)) AS best FROM ladder JOIN allowed USING (stratum, rule)
  WHERE x <= k AND bin > 0 AND y - 10 * x > 0 GROUP BY stratum, rule),
over_cut AS (
  SELECT DISTINCT doc_id FROM b JOIN cutoffs USING (stratum) WHERE bins[rule] >= struct_extract(best, 2))
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND over_cut.doc_id IS NULL AS kept
FROM b LEFT JOIN over_cut USING (doc_id)""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
  ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
c AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
    ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM c""",
    "op13_centroid_clustering": lloyd_sql(),
}
