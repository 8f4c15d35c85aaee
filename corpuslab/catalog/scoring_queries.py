"""Similarity, entailment and voting queries over chunk vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import standins as st
from corpuslab.catalog.feature_queries import DIMS, f1_sql
from corpuslab.functions.vectors import entailment, first_max
from corpuslab.operators import corpus, embeddings, experiments, scoring
from corpuslab.plans.scale import inline_table

MIXED = "Qualitative and Quantitative"
HYPOTHESES = ["Quantitative", "Qualitative"]


def _labels(spark: SparkSession, sf_dir: str) -> tuple[Column, list]:
    """Mean vector per label as a constant, in label order, and the label names."""
    chunks = st.chunk_vectors(spark, sf_dir)
    means = embeddings.mean_pool(chunks, ["label"]).orderBy("label")
    return inline_table(means), corpus.label_names(chunks)


def cosine_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, names = _labels(spark, sf_dir)
    scored = scoring.label_similarity(st.chunk_vectors(spark, sf_dir), ["doc_id", "chunk_pos"], labels)
    rows = scoring.score_rows(scored, ["doc_id", "chunk_pos"], names)
    return rows.select(
        "doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "label", (F.round("score", 6) + 0.0).alias("score")
    )


def cosine_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, names = _labels(spark, sf_dir)
    return scoring.similarity_mean(st.chunk_vectors(spark, sf_dir), "doc_id", labels, names)


def cosine_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, names = _labels(spark, sf_dir)
    return scoring.similarity_first_chunk(st.chunk_vectors(spark, sf_dir), "doc_id", labels, names)


def similarity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's class is its first chunk's label."""
    labels, names = _labels(spark, sf_dir)
    chunks = st.chunk_vectors(spark, sf_dir)
    truth = chunks.filter("chunk_pos = 0").select("doc_id", F.col("label").alias("y"))
    report = experiments.similarity_report(chunks, truth, "doc_id", labels, names)
    return report.select("embed_type", F.round("f1_score", 6).alias("f1_score"), F.round("accuracy", 6).alias("accuracy"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector elements 1 to 3 and 4 to 6 as contradiction, neutral and entailment of the two hypotheses."""
    each = F.array(*(
        F.struct(
            F.lit(h).alias("label_pos"), F.lit(name).alias("label"),
            *(F.element_at("vec", 3 * h + i).alias(n) for i, n in ((1, "c"), (2, "n"), (3, "e"))))
        for h, name in enumerate(HYPOTHESES)))
    return st.chunk_vectors(spark, sf_dir).select("doc_id", "chunk_pos", F.inline(each))


def _chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.entailment_scores(_logits(spark, sf_dir), entailment(F.col("c"), F.col("n"), F.col("e")))


def entail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_scores(spark, sf_dir).select(
        "doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "label", F.round("score", 6).alias("score")
    )


def score_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = scoring.normalise_scores(scoring.accumulate_scores(_chunk_scores(spark, sf_dir), "doc_id"), "doc_id")
    return totals.select("doc_id", "label", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


def zero_shot_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = scoring.accumulate_scores(_chunk_scores(spark, sf_dir), "doc_id")
    return scoring.decide(totals, "doc_id", MIXED)


def zero_shot_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk scores every label; the summed scores decide."""
    labels, names = _labels(spark, sf_dir)
    scored = scoring.label_similarity(st.chunk_vectors(spark, sf_dir), ["doc_id", "chunk_pos"], labels)
    rows = scoring.score_rows(scored, ["doc_id", "chunk_pos"], names).withColumnRenamed("label_idx", "label_pos")
    return scoring.decide(scoring.accumulate_scores(rows, "doc_id"), "doc_id")


def skipped_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a document of one chunk; those without a surviving score."""
    def single(rows: DataFrame) -> DataFrame:
        return rows.withColumn("doc_id", F.col("doc_id") * 5 + F.col("chunk_pos"))

    decided = scoring.decide(scoring.accumulate_scores(single(_chunk_scores(spark, sf_dir)), "doc_id"), "doc_id", MIXED)
    return scoring.skipped(single(_logits(spark, sf_dir)), decided, "doc_id").select("doc_id", "label")


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks answer with their nearest label; with and without the mixed band."""
    labels, names = _labels(spark, sf_dir)
    scored = scoring.label_similarity(st.chunk_vectors(spark, sf_dir), ["doc_id", "chunk_pos"], labels)
    rounded = F.transform("scores", lambda s: F.round(s, scoring.SCORE_DIGITS))
    answers = scored.select("doc_id", "chunk_pos", corpus.decode_label(first_max(rounded), names).alias("label"))
    votes = scoring.count_votes(answers, "doc_id")
    plain = corpus.rewrite_labels(scoring.decide(votes, "doc_id"), "yhat", {"0": MIXED})
    banded = scoring.decide(votes, "doc_id", MIXED).withColumnRenamed("yhat", "yhat_band")
    return plain.join(banded, "doc_id")


def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed scores, entailment with the mixed band and votes against the first chunk's class."""
    first = st.chunk_vectors(spark, sf_dir).filter("chunk_pos = 0")
    plain = first.select("doc_id", F.col("label").alias("y"))
    which = (F.col("label").cast("int") % 2).cast("int")
    hypothesis = first.select("doc_id", corpus.decode_label(which, HYPOTHESES).alias("y"))
    decisions = {
        "auto": zero_shot_auto(spark, sf_dir),
        "manual": zero_shot_manual(spark, sf_dir),
        "vote": majority_vote(spark, sf_dir).select("doc_id", "yhat"),
    }
    report = experiments.decision_report(decisions, {"auto": plain, "manual": hypothesis, "vote": plain}, "doc_id")
    return report.select("experiment_type", F.round("f1_score", 6).alias("f1_score"), F.round("accuracy", 6).alias("accuracy"))


COS = f"""d AS MATERIALIZED ({DIMS}),
means AS MATERIALIZED (SELECT label, dim, avg(value) AS m FROM d GROUP BY label, dim),
lens AS (SELECT label, sqrt(sum(m * m)) AS len FROM means GROUP BY label)"""
CHUNK_COS = f"""{COS}, cos AS MATERIALIZED (
SELECT doc_id, chunk_pos, means.label, sum(value * m) / (sqrt(sum(value * value)) * any_value(len)) AS score
FROM d JOIN means USING (dim) JOIN lens ON lens.label = means.label GROUP BY doc_id, chunk_pos, means.label)"""
MEAN_COS = f"""{COS}, pooled AS (SELECT doc_id, dim, avg(value) AS value FROM d GROUP BY doc_id, dim),
pcos AS (SELECT doc_id, means.label, sum(value * m) / (sqrt(sum(value * value)) * any_value(len)) AS score
FROM pooled JOIN means USING (dim) JOIN lens ON lens.label = means.label GROUP BY doc_id, means.label),
pbest AS (SELECT doc_id, label AS yhat FROM pcos QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, label) = 1)"""
FIRST = """flists AS (SELECT doc_id, label, list(round(score, 12) ORDER BY chunk_pos) AS l FROM cos GROUP BY doc_id, label),
fbest AS (SELECT doc_id, label AS yhat FROM flists QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, label) = 1)"""
LOGITS = """logits AS (SELECT vec_id // 5 AS doc_id, vec_id % 5 AS chunk_pos, h AS label_pos,
  CASE h WHEN 0 THEN 'Quantitative' ELSE 'Qualitative' END AS label,
  embedding[3 * h + 1]::DOUBLE AS c, embedding[3 * h + 2]::DOUBLE AS n, embedding[3 * h + 3]::DOUBLE AS e
  FROM embeddings, range(2) AS r(h)),
scored AS (SELECT *, exp(e) / (exp(c) + exp(e)) AS score FROM logits WHERE NOT (n > c AND n >= e)),
totals AS (SELECT doc_id, label, sum(score) AS score, min(chunk_pos * 1000 + label_pos) AS first FROM scored GROUP BY doc_id, label)"""


def _decide_sql(totals: str, mixed: str | None) -> str:
    answer = "max_by(label, rn)"
    if mixed:
        answer = f"CASE WHEN bool_or(share > 0.33::DOUBLE AND share < 0.67::DOUBLE) THEN '{mixed}' ELSE {answer} END"
    return f"""SELECT doc_id, {answer} AS yhat FROM (
SELECT doc_id, label, score / sum(score) OVER (PARTITION BY doc_id) AS share,
       -row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, first) AS rn FROM {totals}) GROUP BY doc_id"""


_AUTO = "auto AS (SELECT doc_id, label, sum(score) AS score, min(chunk_pos * 1000 + label::INT) AS first FROM cos GROUP BY doc_id, label)"
_VOTES = """answers AS (SELECT doc_id, chunk_pos, label FROM cos QUALIFY row_number() OVER
  (PARTITION BY doc_id, chunk_pos ORDER BY round(score, 12) DESC, label) = 1),
votes AS (SELECT doc_id, label, count(*)::DOUBLE AS score, min(chunk_pos) AS first FROM answers GROUP BY doc_id, label)"""

QUERIES = {
    "cosine_label": cosine_label,
    "cosine_predict": cosine_predict,
    "cosine_first_chunk": cosine_first_chunk,
    "similarity_report": similarity_report,
    "entail_scores": entail_scores,
    "score_sum": score_sum,
    "zero_shot_manual": zero_shot_manual,
    "zero_shot_auto": zero_shot_auto,
    "skipped_docs": skipped_docs,
    "majority_vote": majority_vote,
    "decision_report": decision_report,
}

ORACLE = {
    "cosine_label": f"WITH {CHUNK_COS} SELECT doc_id, chunk_pos, label, round(score, 6) + 0.0 AS score FROM cos",
    "cosine_predict": f"WITH {MEAN_COS} SELECT * FROM pbest",
    "cosine_first_chunk": f"WITH {CHUNK_COS}, {FIRST} SELECT * FROM fbest",
    "similarity_report": f"""WITH {CHUNK_COS}, {FIRST}, {MEAN_COS[len(COS) + 2:]},
truth AS (SELECT vec_id // 5 AS doc_id, label::VARCHAR AS y FROM embeddings WHERE vec_id % 5 = 0),
answers AS (SELECT 'chunked' AS embed_type, yhat, y FROM fbest JOIN truth USING (doc_id)
            UNION ALL SELECT 'avg', yhat, y FROM pbest JOIN truth USING (doc_id))
SELECT embed_type, round(f1, 6) AS f1_score, round(accuracy, 6) AS accuracy FROM ({f1_sql('answers', 'embed_type')})""",
    "entail_scores": f"WITH {LOGITS} SELECT doc_id, chunk_pos, label, round(score, 6) AS score FROM scored",
    "score_sum": f"WITH {LOGITS} SELECT doc_id, label, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY doc_id), 6) AS share FROM totals",
    "zero_shot_manual": f"WITH {LOGITS} {_decide_sql('totals', MIXED)}",
    "zero_shot_auto": f"WITH {CHUNK_COS}, {_AUTO} {_decide_sql('auto', None)}",
    "skipped_docs": f"WITH {LOGITS} SELECT doc_id * 5 + chunk_pos AS doc_id, label FROM logits WHERE doc_id * 5 + chunk_pos NOT IN (SELECT doc_id * 5 + chunk_pos FROM scored)",
    "decision_report": f"""WITH {CHUNK_COS}, {_VOTES}, {_AUTO}, {LOGITS},
truth AS (SELECT vec_id // 5 AS doc_id, label::VARCHAR AS y, CASE label % 2 WHEN 0 THEN 'Quantitative' ELSE 'Qualitative' END AS h FROM embeddings WHERE vec_id % 5 = 0),
decided AS (SELECT 'auto' AS experiment_type, y, yhat FROM ({_decide_sql('auto', None)}) JOIN truth USING (doc_id)
  UNION ALL SELECT 'manual', h, yhat FROM ({_decide_sql('totals', MIXED)}) JOIN truth USING (doc_id)
  UNION ALL SELECT 'vote', y, CASE yhat WHEN '0' THEN '{MIXED}' ELSE yhat END FROM ({_decide_sql('votes', None)}) JOIN truth USING (doc_id))
SELECT experiment_type, round(f1, 6) AS f1_score, round(accuracy, 6) AS accuracy FROM ({f1_sql('decided', 'experiment_type')})""",
    "majority_vote": f"""WITH {CHUNK_COS}, {_VOTES}
SELECT doc_id, CASE p.yhat WHEN '0' THEN '{MIXED}' ELSE p.yhat END AS yhat, b.yhat AS yhat_band
FROM ({_decide_sql('votes', None)}) p JOIN ({_decide_sql('votes', MIXED)}) b USING (doc_id)""",
}
