"""Classifier, metric and training-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import standins as st
from corpuslab.catalog.corpus_queries import FRAME_TEXT, FRAME_VIEWS, PREP, VIEWS, corpus_views, frame_views
from corpuslab.catalog.feature_queries import BAG, TFIDF, f1_sql, split_sql
from corpuslab.operators import bayes, contrastive, corpus, epochs, experiments, features, history, knn, learners, metrics, neighbors, pairs, paragraphs, search, splits, svm
from corpuslab.plans.scale import cut_lineage, global_rank

ALPHAS = search.GRIDS["bayes"]["alpha"]
PATIENCE = 5


def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log scores of the test documents of split 0 for every smoothing value."""
    train, test = st.first_split(spark, sf_dir)
    names = corpus.label_names(st.documents(spark, sf_dir))
    train_terms, test_terms = features.fit_features(train, test, "doc_id", "text", "bow", ["label"])
    rows = bayes.bayes_predictions(train_terms, train, test_terms, test, "doc_id", names, ALPHAS)
    return rows.select("doc_id", "alpha", "y", F.posexplode("scores").alias("i", "s"), "yhat").select(
        "doc_id", "alpha", "y", corpus.decode_label(F.col("i"), names).alias("label"), F.round("s", 5).alias("score"), "yhat"
    )


def _folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training documents of split 0 with their fold, and their terms."""
    train, _ = st.first_split(spark, sf_dir)
    folds = splits.stratified_folds(train.select("doc_id", "label"), "label", "doc_id")
    folds = cut_lineage(folds)
    return folds, cut_lineage(features.bag_of_words(train, "doc_id", "text").join(folds, "doc_id"))


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fold macro F1 of every smoothing value."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    folds, terms = _folded(spark, sf_dir)
    cv = bayes.bayes_predictions(terms, folds, terms, folds, "doc_id", names, ALPHAS, fold="fold", folds=5)
    scores = cut_lineage(search.fold_scores(cv, []))
    best = search.best_point(scores).select("point", F.lit(True).alias("best"))
    marked = scores.join(F.broadcast(best), "point", "left")  # best: one row
    return marked.select(
        F.col("point").cast("long").alias("point"), F.round("cv_f1", 6).alias("cv_f1"),
        F.coalesce("best", F.lit(False)).alias("best"),
    )


def bayes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five splits with an inner grid search on the four text views, for both feature kinds."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    return experiments.bayes_report(corpus_views(spark, sf_dir), "doc_id", names, corpus.DATA_TYPES)


def frame_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report on the frames of the abstract, the full text and the important sections."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    return experiments.bayes_report(frame_views(spark, sf_dir), "doc_id", names, FRAME_VIEWS)


def _neighbours(spark: SparkSession, sf_dir: str, kind: str, metric: str, k: int) -> DataFrame:
    train, test = st.first_split(spark, sf_dir)
    train_terms, test_terms = features.fit_features(train, test, "doc_id", "text", kind, ["label"])
    return neighbors.nearest_neighbours(
        train.select("doc_id", "label"), train_terms, test.select("doc_id"), test_terms, "doc_id", k, metric)


def knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_rows(_neighbours(spark, sf_dir, "tfidf", "euclidean", 8))


def knn_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_rows(_neighbours(spark, sf_dir, "bow", "manhattan", 8))


def _nearest_rows(near: DataFrame) -> DataFrame:
    return near.select("test_key", F.col("rank").cast("long").alias("rank"), "train_key", "y_train", F.round("dist", 6).alias("dist"))


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All k and weight choices of the grid from one list of 20 neighbours."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    near = cut_lineage(_neighbours(spark, sf_dir, "tfidf", "euclidean", 20))
    grid = search.GRIDS["knn"]
    rows = neighbors.vote_grid(near, grid["n_neighbors"], grid["weights"], names)
    return rows.withColumn("k", F.col("k").cast("long"))


def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fold macro F1 of all 32 grid points on term counts."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    folds, terms = _folded(spark, sf_dir)
    points = search.grid_points(search.GRIDS["knn"])
    scores = search.fold_scores(neighbors.grid_predictions(terms, folds, "doc_id", names, points), [])
    described = [
        F.struct(F.lit(i).alias("point"), *(F.lit(p[n]).alias(n) for n in ("metric", "n_neighbors", "weights")))
        for i, p in enumerate(points)
    ]
    return scores.withColumn("p", F.element_at(F.array(*described), F.col("point") + 1)).select(
        "p.metric", F.col("p.n_neighbors").cast("long").alias("n_neighbors"), "p.weights", F.round("cv_f1", 6).alias("cv_f1")
    )


def contrastive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    rows = pairs.contrastive_pairs(docs, "doc_id", "label", corpus.label_names(docs))
    return rows.select("anchor", "partner", F.col("round").cast("long").alias("round"), F.col("similar").cast("long").alias("similar"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the embeddings, training and test side of a stratified split."""
    rows = st.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    roles = cut_lineage(splits.stratified_splits(learners.as_features(rows), "vec_id", "label", 1))
    return roles.filter("role = 'train'"), roles.filter("role = 'test'")


def linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the test documents of split 0 by linear machines of all class pairs; the cost is searched."""
    docs = st.documents(spark, sf_dir)
    names = corpus.label_names(docs)
    views = docs.withColumn("data_type", F.lit("text"))
    run = svm.svm_grid(svm.svm_rows(views, "doc_id", names, ["text"], ["tfidf"], 1, 5), len(names), 5, shapes=["linear"])
    return run.tested().select(F.col("key").alias("doc_id"), "y", "yhat")


def svm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five splits with the whole grid of costs, gammas and kernels on the four text views, for both feature kinds."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    return svm.svm_report(corpus_views(spark, sf_dir), "doc_id", names, corpus.DATA_TYPES)


def knn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five splits with the whole grid of neighbours, weights and metrics on the four text views, for both feature kinds."""
    names = corpus.label_names(st.documents(spark, sf_dir))
    return knn.knn_report(corpus_views(spark, sf_dir), "doc_id", names, corpus.DATA_TYPES)


def mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _vectors(spark, sf_dir)
    return learners.fit_predict(learners.feed_forward(64, 10, hidden=1024, max_iter=100), train, test, "vec_id")


def logreg_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _vectors(spark, sf_dir)
    return learners.fit_predict(learners.linear_head(max_iter=100), train, test, "vec_id")


def head_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear head on frozen vectors over two splits, its penalty chosen on three folds."""
    rows = st.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    grid = [{"reg": 0.0}, {"reg": 0.1}]
    return experiments.learner_report(
        learners.as_features(rows).select("vec_id", "features", "label"), "vec_id",
        lambda p: learners.linear_head(max_iter=100, reg=p["reg"]), grid, "linear head", n_splits=2, folds=3)


def word2vec_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.documents(spark, sf_dir)
    return learners.document_word2vec(docs, "doc_id", "text", epochs=10)


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed-forward chunk classifier on frozen vectors, 100 epochs on each of five splits."""
    rows = st.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    return epochs.chunk_report(rows, "vec_id", "vec", "label", 64, 10, "embeddings")


def few_shot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body learned from pairs and a head on frozen vectors, over five splits."""
    rows = st.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").cast("string").alias("label"))
    return contrastive.few_shot_report(rows, "vec_id", corpus.label_names(rows), 64, "embeddings")


def paragraph_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents after 40 epochs, inferred against the trained words."""
    return paragraphs.paragraph_vectors(st.documents(spark, sf_dir), "doc_id", "text")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions per source and language: quality against absence of toxicity."""
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    marks = st.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("y"), (1 - F.col("toxic")).cast("string").alias("yhat")
    )
    return marks.join(docs, "doc_id")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_labelled(spark, sf_dir), ["lang"])


def accuracy_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.accuracy_f1(_labelled(spark, sf_dir), ["source"])
    return scores.select("source", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.classification_report(_labelled(spark, sf_dir), ["lang"])
    return report.select("lang", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def _split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _labelled(spark, sf_dir).withColumn("split", F.regexp_extract("source", r"\d+$", 0).cast("long"))
    return metrics.accuracy_f1(numbered, ["lang", "split"])


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(_split_metrics(spark, sf_dir), ["lang"])


def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_params(_split_metrics(spark, sf_dir).withColumn("param", F.col("split")), ["lang"], "param")


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).join(st.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    generated = rows.withColumn("generated", F.concat(F.lit("Research Design: "), "yhat"))
    return metrics.prediction_table(generated, "text", "generated")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs; an event's position is the epoch and its value the loss."""
    events = st.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("split"), F.col("value").alias("val_loss")
    )
    return global_rank(events, ["event_id"], within=["run"], name="epoch")


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.early_stop(_history(spark, sf_dir), "run", "val_loss", PATIENCE)


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.best_epoch(_history(spark, sf_dir), ["run"], "val_loss")


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run_peaks(_history(spark, sf_dir), "run", "split", ["val_loss"])


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.leaderboard_best(history_summary(spark, sf_dir), "avg_val_loss")




def bayes_sql(model: str, docs: str, tests: str, test_docs: str) -> str:
    """CTEs scores(doc_id, alpha, y, label, score) and chosen(doc_id, alpha, yhat)."""
    return f"""
alphas AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 1.0::DOUBLE), (2, 10.0::DOUBLE)) AS a(point, alpha)),
names AS (SELECT DISTINCT lang AS label FROM documents),
vocab AS MATERIALIZED (SELECT DISTINCT fold, term FROM {model}),
seen AS (SELECT fold, term, label, sum(value) AS n FROM {model} GROUP BY fold, term, label),
tot AS (SELECT fold, label, sum(n) AS t FROM seen GROUP BY fold, label),
v AS (SELECT fold, count(*)::DOUBLE AS v FROM vocab GROUP BY fold),
prior AS (SELECT fold, label, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY fold)) AS p FROM {docs} GROUP BY fold, label),
cond AS MATERIALIZED (SELECT vocab.fold, vocab.term, names.label, coalesce(n, 0) AS n FROM vocab CROSS JOIN names
         LEFT JOIN seen ON seen.fold = vocab.fold AND seen.term = vocab.term AND seen.label = names.label),
matched AS MATERIALIZED (SELECT t.doc_id, t.fold, c.label, t.value, c.n FROM {tests} t JOIN cond c ON c.fold = t.fold AND c.term = t.term),
part AS (SELECT doc_id, fold, label, point, alpha, sum(value * ln(n + alpha)) AS s, sum(value) AS x FROM matched, alphas
         GROUP BY doc_id, fold, label, point, alpha),
scores AS MATERIALIZED (
  SELECT d.doc_id, d.fold, a.point, a.alpha, d.label AS y, prior.label,
         coalesce(s, 0) - coalesce(x, 0) * ln(t + a.alpha * v) + p AS score
  FROM {test_docs} d CROSS JOIN alphas a JOIN prior ON prior.fold = d.fold JOIN tot ON tot.fold = d.fold AND tot.label = prior.label
  JOIN v ON v.fold = d.fold LEFT JOIN part ON part.doc_id = d.doc_id AND part.fold = d.fold AND part.point = a.point AND part.label = prior.label),
chosen AS (SELECT doc_id, fold, point, alpha, y, label AS yhat FROM scores
           QUALIFY row_number() OVER (PARTITION BY doc_id, fold, point ORDER BY round(score, 9) DESC, label) = 1)"""


ONE_MODEL = f"""{TFIDF}, m AS (SELECT 0 AS fold, * FROM train), td AS (SELECT 0 AS fold, doc_id, label FROM split WHERE role = 'train'),
x AS (SELECT 0 AS fold, * FROM test), xd AS (SELECT 0 AS fold, doc_id, label FROM split WHERE role = 'test')"""
FOLDS = f"""{TFIDF}, folds AS MATERIALIZED (SELECT doc_id, label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS own FROM split WHERE role = 'train'),
m AS MATERIALIZED (SELECT k AS fold, t.doc_id, t.label, t.term, CASE WHEN own = k THEN 0.0::DOUBLE ELSE value END AS value
      FROM train t JOIN folds USING (doc_id) CROSS JOIN range(5) r(k)),
td AS (SELECT k AS fold, doc_id, label FROM folds CROSS JOIN range(5) r(k) WHERE own <> k),
x AS (SELECT own AS fold, t.* FROM train t JOIN folds USING (doc_id)),
xd AS (SELECT own AS fold, doc_id, label FROM folds)"""


ALL_MODELS = f"""bag AS MATERIALIZED ({BAG}), sp AS MATERIALIZED ({split_sql(5)}),
dfs AS (SELECT split, term, count(*) AS df FROM bag JOIN sp USING (doc_id) WHERE role = 'train' GROUP BY split, term),
ns AS (SELECT split, count(*) AS n FROM sp WHERE role = 'train' GROUP BY split),
wraw AS (SELECT split, role, bag.doc_id, bag.label, term, value * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w
  FROM bag JOIN sp USING (doc_id) JOIN dfs USING (split, term) JOIN ns USING (split)),
feat AS MATERIALIZED (SELECT 0 AS kind, split, role, bag.doc_id, bag.label, term, value FROM bag JOIN sp USING (doc_id)
  UNION ALL SELECT 1, split, role, doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY split, doc_id)) FROM wraw),
folds AS MATERIALIZED (SELECT split, doc_id, label, ntile(5) OVER (PARTITION BY split, label ORDER BY doc_id) - 1 AS own FROM sp WHERE role = 'train'),
kinds AS (SELECT * FROM (VALUES (0), (1)) AS v(kind)),
m AS MATERIALIZED (SELECT kind * 100 + split * 10 + k AS fold, doc_id, feat.label, term, CASE WHEN own = k THEN 0.0::DOUBLE ELSE value END AS value
    FROM feat JOIN folds USING (split, doc_id) CROSS JOIN range(5) r(k)
  UNION ALL SELECT kind * 100 + split * 10 + 9, doc_id, label, term, value FROM feat WHERE role = 'train'),
td AS (SELECT kind * 100 + split * 10 + k AS fold, doc_id, label FROM folds CROSS JOIN kinds CROSS JOIN range(5) r(k) WHERE own <> k
  UNION ALL SELECT kind * 100 + split * 10 + 9, doc_id, label FROM sp CROSS JOIN kinds WHERE role = 'train'),
x AS (SELECT kind * 100 + split * 10 + own AS fold, feat.doc_id, feat.label, term, value FROM feat JOIN folds USING (split, doc_id)
  UNION ALL SELECT kind * 100 + split * 10 + 9, doc_id, label, term, value FROM feat WHERE role = 'test'),
xd AS (SELECT kind * 100 + split * 10 + own AS fold, doc_id, label FROM folds CROSS JOIN kinds
  UNION ALL SELECT kind * 100 + split * 10 + 9, doc_id, label FROM sp CROSS JOIN kinds WHERE role = 'test')"""
VIEW_BAG = """SELECT doc_id, label, term, count(*)::DOUBLE AS value FROM (
  SELECT doc_id, label, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM views WHERE data_type = '{0}'
) GROUP BY doc_id, label, term"""


def _bayes_report_sql(data_type: str, text: str = "text") -> str:
    models = ALL_MODELS.replace(BAG, VIEW_BAG.format(data_type).replace("lower(text)", f"lower({text})"))
    return f"""WITH {PREP}, {VIEWS}, {models}, {bayes_sql('m', 'td', 'x', 'xd')},
runs AS MATERIALIZED (SELECT *, fold // 100 AS kind, (fold % 100) // 10 AS split, fold % 10 AS k FROM ({f1_sql('chosen', 'fold, point')})),
cv AS (SELECT kind, split, point, avg(f1) AS cv_f1 FROM runs WHERE k < 9 GROUP BY kind, split, point),
best AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY kind, split ORDER BY round(cv_f1, 12) DESC, point) = 1),
tested AS (SELECT runs.* FROM runs JOIN best USING (kind, split, point) WHERE k = 9),
params AS (SELECT kind, point FROM tested QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(f1, 12) DESC, split) = 1)
SELECT 'bayes' AS model_type, CASE kind WHEN 0 THEN 'bow' ELSE 'tfidf' END AS feature_type, '{data_type}' AS data_type,
  round_even(round(max(f1) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS best_f1, round_even(round(avg(f1) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_f1, round_even(round(max(accuracy) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS best_accuracy, round_even(round(avg(accuracy) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_accuracy,
  '{{''alpha'': ' || any_value(CASE params.point WHEN 0 THEN '0.1' WHEN 1 THEN '1.0' ELSE '10.0' END) || '}}' AS best_params
FROM tested JOIN params USING (kind) GROUP BY kind"""


FRAME_REPORT = " UNION ALL ".join(f"SELECT * FROM ({_bayes_report_sql(kind, FRAME_TEXT)})" for kind in FRAME_VIEWS)
BAYES_REPORT = " UNION ALL ".join(f"SELECT * FROM ({_bayes_report_sql(kind)})" for kind in corpus.DATA_TYPES)


def knn_sql(weights: str, distance: str, k: int) -> str:
    return f"""{TFIDF}, tr AS ({weights.format('train')}), te AS ({weights.format('test')}),
trs AS (SELECT sp.doc_id, any_value(sp.label) AS label, coalesce(sum(value), 0) AS s1, coalesce(sum(value * value), 0) AS s2
  FROM split sp LEFT JOIN tr USING (doc_id) WHERE sp.role = 'train' GROUP BY sp.doc_id),
tes AS (SELECT sp.doc_id, coalesce(sum(value), 0) AS s1, coalesce(sum(value * value), 0) AS s2
  FROM split sp LEFT JOIN te USING (doc_id) WHERE sp.role = 'test' GROUP BY sp.doc_id),
ov AS (SELECT te.doc_id AS test_key, tr.doc_id AS train_key, sum(te.value * tr.value) AS dotp, sum(least(te.value, tr.value)) AS mins
       FROM te JOIN tr USING (term) GROUP BY te.doc_id, tr.doc_id),
near AS MATERIALIZED (SELECT tes.doc_id AS test_key, trs.doc_id AS train_key, trs.label AS y_train, {distance} AS dist
       FROM tes CROSS JOIN trs LEFT JOIN ov ON ov.test_key = tes.doc_id AND ov.train_key = trs.doc_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY test_key ORDER BY dist, train_key) AS rank FROM near QUALIFY rank <= {k})"""


KNN_GRID = f"""WITH {FOLDS},
sq AS MATERIALIZED (SELECT f.doc_id, any_value(f.label) AS label, any_value(own) AS own, coalesce(sum(value), 0) AS s1,
  coalesce(sum(value * value), 0) AS s2 FROM folds f LEFT JOIN train t ON t.doc_id = f.doc_id GROUP BY f.doc_id),
ov AS (SELECT a.doc_id AS ka, b.doc_id AS kb, sum(a.value * b.value) AS dotp, sum(least(a.value, b.value)) AS mins
  FROM train a JOIN train b USING (term) GROUP BY a.doc_id, b.doc_id),
near AS MATERIALIZED (SELECT x.doc_id AS test_key, x.own, x.label AS y, z.doc_id AS train_key, z.label AS y_train, metric,
  CASE metric WHEN 'euclidean' THEN round(sqrt(round(greatest(x.s2 + z.s2 - 2.0::DOUBLE * coalesce(dotp, 0), 0), 9)), 9)
              ELSE round(greatest(x.s1 + z.s1 - 2.0::DOUBLE * coalesce(mins, 0), 0), 9) END AS dist
  FROM sq x JOIN sq z ON z.own <> x.own CROSS JOIN (VALUES ('euclidean'), ('manhattan')) AS g(metric)
  LEFT JOIN ov ON ov.ka = x.doc_id AND ov.kb = z.doc_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY metric, test_key ORDER BY dist, train_key) AS rank FROM near QUALIFY rank <= 20),
low AS (SELECT metric, test_key, min(dist) AS lo FROM ranked GROUP BY metric, test_key),
grid AS (SELECT * FROM (VALUES (1), (2), (4), (8), (12), (15), (17), (20)) AS g(k) CROSS JOIN (VALUES ('uniform'), ('distance')) AS w(weights)),
sums AS (SELECT metric, test_key, own, y, k, weights, y_train, sum(CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE WHEN lo = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1.0::DOUBLE / dist END) AS s
  FROM ranked JOIN low USING (metric, test_key) JOIN grid ON rank <= k GROUP BY metric, test_key, own, y, k, weights, y_train),
answers AS (SELECT metric, k, weights, own, y, y_train AS yhat FROM sums
  QUALIFY row_number() OVER (PARTITION BY metric, test_key, k, weights ORDER BY round(s, 9) DESC, y_train) = 1)
SELECT metric, k::BIGINT AS n_neighbors, weights, round(avg(f1), 6) AS cv_f1 FROM ({f1_sql('answers', 'metric, k, weights, own')}) GROUP BY metric, k, weights"""


def _knn_report_sql(data_type: str) -> str:
    """Brute force: distances of all pairs of a problem (feature kind and split); test documents have own = -1."""
    return f"""WITH {PREP}, {VIEWS}, bag AS MATERIALIZED ({VIEW_BAG.format(data_type)}), sp AS MATERIALIZED ({split_sql(5)}),
dfs AS (SELECT split, term, count(*) AS df FROM bag JOIN sp USING (doc_id) WHERE role = 'train' GROUP BY split, term),
ns AS (SELECT split, count(*) AS n FROM sp WHERE role = 'train' GROUP BY split),
raw AS (SELECT split, doc_id, term, value, value * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w
  FROM bag JOIN sp USING (doc_id) JOIN dfs USING (split, term) JOIN ns USING (split)),
owned AS (SELECT split, doc_id, label, ntile(5) OVER (PARTITION BY split, label ORDER BY doc_id) - 1 AS own FROM sp WHERE role = 'train'
  UNION ALL SELECT split, doc_id, label, -1 FROM sp WHERE role = 'test'),
docs AS MATERIALIZED (SELECT kind * 10 + split AS g, doc_id, label, own FROM owned CROSS JOIN (VALUES (0), (1)) AS v(kind)),
feat AS MATERIALIZED (SELECT split AS g, doc_id, term, value FROM raw
  UNION ALL SELECT 10 + split, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY split, doc_id)) FROM raw),
sq AS MATERIALIZED (SELECT d.g, d.doc_id, any_value(label) AS label, any_value(own) AS own, coalesce(sum(value), 0) AS s1,
  coalesce(sum(value * value), 0) AS s2 FROM docs d LEFT JOIN feat ON feat.g = d.g AND feat.doc_id = d.doc_id GROUP BY d.g, d.doc_id),
ov AS (SELECT a.g, a.doc_id AS ka, b.doc_id AS kb, sum(a.value * b.value) AS dotp, sum(least(a.value, b.value)) AS mins
  FROM feat a JOIN feat b ON a.g = b.g AND a.term = b.term GROUP BY a.g, a.doc_id, b.doc_id),
near AS (SELECT x.g, x.doc_id AS test_key, x.own, x.label AS y, z.doc_id AS train_key, z.label AS y_train, metric,
  CASE metric WHEN 'euclidean' THEN round(sqrt(round(greatest(x.s2 + z.s2 - 2.0::DOUBLE * coalesce(dotp, 0), 0), 9)), 9)
              ELSE round(greatest(x.s1 + z.s1 - 2.0::DOUBLE * coalesce(mins, 0), 0), 9) END AS dist
  FROM sq x JOIN sq z ON z.g = x.g AND z.own >= 0 AND z.own <> x.own CROSS JOIN (VALUES ('euclidean'), ('manhattan')) AS v(metric)
  LEFT JOIN ov ON ov.g = x.g AND ov.ka = x.doc_id AND ov.kb = z.doc_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, metric, test_key ORDER BY dist, train_key) AS rank FROM near QUALIFY rank <= 20),
low AS (SELECT g, metric, test_key, min(dist) AS lo FROM ranked GROUP BY g, metric, test_key),
points AS (SELECT row_number() OVER (ORDER BY metric, k, w) - 1 AS point, metric, k, weights FROM (VALUES ('euclidean'), ('manhattan')) AS a(metric)
  CROSS JOIN (VALUES (1), (2), (4), (8), (12), (15), (17), (20)) AS b(k) CROSS JOIN (VALUES (0, 'uniform'), (1, 'distance')) AS c(w, weights)),
sums AS (SELECT g, point, test_key, own, y, y_train,
  sum(CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE WHEN lo = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1.0::DOUBLE / dist END) AS s
  FROM ranked JOIN low USING (g, metric, test_key) JOIN points USING (metric) WHERE rank <= k GROUP BY g, point, test_key, own, y, y_train),
answers AS (SELECT g, point, own, y, y_train AS yhat FROM sums
  QUALIFY row_number() OVER (PARTITION BY g, point, test_key ORDER BY round(s, 9) DESC, y_train) = 1),
runs AS MATERIALIZED (SELECT *, g // 10 AS kind, g % 10 AS split FROM ({f1_sql('answers', 'g, point, own')})),
cv AS (SELECT g, point, avg(f1) AS cv_f1 FROM runs WHERE own >= 0 GROUP BY g, point),
best AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(cv_f1, 12) DESC, point) = 1),
tested AS (SELECT runs.* FROM runs JOIN best USING (g, point) WHERE own = -1),
params AS (SELECT kind, format('{{{{''algorithm'': ''brute'', ''metric'': ''{{}}'', ''n_neighbors'': {{}}, ''weights'': ''{{}}''}}}}', metric, k, weights) AS shown
  FROM tested JOIN points USING (point) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(f1, 12) DESC, split) = 1)
SELECT 'knn' AS model_type, CASE kind WHEN 0 THEN 'bow' ELSE 'tfidf' END AS feature_type, '{data_type}' AS data_type,
  round_even(round(max(f1) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS best_f1, round_even(round(avg(f1) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_f1,
  round_even(round(max(accuracy) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS best_accuracy, round_even(round(avg(accuracy) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_accuracy,
  any_value(shown) AS best_params
FROM tested JOIN params USING (kind) GROUP BY kind"""


KNN_REPORT = " UNION ALL ".join(f"SELECT * FROM ({_knn_report_sql(kind)})" for kind in corpus.DATA_TYPES)


_EUCLID = "round(sqrt(round(greatest(trs.s2 + tes.s2 - 2.0::DOUBLE * coalesce(dotp, 0), 0), 9)), 9)"
_MANHATTAN = "round(greatest(trs.s1 + tes.s1 - 2.0::DOUBLE * coalesce(mins, 0), 0), 9)"
_WEIGHTS = "SELECT doc_id, label, term, value FROM weights WHERE role = '{0}'"
_COUNTS = "SELECT c.doc_id, c.label, c.term, c.value FROM {0} c SEMI JOIN idf USING (term)"
LABELLED = """SELECT doc_id, source, lang, quality::VARCHAR AS y, (1 - toxic)::VARCHAR AS yhat FROM labels JOIN documents USING (doc_id)"""
HISTORY = "SELECT user_id AS run, event_type AS split, value AS val_loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch FROM events"
PEAKS = f"SELECT run, max(p) AS best_val_loss, round_even(round(avg(p) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_val_loss FROM (SELECT run, split, max(val_loss) AS p FROM ({HISTORY}) GROUP BY run, split) GROUP BY run"
SPLIT_METRICS = f"SELECT lang, split, f1, accuracy FROM ({f1_sql('(SELECT *, regexp_extract(source, ' + repr(chr(92) + 'd+$').replace(chr(92) * 2, chr(92)) + ')::BIGINT AS split FROM (' + LABELLED + '))', 'lang, split')})"
PER_LABEL = f"""cells AS (SELECT lang, y AS label, (y = yhat)::INT AS tp, 1 AS t, 0 AS p FROM ({LABELLED})
  UNION ALL SELECT lang, yhat, 0, 0, 1 FROM ({LABELLED})),
pl AS (SELECT lang, label, sum(t)::BIGINT AS support, sum(tp)::DOUBLE AS tp,
  CASE WHEN sum(p) > 0 THEN sum(tp)::DOUBLE / sum(p) ELSE 0 END AS precision,
  CASE WHEN sum(t) > 0 THEN sum(tp)::DOUBLE / sum(t) ELSE 0 END AS recall,
  2.0::DOUBLE * sum(tp) / (sum(t) + sum(p)) AS f1 FROM cells GROUP BY lang, label)"""

QUERIES = {
    "naive_bayes": naive_bayes,
    "grid_search": grid_search,
    "bayes_report": bayes_report,
    "frame_report": frame_report,
    "knn_euclid": knn_euclid,
    "knn_manhattan": knn_manhattan,
    "knn_vote": knn_vote,
    "knn_grid": knn_grid,
    "contrastive_pairs": contrastive_pairs,
    "linear_svm": linear_svm,
    "svm_report": svm_report,
    "knn_report": knn_report,
    "mlp": mlp,
    "logreg_head": logreg_head,
    "head_report": head_report,
    "chunk_report": chunk_report,
    "few_shot_report": few_shot_report,
    "word2vec_doc": word2vec_doc,
    "paragraph_vectors": paragraph_vectors,
    "confusion": confusion,
    "accuracy_f1": accuracy_f1,
    "class_report": class_report,
    "run_summary": run_summary,
    "best_params": best_params,
    "prediction_table": prediction_table,
    "early_stop": early_stop,
    "best_epoch": best_epoch,
    "history_summary": history_summary,
    "leaderboard": leaderboard,
}

ORACLE = {
    "naive_bayes": f"WITH {ONE_MODEL}, {bayes_sql('m', 'td', 'x', 'xd')} SELECT doc_id, alpha, s.y, s.label, round(score, 5) AS score, yhat FROM scores s JOIN chosen USING (doc_id, alpha)",
    "grid_search": f"""WITH {FOLDS}, {bayes_sql('m', 'td', 'x', 'xd')},
cv AS (SELECT point, avg(f1) AS cv_f1 FROM ({f1_sql('chosen', 'point, fold')}) GROUP BY point)
SELECT point::BIGINT AS point, round(cv_f1, 6) AS cv_f1, row_number() OVER (ORDER BY round(cv_f1, 12) DESC, point) = 1 AS best FROM cv""",
    "bayes_report": BAYES_REPORT,
    "frame_report": FRAME_REPORT,
    "knn_euclid": f"WITH {knn_sql(_WEIGHTS, _EUCLID, 8)} SELECT test_key, rank, train_key, y_train, round(dist, 6) AS dist FROM ranked",
    "knn_manhattan": f"WITH {knn_sql(_COUNTS, _MANHATTAN, 8)} SELECT test_key, rank, train_key, y_train, round(dist, 6) AS dist FROM ranked",
    "knn_vote": f"""WITH {knn_sql(_WEIGHTS, _EUCLID, 20)},
grid AS (SELECT * FROM (VALUES (1), (2), (4), (8), (12), (15), (17), (20)) AS g(k) CROSS JOIN (VALUES ('uniform'), ('distance')) AS w(weights)),
low AS (SELECT test_key, min(dist) AS lo FROM ranked GROUP BY test_key),
sums AS (SELECT test_key, k, weights, y_train, sum(CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE WHEN lo = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1.0::DOUBLE / dist END) AS s
  FROM ranked JOIN low USING (test_key) JOIN grid ON rank <= k GROUP BY test_key, k, weights, y_train)
SELECT test_key, k::BIGINT AS k, weights, y_train AS yhat FROM sums
QUALIFY row_number() OVER (PARTITION BY test_key, k, weights ORDER BY round(s, 9) DESC, y_train) = 1""",
    "knn_grid": KNN_GRID,
    "knn_report": KNN_REPORT,
    "contrastive_pairs": """
WITH base AS (SELECT doc_id, quality::VARCHAR AS label, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS place,
  count(*) OVER (PARTITION BY quality) AS size FROM labels),
names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx, count(*) OVER () AS n, size FROM (SELECT DISTINCT label, size FROM base)),
asks AS (SELECT b.*, r.round, s.alike, ('0x' || substr(md5(concat_ws('|', doc_id, r.round, s.alike, 42)), 1, 8))::BIGINT AS draw
  FROM base b CROSS JOIN range(15) r(round) CROSS JOIN (VALUES (1), (0)) s(alike)),
aim AS (SELECT a.*, CASE WHEN alike = 1 THEN a.label ELSE o.label END AS want,
  CASE WHEN alike = 1 THEN (place + 1 + draw % greatest(a.size - 1, 1)) % a.size ELSE draw % o.size END AS spot
  FROM asks a JOIN names m ON m.label = a.label JOIN names o ON o.idx = (m.idx + 1 + draw % greatest(m.n - 1, 1)) % m.n
  WHERE (alike = 1 AND a.size > 1) OR (alike = 0 AND m.n > 1))
SELECT aim.doc_id AS anchor, b.doc_id AS partner, round, alike::BIGINT AS "similar" FROM aim JOIN base b ON b.label = want AND b.place = spot""",
    "confusion": f"SELECT lang, y, yhat, count(*) AS n FROM ({LABELLED}) GROUP BY lang, y, yhat",
    "accuracy_f1": f"SELECT source, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM ({f1_sql('(' + LABELLED + ')', 'source')})",
    "class_report": f"""WITH {PER_LABEL},
total AS (SELECT lang, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
  sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM pl GROUP BY lang)
SELECT lang, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pl
UNION ALL SELECT lang, 'accuracy', NULL, NULL, round(acc, 6), n FROM total
UNION ALL SELECT lang, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM total
UNION ALL SELECT lang, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM total""",
    "run_summary": f"""SELECT lang, round_even(round(max(f1) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS best_f1, round_even(round(avg(f1) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_f1, round_even(round(max(accuracy) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS best_accuracy,
  round_even(round(avg(accuracy) * 100.0::DOUBLE, 9), 0) / 100.0::DOUBLE AS avg_accuracy FROM ({SPLIT_METRICS}) GROUP BY lang""",
    "best_params": f"SELECT lang, split AS best_params FROM ({SPLIT_METRICS}) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(f1, 12) DESC, split) = 1",
    "prediction_table": f"""SELECT text AS original_text, yhat AS predicted_label, y AS original_label, 'Research Design: ' || yhat AS predicted_text
FROM ({LABELLED}) JOIN documents USING (doc_id)""",
    "early_stop": f"""
WITH h AS ({HISTORY}), b AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM h),
i AS (SELECT *, max(CASE WHEN low IS NULL OR val_loss < low THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b)
SELECT run, min(CASE WHEN epoch - last > {PATIENCE} THEN epoch END) AS stop_epoch FROM i GROUP BY run""",
    "best_epoch": f"SELECT run, epoch + 1 AS best_epoch FROM ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_loss DESC, epoch) = 1",
    "history_summary": PEAKS,
    "leaderboard": f"SELECT run, avg_val_loss FROM ({PEAKS}) ORDER BY avg_val_loss DESC, run LIMIT 1",
}
