"""Experiment reports: configuration axes x data types, as unions of lazily planned runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import corpus, features, foldbayes, learners, metrics, scoring, search, splits
from corpuslab.plans.scale import cut_lineage

DICTIONARY_CONFIGS = {"uni": ["uni"], "uni-bi": ["uni", "bi"]}


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dictionary_predictions(
    views: DataFrame, key: str, class_profiles: DataFrame, names: Sequence[str],
    configs: Mapping[str, Sequence[str]] = DICTIONARY_CONFIGS, placed: bool = False,
) -> DataFrame:
    """(model_type, data_type, key, y, yhat) for text views (key, data_type, text, label). All views go
    through one plan; with ``placed`` their rows are already together by key."""
    keep = ["data_type", "y"]
    profile = features.ngram_profile(
        views.withColumnRenamed("label", "y"), key, "text", scoring.profile_limits(configs), keep, placed)
    scored = scoring.dictionary_scores(profile, key, class_profiles, names, configs, keep)
    answers = scoring.predict_lowest(scored, [key, *keep, "config"], names)
    return answers.select(F.col("config").alias("model_type"), "data_type", key, "y", "yhat")


def score_report(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., f1_score, accuracy)."""
    return metrics.accuracy_f1(predictions, by).select(*by, F.col("f1").alias("f1_score"), "accuracy")


def bayes_split_metrics(
    views: DataFrame, key: str, names: Sequence[str], data_types: Sequence[str], kinds: Sequence[str] = ("bow",),
    n_splits: int = 5, folds: int = 5,
) -> DataFrame:
    """(feature_type, data_type, split, point, f1, accuracy): per view and split the grid is searched on
    stratified folds of the training side and the chosen smoothing is tested.

    views: (key, data_type, text, label), a row per document and view. Term counts are taken once for all
    splits and feature kinds; a document is one row per view whatever the number of splits, and the splits are those of
    the documents.
    """
    unknown = set(kinds) - {"bow", "tfidf"}
    if unknown:
        raise ValueError(f"unknown feature kinds {sorted(unknown)}")
    by = ["feature_type", "data_type", "split"]
    alphas = search.GRIDS["bayes"]["alpha"]
    docs = views.filter(F.col("data_type") == data_types[0]).select(key, "label")
    roles = cut_lineage(splits.stratified_splits(docs, key, "label", n_splits).select(key, "label", "split", "role"))
    folded = folds_by_split(roles.filter("role = 'train'").drop("role"), key, folds)
    tests = roles.filter("role = 'test'").drop("role").withColumn("fold", F.lit(-1))
    counts = features.bag_of_words(views, key, "text", ["data_type"])
    rows = foldbayes.document_rows(counts, folded.unionByName(tests), key, data_types, n_splits)
    answers = foldbayes.split_answers(rows, names, alphas, kinds, n_splits, folds)
    chosen = search.best_point(search.fold_scores(answers.filter("fold >= 0"), by), by)
    tested = answers.filter("fold = -1").join(F.broadcast(chosen.select(*by, "point")), [*by, "point"])  # a row per view and split
    return metrics.accuracy_f1(tested, [*by, "point"])


def folds_by_split(train_docs: DataFrame, key: str, folds: int) -> DataFrame:
    """Stratified folds inside each split (a split and class together form the stratum)."""
    stratum = F.concat_ws("|", F.col("split").cast("string"), "label")
    return splits.stratified_folds(
        train_docs.withColumn("_stratum", stratum), "_stratum", key, folds
    ).drop("_stratum")


def tfidf_by(
    train: DataFrame, test: DataFrame, docs: DataFrame, key: str, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """TF-IDF with the document frequencies of each view and split."""
    sizes = docs.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    frequency = train.groupBy(*by, "term").agg(F.count("*").alias("df"))
    idf = frequency.join(F.broadcast(sizes), list(by)).select(  # sizes: a row per view and split
        *by, "term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")
    )
    return features.weigh(train, idf, key, by), features.weigh(test, idf, key, by)


def bayes_report(
    views: DataFrame, key: str, names: Sequence[str], data_types: Sequence[str], kinds: Sequence[str] = ("tfidf", "bow")
) -> DataFrame:
    """(model_type, feature_type, data_type, best and mean scores, best_params)."""
    alphas = search.GRIDS["bayes"]["alpha"]
    by = ["feature_type", "data_type"]
    all_runs = cut_lineage(bayes_split_metrics(views, key, names, data_types, kinds))
    best = metrics.best_params(all_runs, by, "point").withColumn(
        "best_params", F.format_string("{'alpha': %s}", corpus.decode_label(F.col("best_params"), [str(a) for a in alphas]))
    )
    return metrics.run_summary(all_runs, by).join(best, by).select(
        F.lit("bayes").alias("model_type"), *by, "best_f1", "avg_f1", "best_accuracy", "avg_accuracy", "best_params"
    )


def learner_report(
    rows: DataFrame, key: str, make: Callable[[dict], Estimator], grid: Sequence[dict], model_type: str,
    n_splits: int = 5, folds: int = 5,
) -> DataFrame:
    """(model_type, best and mean scores, best_params) of a Spark ML learner over stratified splits: on
    each training side the grid is searched by mean fold macro F1, and the chosen point is tested.

    rows: (key, features, label index). ``make`` builds the learner of a grid point. Splits, folds and
    grid points are parameters, so the loops do not grow with the data.
    """
    roles = cut_lineage(splits.stratified_splits(rows, key, "label", n_splits))
    runs = []
    for split in range(n_splits):
        train, test = (roles.filter((F.col("split") == split) & (F.col("role") == r)).drop("role", "split") for r in ("train", "test"))
        folded = cut_lineage(splits.stratified_folds(train, "label", key, folds))
        answers = search.cross_validate([make(p) for p in grid], folded, key)
        chosen = search.best_point(search.fold_scores(answers, [])).first().point
        tested = learners.fit_predict(make(grid[chosen]), train, test, key)
        runs.append(tested.select(
            F.lit(model_type).alias("model_type"), F.lit(split).alias("split"), F.lit(chosen).alias("point"), "y", "yhat"))
    scored = cut_lineage(metrics.accuracy_f1(union_all(runs), ["model_type", "split", "point"]))
    best = metrics.best_params(scored, ["model_type"], "point").withColumn(
        "best_params", corpus.decode_label(F.col("best_params"), [str(p) for p in grid]))
    return metrics.run_summary(scored, ["model_type"]).join(best, ["model_type"]).select(
        "model_type", "best_f1", "avg_f1", "best_accuracy", "avg_accuracy", "best_params")


def similarity_report(chunks: DataFrame, truth: DataFrame, key: str, labels: Column, names: Sequence[str]) -> DataFrame:
    """(embed_type, f1_score, accuracy) for chunked and averaged documents; truth: (key, y)."""
    answers = union_all([
        scoring.similarity_first_chunk(chunks, key, labels, names).withColumn("embed_type", F.lit("chunked")),
        scoring.similarity_mean(chunks, key, labels, names).withColumn("embed_type", F.lit("avg")),
    ])
    return score_report(answers.join(truth, key), ["embed_type"])


def decision_report(decisions: Mapping[str, DataFrame], truth: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(experiment_type, f1_score, accuracy) of document decisions (key, yhat); documents
    without a decision leave the evaluation. truth: (key, y) per experiment."""
    answers = union_all([
        decided.join(truth[name], key).select(F.lit(name).alias("experiment_type"), "y", "yhat")
        for name, decided in decisions.items()
    ])
    return score_report(answers, ["experiment_type"])
