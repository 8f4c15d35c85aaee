"""Feature, split and dictionary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import standins as st
from corpuslab.catalog.corpus_queries import PREP, VIEWS
from corpuslab.catalog.text_queries import WORDS
from corpuslab.operators import corpus, embeddings, experiments, features, scoring, splits
from corpuslab.plans.scale import global_rank


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = st.first_split(spark, sf_dir)
    return features.vocabulary(features.bag_of_words(train, "doc_id", "text"))


def bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.bag_of_words(st.documents(spark, sf_dir), "doc_id", "text", ["label"])


def oov_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = st.first_split(spark, sf_dir)
    return features.fit_features(train, test, "doc_id", "text", "bow")[1]


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = st.first_split(spark, sf_dir)
    fitted = features.fit_features(train, test, "doc_id", "text", "tfidf")
    parts = [p.withColumn("role", F.lit(r)) for p, r in zip(fitted, ("train", "test"))]
    return parts[0].unionByName(parts[1]).withColumn("value", F.round("value", 6))


def ngram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.ngram_profile(st.documents(spark, sf_dir), "doc_id", "text")
    return rows.filter("ngram is not null").select(
        "doc_id", F.col("n").cast("long").alias("n"), "ngram", "cnt", F.round("weight", 9).alias("weight")
    )


def _lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.documents(spark, sf_dir).withColumn("text", F.lower("text"))


DICT_LIMITS = scoring.profile_limits(experiments.DICTIONARY_CONFIGS)


def _class_profiles(spark: SparkSession, sf_dir: str, limits=DICT_LIMITS) -> DataFrame:
    return features.class_profile(_lowered(spark, sf_dir), "label", "doc_id", "text", limits)


def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_profiles(spark, sf_dir, features.PROFILE_LIMITS).select(
        "label", F.col("n").cast("long").alias("n"), "ngram", "cnt", F.round("weight", 9).alias("weight")
    )


def _dict_scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    docs = _lowered(spark, sf_dir)
    names = corpus.label_names(docs)
    scored = scoring.dictionary_scores(
        features.ngram_profile(docs, "doc_id", "text", DICT_LIMITS), "doc_id", _class_profiles(spark, sf_dir), names,
        experiments.DICTIONARY_CONFIGS,
    )
    return scored, names


def dict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, names = _dict_scored(spark, sf_dir)
    return scoring.score_rows(scored, ["doc_id", "config"], names).select(
        "doc_id", "config", "label", F.round("score", 9).alias("score")
    )


def dict_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, names = _dict_scored(spark, sf_dir)
    return scoring.predict_lowest(scored, ["doc_id", "config"], names)


def dict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.documents(spark, sf_dir)
    names = corpus.label_names(docs)
    prepared = st.prepared(spark, sf_dir, placed=True)
    views = corpus.view_rows(prepared, "doc_id", keywords=st.SECTION_KEYWORDS)
    answers = experiments.dictionary_predictions(views, "doc_id", _class_profiles(spark, sf_dir), names, placed=True)
    report = experiments.score_report(answers, ["model_type", "data_type"])
    return report.select("model_type", "data_type", F.round("f1_score", 6).alias("f1_score"), F.round("accuracy", 6).alias("accuracy"))


def _long(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    return rows.select(key, F.posexplode(vec).alias("dim", "value")).select(
        key, F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value")
    )


def mean_word_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is the vector of a word: the words by falling document count, ties by word."""
    counts = st.word_rows(spark, sf_dir).groupBy("word").agg(F.count("*").alias("df"))
    ranked = global_rank(counts.withColumn("_fall", -F.col("df")), ["_fall", "word"], name="vec_id")
    vectors = st.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    known = ranked.join(vectors, "vec_id").select("word", "vec")
    return _long(embeddings.mean_word_vectors(_lowered(spark, sf_dir), "doc_id", "text", known, 64), "doc_id")


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(embeddings.mean_pool(st.chunk_vectors(spark, sf_dir), ["doc_id"]), "doc_id")


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(embeddings.mean_pool(st.chunk_vectors(spark, sf_dir), ["label"]), "label")


def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part features: a title vector under the part's number, a journal vector under its size."""
    return embeddings.mean_features(
        st.item_metadata(spark, sf_dir), item_vectors(spark, sf_dir), "id", 64
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = st.table(spark, sf_dir, "part")
    vectors = st.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    made = [
        parts.select(F.col("p_partkey").alias("id"), F.col(c).cast("long").alias("vec_id"), F.lit(f).alias("feature"))
        for c, f in (("p_partkey", "articletitle"), ("p_size", "journaltitle"))
    ]
    return made[0].unionByName(made[1]).join(vectors, "vec_id").select("id", "feature", "vec")


def mean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(node_embeddings(spark, sf_dir), "id")


def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.category_index(category_dictionary(spark, sf_dir))


def category_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.category_values(st.item_metadata(spark, sf_dir), ["publisher", "type"], ["subject"])


def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings.multi_hot(
        st.item_metadata(spark, sf_dir), "id", ["publisher", "type"], ["subject"], category_index(spark, sf_dir))
    return rows.select("id", F.explode("cat").alias("idx"))


def strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.documents(spark, sf_dir).select("doc_id", "label")
    rows = splits.stratified_splits(docs, "doc_id", "label")
    return rows.withColumn("split", F.col("split").cast("long"))


def strat_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way_split(st.documents(spark, sf_dir).select("doc_id", "label"), "doc_id", "label")


def strat_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.documents(spark, sf_dir).select("doc_id", "label")
    return splits.stratified_folds(docs, "label", "doc_id").withColumn("fold", F.col("fold").cast("long"))


BAG = """SELECT doc_id, label, term, count(*)::DOUBLE AS value FROM (
  SELECT doc_id, lang AS label, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents
) GROUP BY doc_id, label, term"""


def split_sql(n: int) -> str:
    return f"""SELECT doc_id, lang AS label, s AS split, CASE WHEN row_number() OVER (PARTITION BY s, lang
  ORDER BY md5(concat_ws('|', doc_id, s, 42)), doc_id) <= round(0.2 * count(*) OVER (PARTITION BY s, lang))
  THEN 'test' ELSE 'train' END AS role FROM documents, range({n}) AS r(s)"""


TFIDF = f"""bag AS MATERIALIZED ({BAG}), split AS MATERIALIZED ({split_sql(1)}),
train AS (SELECT bag.* FROM bag JOIN split USING (doc_id) WHERE role = 'train'),
test AS (SELECT bag.* FROM bag JOIN split USING (doc_id) WHERE role = 'test'),
idf AS MATERIALIZED (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM split WHERE role = 'train')) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
        FROM train GROUP BY term),
raw AS (SELECT doc_id, label, term, value * idf AS w, 'train' AS role FROM train JOIN idf USING (term)
        UNION ALL SELECT doc_id, label, term, value * idf, 'test' FROM test JOIN idf USING (term)),
weights AS MATERIALIZED (SELECT doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value, role FROM raw)"""


def profile_sql(texts: str, keys: str, seq: str) -> str:
    """Top n-grams per ``keys`` from ``texts`` with doc_id and text columns."""
    carried = keys if "doc_id" in keys else f"{keys}, doc_id"
    return f"""(
WITH w AS (SELECT {carried}, unnest({WORDS.format('text')}) AS word,
           generate_subscripts({WORDS.format('text')}, 1) AS pos FROM {texts}),
nx AS (SELECT *, lead(word) OVER (PARTITION BY {keys}, doc_id ORDER BY pos) AS w2,
       lead(word, 2) OVER (PARTITION BY {keys}, doc_id ORDER BY pos) AS w3 FROM w),
g AS (SELECT {keys}, 1 AS n, word AS ngram, {seq} AS o FROM nx
      UNION ALL SELECT {keys}, 2, word || ' ' || w2, {seq} FROM nx WHERE w2 IS NOT NULL
      UNION ALL SELECT {keys}, 3, word || ' ' || w2 || ' ' || w3, {seq} FROM nx WHERE w3 IS NOT NULL),
c AS (SELECT {keys}, n, ngram, count(*) AS cnt, min(o) AS first FROM g GROUP BY {keys}, n, ngram),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {keys}, n ORDER BY cnt DESC, first) <= CASE n WHEN 1 THEN 100 ELSE 30 END)
SELECT {keys}, n::BIGINT AS n, ngram, cnt, cnt / sum(cnt) OVER (PARTITION BY {keys}, n) AS weight FROM k)"""


LOWERED = "(SELECT doc_id, lang AS label, lower(text) AS text FROM documents)"
CLASS_PROFILE = profile_sql(LOWERED, "label", "doc_id * 1000000 + pos")
DOC_PROFILE = profile_sql(LOWERED, "doc_id", "pos")


def _scores_sql(keys: str) -> str:
    on = " AND ".join(f"b.{k} = m.{k}" for k in keys.split(", "))
    cols = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""scores AS (
SELECT {cols}, f.config, l.label, coalesce(sum(m.s), 0) AS score
FROM base b CROSS JOIN (VALUES ('uni', 1), ('uni-bi', 2)) AS f(config, top)
CROSS JOIN (SELECT DISTINCT lang AS label FROM documents) l
LEFT JOIN (SELECT p.*, c.label, p.weight * c.weight AS s FROM profile p JOIN class_profile c USING (n, ngram)) m
  ON {on} AND m.label = l.label AND m.n <= f.top
GROUP BY {cols}, f.config, l.label)"""


DICT = f"""class_profile AS MATERIALIZED (SELECT * FROM {CLASS_PROFILE}),
profile AS MATERIALIZED (SELECT * FROM {DOC_PROFILE}), base AS (SELECT doc_id FROM documents), {_scores_sql('doc_id')}"""
LOWEST = "SELECT {0}, label AS yhat FROM scores QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY round(score, 12) DESC, label) = 1"
VIEW_PROFILE = profile_sql("views", "data_type, doc_id", "pos")
REPORT = f"""WITH {PREP}, {VIEWS}, class_profile AS MATERIALIZED (SELECT * FROM {CLASS_PROFILE}),
profile AS MATERIALIZED (SELECT * FROM {VIEW_PROFILE}), base AS (SELECT doc_id, data_type FROM views), {_scores_sql('data_type, doc_id')},
answers AS (SELECT data_type, doc_id, config AS model_type, yhat, lang AS y FROM ({LOWEST.format('data_type, doc_id, config')}) JOIN documents USING (doc_id))"""


def f1_sql(source: str, by: str) -> str:
    """(by, accuracy, f1) from predictions (by, y, yhat)."""
    return f"""
SELECT {by}, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + pred > 0 THEN 2.0 * tp / (support + pred) ELSE 0 END) AS f1 FROM (
  SELECT {by}, label, sum(tp)::DOUBLE AS tp, sum(t)::DOUBLE AS support, sum(p)::DOUBLE AS pred FROM (
    SELECT {by}, y AS label, (y = yhat)::INT AS tp, 1 AS t, 0 AS p FROM {source}
    UNION ALL SELECT {by}, yhat, 0, 0, 1 FROM {source}) GROUP BY {by}, label) GROUP BY {by}"""


DIMS = "SELECT vec_id, vec_id // 5 AS doc_id, vec_id % 5 AS chunk_pos, label::VARCHAR AS label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"
CATS = "SELECT p_partkey AS id, lower(p_brand) AS v FROM part UNION SELECT p_partkey, lower(p_type) FROM part UNION SELECT p_partkey, lower(unnest(string_split(p_name, ' '))) FROM part"
MEAN_FEATURES = f"""
WITH d AS ({DIMS}), v AS (
  SELECT p_partkey AS id, 'a' AS feature, dim, value FROM part JOIN d ON d.vec_id = p_partkey
  UNION ALL SELECT p_partkey, 'j', dim, value FROM part JOIN d ON d.vec_id = p_size)
SELECT id, dim, round(coalesce(avg(value), 0), 6) + 0.0 AS value
FROM (SELECT p_partkey AS id, unnest(range(64)) AS dim FROM part) LEFT JOIN v USING (id, dim) GROUP BY id, dim"""

QUERIES = {
    "vocab": vocab,
    "bow": bow,
    "oov_transform": oov_transform,
    "tfidf": tfidf,
    "ngram_profile": ngram_profile,
    "class_profile": class_profile,
    "dict_score": dict_score,
    "dict_predict": dict_predict,
    "dict_report": dict_report,
    "mean_word_vector": mean_word_vector,
    "mean_pool": mean_pool,
    "label_means": label_means,
    "mean_features": mean_features,
    "category_dictionary": category_dictionary,
    "multi_hot": multi_hot,
    "strat_split": strat_split,
    "strat_3way": strat_3way,
    "strat_kfold": strat_kfold,
}

ORACLE = {
    "vocab": f"WITH {TFIDF} SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM idf",
    "bow": BAG,
    "oov_transform": f"WITH {TFIDF} SELECT doc_id, term, value FROM test SEMI JOIN idf USING (term)",
    "tfidf": f"WITH {TFIDF} SELECT doc_id, term, round(value, 6) AS value, role FROM weights",
    "ngram_profile": "SELECT doc_id, n, ngram, cnt, round(weight, 9) AS weight FROM "
    + profile_sql("documents", "doc_id", "pos"),
    "class_profile": f"SELECT label, n, ngram, cnt, round(weight, 9) AS weight FROM {CLASS_PROFILE}",
    "dict_score": f"WITH {DICT} SELECT doc_id, config, label, round(score, 9) AS score FROM scores",
    "dict_predict": f"WITH {DICT} {LOWEST.format('doc_id, config')}",
    "dict_report": f"{REPORT} SELECT model_type, data_type, round(f1, 6) AS f1_score, round(accuracy, 6) AS accuracy FROM ({f1_sql('answers', 'model_type, data_type')})",
    "mean_word_vector": f"""
WITH words AS MATERIALIZED (SELECT doc_id, unnest({WORDS.format('lower(text)')}) AS word FROM documents),
top AS (SELECT word, row_number() OVER (ORDER BY df DESC, word) - 1 AS vec_id FROM (
  SELECT word, count(DISTINCT doc_id) AS df FROM words GROUP BY word)),
n AS (SELECT doc_id, vec_id, count(*)::DOUBLE AS n FROM words JOIN top USING (word) GROUP BY doc_id, vec_id),
d AS ({DIMS}),
m AS (SELECT n.doc_id, dim, sum(n * value) / sum(n) AS value FROM n JOIN d USING (vec_id) GROUP BY n.doc_id, dim)
SELECT doc_id, dim, round(coalesce(value, 0), 6) + 0.0 AS value
FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents) LEFT JOIN m USING (doc_id, dim)""",
    "mean_pool": f"SELECT doc_id, dim, round(avg(value), 6) + 0.0 AS value FROM ({DIMS}) GROUP BY doc_id, dim",
    "label_means": f"SELECT label, dim, round(avg(value), 6) + 0.0 AS value FROM ({DIMS}) GROUP BY label, dim",
    "mean_features": MEAN_FEATURES,
    "category_dictionary": f"SELECT DISTINCT v AS value FROM ({CATS})",
    "multi_hot": f"SELECT id, idx FROM ({CATS}) JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM (SELECT DISTINCT v FROM ({CATS}))) USING (v)",
    "strat_split": f"SELECT doc_id, label, split, role FROM ({split_sql(5)})",
    "strat_3way": """
SELECT doc_id, lang AS label, CASE WHEN rn <= ceil(held / 2) THEN 'eval' WHEN rn <= held THEN 'test' ELSE 'train' END AS role
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', doc_id, 0, 42)), doc_id) AS rn,
      round(0.1 * count(*) OVER (PARTITION BY lang)) AS held FROM documents)""",
    "strat_kfold": "SELECT doc_id, lang AS label, ntile(5) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS fold FROM documents",
}
