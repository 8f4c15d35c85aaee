"""Citation graph queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import standins as st
from corpuslab.catalog.corpus_queries import PREP
from corpuslab.catalog.feature_queries import MEAN_FEATURES, category_index, node_embeddings
from corpuslab.operators import attention, corpus, embeddings, graph, learners, splits
from corpuslab.plans.scale import cut_lineage

RANK_ROUNDS = 60  # the rounds that SQL lays out; ranks are those of the first round that changes less than the tolerance


ATTENTION_EPOCHS, ATTENTION_PATIENCE = 8142, 1177  # those of the published training


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph.build_graph(st.citations(spark, sf_dir), st.item_metadata(spark, sf_dir), "id")
    edges = cut_lineage(edges)
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of items that are corpus documents, without duplicates."""
    kept = graph.corpus_edges(st.citations(spark, sf_dir), st.table(spark, sf_dir, "documents"), "doc_id")
    return graph.build_graph(kept, st.item_metadata(spark, sf_dir), "id")[1]


def attach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata with the section names of the document of the same number."""
    prepared = st.prepared(spark, sf_dir)
    texts = prepared.select(F.col("doc_id").alias("id"), corpus.section_name_view("seq").alias("sec_name"))
    return graph.attach_text(st.item_metadata(spark, sf_dir).select("id", "publisher"), texts, "id")


def edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_graph(st.citations(spark, sf_dir), st.item_metadata(spark, sf_dir), "id")[1]


def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _graph(spark, sf_dir)
    rows = graph.node_attributes(nodes, st.item_metadata(spark, sf_dir), "id", ["publisher", "type", "subject"])
    return rows.select("id", "publisher", "type", F.array_join("subject", "|").alias("subject"))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.degrees(*_graph(spark, sf_dir))
    return rows.select("id", F.round("in_degree", 9).alias("in_degree"), F.round("out_degree", 9).alias("out_degree"))


def mean_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.mean_path(*_graph(spark, sf_dir))
    return rows.select("id", F.round("mean_path", 9).alias("mean_path"))


def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clustering(*_graph(spark, sf_dir)).select("id", F.round("clustering", 9).alias("clustering"))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = graph.pagerank(*_graph(spark, sf_dir))
    return ranks.select("id", F.round("pagerank", 9).alias("pagerank"))


def neighbor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _graph(spark, sf_dir)
    prices = st.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    rows = graph.neighbour_stats(edges, prices)
    return rows.select("id", F.round("avg", 6).alias("avg"), "min", "max")


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Feature rows and the width of the category part."""
    nodes, edges = _graph(spark, sf_dir)
    struc = graph.structure(
        graph.degrees(nodes, edges), graph.mean_path(nodes, edges), graph.clustering(nodes, edges),
        graph.pagerank(nodes, edges),
    )
    meta = st.item_metadata(spark, sf_dir)
    index = cut_lineage(category_index(spark, sf_dir))
    cat = embeddings.multi_hot(meta, "id", ["publisher", "type"], ["subject"], index)
    return graph.node_features(struc, cat, node_embeddings(spark, sf_dir)), index.count()


def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows by group: width and rounded sum of every selection."""
    rows, n_cat = _features(spark, sf_dir)
    picked = F.array(*(
        F.struct(F.lit(g).alias("feat_type"), embeddings.node_vector(g, 5, n_cat, 64).alias("v"))
        for g in embeddings.FEATURE_GROUPS
    ))
    total = F.aggregate("g.v.values", F.lit(0.0), lambda s, x: s + x)
    return cut_lineage(rows).select("id", F.explode(picked).alias("g")).select(
        "id", "g.feat_type", F.col("g.v.size").cast("long").alias("width"), (F.round(total, 4) + 0.0).alias("total")
    )


def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.index_edges(edges, graph.index_nodes(nodes))


def node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items numbered like documents carry the document's language as class."""
    nodes, _ = _graph(spark, sf_dir)
    docs = st.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lower("label").alias("label"))
    names = corpus.label_names(docs)
    coded = docs.select("id", corpus.encode_label(F.col("label"), names).alias("y"))
    parts = splits.stratified_splits(docs, "id", "label")
    rows = graph.node_roles(graph.index_nodes(nodes), parts, coded, 5)
    return rows.select(F.col("split").cast("long").alias("split"), "id", "idx", F.col("y").cast("long").alias("y"), "role")


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of items numbered like documents."""
    _, edges = _graph(spark, sf_dir)
    return graph.induced_subgraph(edges, st.documents(spark, sf_dir).select(F.col("doc_id").alias("id")))[1]


def khop_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    rows = graph.neighbour_means(nodes, edges, node_embeddings(spark, sf_dir), rounds=2)
    return rows.select("id", F.posexplode("vec").alias("dim", "value")).select(
        "id", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value")
    )


def node_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item type from neighbourhood means through the logistic head."""
    nodes, edges = _graph(spark, sf_dir)
    vectors = graph.neighbour_means(nodes, edges, node_embeddings(spark, sf_dir), rounds=2)
    meta = st.item_metadata(spark, sf_dir).select("id", F.col("type").alias("label"))
    names = corpus.label_names(meta)
    rows = learners.as_features(
        vectors.join(meta.select("id", corpus.encode_label(F.col("label"), names).alias("label")), "id")
    )
    roles = cut_lineage(splits.stratified_splits(rows, "id", "label", 1))
    return learners.fit_predict(
        learners.linear_head(max_iter=100), roles.filter("role = 'train'"), roles.filter("role = 'test'"), "id"
    )


def _example_layer(features: int, heads: int, channels: int) -> attention.Layer:
    """A layer with weights that SQL can name."""
    i, j = np.indices((features, heads * channels))
    j0 = np.arange(heads * channels)
    return attention.Layer(((i * 7 + j * 13) % 11 - 5) / 10, ((j0 * 5) % 7 - 3) / 4, ((j0 * 3) % 5 - 2) / 4, heads)


def attention_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attention layer of two heads over the citation graph and the items' embeddings."""
    nodes, edges = _graph(spark, sf_dir)
    emb = node_embeddings(spark, sf_dir).join(nodes, "id")
    rows = emb.select(F.col("id").cast("long").alias("id"), F.sequence(F.lit(0), F.lit(63)).alias("idx"), F.col("vec").cast("array<double>").alias("val"))
    graph_ = attention.Graph.of(attention.with_loops(nodes, edges))
    projected = cut_lineage(attention.project(rows, {0: _example_layer(64, 2, 3)}))
    out = attention.attend(graph_, projected, 2, 3)
    return out.select("id", F.posexplode("out").alias("cell", "value")).select(
        "id", F.col("cell").cast("long").alias("cell"), (F.round("value", 6) + 0.0).alias("value"))


def attention_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of the two-layer network on split 0 for every feature group; all groups train in the same passes."""
    nodes, edges = _graph(spark, sf_dir)
    features, n_cat = _features(spark, sf_dir)
    features = cut_lineage(features)
    groups = dict(enumerate(embeddings.FEATURE_GROUPS))
    picked = [
        features.select((F.col("id") + m * attention.MODEL).alias("id"), embeddings.node_vector(g, 5, n_cat, 64).alias("v")).select(
            "id", F.col("v.indices").cast("array<int>").alias("idx"), F.col("v.values").alias("val"), F.col("v.size").alias("size"))
        for m, g in groups.items()]
    rows = cut_lineage(reduce(DataFrame.unionByName, picked))
    roles = node_roles(spark, sf_dir).filter("split = 0").select("id", "role", F.col("y").cast("int").alias("y"))
    targets = cut_lineage(attention.of_models(roles.withColumn("id", F.col("id").cast("long")), list(groups), "id"))
    loops = cut_lineage(attention.of_models(attention.with_loops(nodes, edges), list(groups), "src", "dst"))
    sizes = {r.m: r.n for r in rows.groupBy(F.floor(F.col("id") / float(attention.MODEL)).alias("m")).agg(F.max("size").alias("n")).collect()}
    classes = targets.agg(F.max("y")).first()[0] + 1
    nets = {m: attention.Network.start(sizes[m], classes) for m in groups}
    history, _ = attention.train(
        attention.Graph.of(loops), rows.drop("size"), targets, nets, ATTENTION_EPOCHS, ATTENTION_PATIENCE)
    named = [(groups[m], *rest) for m, *rest in history]
    curves = "train_loss double, val_loss double, train_f1 double, val_f1 double, train_accuracy double, val_accuracy double"
    return spark.createDataFrame(named, f"feat_type string, epoch int, {curves}")


EDGES = """e AS MATERIALIZED (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)),
n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
DEGREES = """deg AS (SELECT n.id, (SELECT count(*) FROM n) AS total, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM n
  LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY dst) a USING (id)
  LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY src) b USING (id))"""
PATHS = """bfs(s, t, d) USING KEY (s, t) AS (
  SELECT id, id, 0 FROM n
  UNION SELECT bfs.s, e.dst, min(bfs.d) + 1 FROM bfs JOIN e ON e.src = bfs.t
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.s = bfs.s AND r.t = e.dst) GROUP BY bfs.s, e.dst),
paths AS (SELECT s AS id, sum(d)::DOUBLE / count(*) AS mean_path FROM bfs GROUP BY s)"""
CLUSTER = """m AS MATERIALIZED (SELECT a, b, count(*) AS m FROM (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst) GROUP BY a, b),
k AS (SELECT a AS id, sum(m) AS d, sum((m = 2)::INT) AS r FROM m GROUP BY a),
tri AS (SELECT x.a AS id, sum(x.m * y.m * z.m) AS t FROM m x JOIN m y ON y.a = x.a AND y.b > x.b JOIN m z ON z.a = x.b AND z.b = y.b GROUP BY x.a),
clus AS (SELECT n.id, CASE WHEN coalesce(t, 0) > 0 THEN t::DOUBLE / (d * (d - 1) - 2 * r) ELSE 0 END AS clustering
  FROM n LEFT JOIN k USING (id) LEFT JOIN tri USING (id))"""


def _rank_sql() -> str:
    steps = ["cnt AS (SELECT count(*)::DOUBLE AS c FROM n)", "od AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS o FROM e GROUP BY src)",
             "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c AS r FROM n, cnt)"]
    for i in range(1, RANK_ROUNDS + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / c + 0.85::DOUBLE * coalesce(f.x, 0)
  + 0.85::DOUBLE * coalesce((SELECT sum(r) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM od)), 0) / c AS r
  FROM n CROSS JOIN cnt LEFT JOIN (SELECT e.dst AS id, sum(r / o) AS x FROM e JOIN od USING (src) JOIN r{i - 1} p ON p.id = e.src GROUP BY e.dst) f USING (id))""")
    changes = " UNION ALL ".join(
        f"SELECT {i} AS i, sum(abs(a.r - b.r)) AS ch FROM r{i} a JOIN r{i - 1} b USING (id)" for i in range(1, RANK_ROUNDS + 1))
    steps.append(f"stop AS MATERIALIZED (SELECT min(i) AS i FROM ({changes}), cnt WHERE ch < c * 1e-6::DOUBLE)")
    steps.append("ranks AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT id, r FROM r{i}, stop WHERE stop.i = {i}" for i in range(1, RANK_ROUNDS + 1)) + ")")
    return ",\n".join(steps)


RANKS = _rank_sql()
CATS = "SELECT p_partkey AS id, lower(p_brand) AS v FROM part UNION SELECT p_partkey, lower(p_type) FROM part UNION SELECT p_partkey, lower(unnest(string_split(p_name, ' '))) FROM part"
INDEX = "ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM n)"
_GROUPS = [("struc", "s", "5"), ("struc+cat", "s + c", "5 + k"), ("cat", "c", "k"), ("struc+emb", "s + v", "5 + 64"),
           ("cat+emb", "c + v", "k + 64"), ("emb", "v", "64"), ("all", "s + c + v", "5 + k + 64")]
_EMB = MEAN_FEATURES.replace("WITH d AS", "d AS").replace("round(coalesce(avg(value), 0), 6) + 0.0 AS value", "coalesce(avg(value), 0) AS value")
_EMB_CTES, _EMB_SELECT = _EMB.rsplit("\nSELECT id, dim", 1)
EMB = f"{_EMB_CTES.strip()}, emb AS MATERIALIZED (SELECT id, dim{_EMB_SELECT})"

QUERIES = {
    "corpus_edges": corpus_edges,
    "attach_text": attach_text,
    "edge_build": edge_build,
    "node_attributes": node_attributes,
    "degrees": degrees,
    "mean_path": mean_path,
    "clustering": clustering,
    "pagerank": pagerank,
    "neighbor_stats": neighbor_stats,
    "node_features": node_features,
    "node_index": node_index,
    "node_roles": node_roles,
    "induced_subgraph": induced_subgraph,
    "khop_mean": khop_mean,
    "node_classifier": node_classifier,
    "attention_forward": attention_forward,
    "attention_history": attention_history,
}

ORACLE = {
    "corpus_edges": f"WITH {EDGES} SELECT src, dst FROM e WHERE src IN (SELECT doc_id FROM documents)",
    "attach_text": f"WITH {PREP} SELECT p_partkey AS id, p_brand AS publisher, array_to_string(names, ' ') AS sec_name FROM part LEFT JOIN prep ON doc_id = p_partkey",
    "edge_build": f"WITH {EDGES} SELECT src, dst FROM e",
    "node_attributes": f"WITH {EDGES} SELECT id, p_brand AS publisher, p_type AS type, replace(p_name, ' ', '|') AS subject FROM n JOIN part ON p_partkey = id",
    "degrees": f"WITH {EDGES}, {DEGREES} SELECT id, round(i::DOUBLE / total, 9) AS in_degree, round(o::DOUBLE / total, 9) AS out_degree FROM deg",
    "mean_path": f"WITH RECURSIVE {EDGES}, {PATHS} SELECT id, round(mean_path, 9) AS mean_path FROM paths",
    "clustering": f"WITH {EDGES}, {CLUSTER} SELECT id, round(clustering, 9) AS clustering FROM clus",
    "pagerank": f"WITH {EDGES}, {RANKS} SELECT id, round(r, 9) AS pagerank FROM ranks",
    "neighbor_stats": f"WITH {EDGES} SELECT src AS id, round(avg(p_retailprice), 6) AS avg, min(p_retailprice) AS min, max(p_retailprice) AS max FROM e JOIN part ON p_partkey = dst GROUP BY src",
    "node_features": f"""WITH RECURSIVE {EDGES}, {DEGREES}, {PATHS}, {CLUSTER}, {RANKS}, {EMB},
cats AS (SELECT id, count(*) AS c FROM ({CATS}) GROUP BY id), width AS (SELECT count(DISTINCT v) AS k FROM ({CATS})),
vsum AS (SELECT id, sum(value) AS v FROM emb GROUP BY id),
sums AS (SELECT deg.id, i::DOUBLE / total + o::DOUBLE / total + mean_path + clustering + r AS s, c, v, k FROM deg JOIN paths USING (id) JOIN clus USING (id)
  JOIN ranks USING (id) JOIN cats USING (id) JOIN vsum USING (id) CROSS JOIN width)
""" + " UNION ALL ".join(f"SELECT id, '{g}' AS feat_type, ({w})::BIGINT AS width, round(({t})::DOUBLE, 4) + 0.0 AS total FROM sums" for g, t, w in _GROUPS),
    "node_index": f"WITH {EDGES}, {INDEX} SELECT a.idx AS src_idx, b.idx AS dst_idx FROM e JOIN ix a ON a.id = src JOIN ix b ON b.id = dst",
    "node_roles": f"""WITH {EDGES}, {INDEX},
lab AS (SELECT doc_id AS id, dense_rank() OVER (ORDER BY lower(lang)) - 1 AS y FROM documents),
sp AS (SELECT doc_id AS id, s AS split, CASE WHEN row_number() OVER (PARTITION BY s, lower(lang) ORDER BY md5(concat_ws('|', doc_id, s, 42)), doc_id)
  <= round(0.2 * count(*) OVER (PARTITION BY s, lower(lang))) THEN 'val' ELSE 'train' END AS role FROM documents, range(5) r(s))
SELECT g.s AS split, ix.id, idx, coalesce(y, -1) AS y, coalesce(role, 'test') AS role FROM ix CROSS JOIN range(5) g(s)
LEFT JOIN lab USING (id) LEFT JOIN sp ON sp.id = ix.id AND sp.split = g.s""",
    "induced_subgraph": f"""WITH {EDGES}, ix AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT a.idx AS src_idx, b.idx AS dst_idx FROM e JOIN ix a ON a.id = src JOIN ix b ON b.id = dst""",
    "khop_mean": f"""WITH {EDGES}, {EMB},
loops AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM n),
h0 AS (SELECT emb.id, dim, value FROM emb JOIN n USING (id)),
h1 AS MATERIALIZED (SELECT dst AS id, dim, avg(value) AS value FROM loops JOIN h0 ON h0.id = src GROUP BY dst, dim),
h2 AS (SELECT dst AS id, dim, avg(value) AS value FROM loops JOIN h1 ON h1.id = src GROUP BY dst, dim)
SELECT id, dim, round(value, 6) + 0.0 AS value FROM h0 UNION ALL SELECT id, dim + 64, round(value, 6) + 0.0 FROM h1
UNION ALL SELECT id, dim + 128, round(value, 6) + 0.0 FROM h2""",
    "attention_forward": f"""WITH {EDGES}, {EMB},
loops AS (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT id, id FROM n),
z AS MATERIALIZED (SELECT emb.id, j, sum(value * (((dim * 7 + j * 13) % 11 - 5) / 10.0::DOUBLE)) AS z
  FROM emb JOIN n USING (id), (SELECT unnest(range(6)) AS j) GROUP BY emb.id, j),
st AS MATERIALIZED (SELECT id, j // 3 AS h, sum(z * (((j * 5) % 7 - 3) / 4.0::DOUBLE)) AS s, sum(z * (((j * 3) % 5 - 2) / 4.0::DOUBLE)) AS t FROM z GROUP BY id, j // 3),
q AS (SELECT src, dst, a.h, a.s + b.t AS q FROM loops JOIN st a ON a.id = src JOIN st b ON b.id = dst AND b.h = a.h),
w AS (SELECT *, exp(lq - max(lq) OVER (PARTITION BY dst, h)) AS w FROM (SELECT *, CASE WHEN q > 0 THEN q ELSE 0.2::DOUBLE * q END AS lq FROM q)),
al AS MATERIALIZED (SELECT src, dst, h, w / sum(w) OVER (PARTITION BY dst, h) AS al FROM w)
SELECT dst AS id, j::BIGINT AS cell, round(sum(al * z), 6) + 0.0 AS value FROM al JOIN z ON z.id = src AND z.j // 3 = h GROUP BY dst, j""",
}
