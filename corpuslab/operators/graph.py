"""Citation graph operators on edges(src, dst) and nodes(id, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.vectors import doubles
from corpuslab.operators.linked import as_cells, grid, linked_means
from corpuslab.operators.reach import reach_sizes
from corpuslab.plans.scale import cut_lineage, global_rank, hot_join, hot_keys


def corpus_edges(edges: DataFrame, corpus: DataFrame, key: str, hot: dict | None = None) -> DataFrame:
    """Citations of corpus documents only."""
    known = corpus.select(F.col(key).alias("src")).distinct()
    hot = hot_keys(edges, "src") if hot is None else hot
    return hot_join(edges, known, "src", hot, ["dst"], "left_semi")


def attach_text(metadata: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Adds the per-document text feature to node metadata where there is one."""
    return metadata.join(texts, key, "left")


def build_graph(
    edges: DataFrame, metadata: DataFrame, key: str,
    hot_src: dict | None = None, hot_dst: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes(id), distinct edges) keeping edges whose two ends have metadata. Nodes without
    a kept edge are not part of the graph."""
    distinct = edges.select("src", "dst").distinct()
    hot_src = hot_keys(distinct, "src") if hot_src is None else hot_src
    hot_dst = hot_keys(distinct, "dst") if hot_dst is None else hot_dst
    known = metadata.select(F.col(key).alias("src")).distinct()
    kept = hot_join(distinct, known, "src", hot_src, ["dst"], "left_semi")
    kept = hot_join(kept, known.withColumnRenamed("src", "dst"), "dst", hot_dst, ["src"], "left_semi")
    nodes = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes, kept.select("src", "dst")


def node_attributes(nodes: DataFrame, metadata: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Non-empty metadata fields of the graph's nodes; empty strings and arrays become null."""
    kinds = {f.name: f.dataType.typeName() for f in metadata.schema}
    cleaned = [
        F.when(F.size(f) > 0, F.col(f)).alias(f) if kinds[f] == "array" else F.nullif(F.col(f), F.lit("")).alias(f)
        for f in fields
    ]
    return nodes.join(metadata.select(F.col(key).alias("id"), *cleaned), "id", "left")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) divided by the number of nodes. Edge ends and nodes are
    counted in one aggregation."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), none.alias("i"), one.alias("o")),
                F.struct(F.col("dst").alias("id"), one.alias("i"), none.alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    counted = ends.unionByName(nodes.select("id", none.alias("i"), none.alias("o")))
    n = nodes.agg(F.count("*").cast("double")).scalar()
    return counted.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).select(
        "id", (F.col("i") / n).alias("in_degree"), (F.col("o") / n).alias("out_degree")
    )


def path_lengths(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, dist): hop distances from chosen sources, the source itself at 0, as rows. For
    all nodes as sources take ``mean_path``, which keeps no pairs.

    Each round joins the newest pairs with the edges and drops pairs already reached; a round's
    result is checkpointed. A node reached by many sources is split by source.
    """
    frontier = reached = cut_lineage(sources.select(
        F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("dist")))
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
    depth = 0
    while True:
        depth += 1
        found = (
            hot_join(frontier.select("source", "node"), steps, "node", hot_keys(frontier, "node"), ["source"])
            .select("source", F.col("_next").alias("node"))
            .distinct()
            .join(reached.select("source", "node"), ["source", "node"], "left_anti")
            .withColumn("dist", F.lit(depth))
        )
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def mean_path(nodes: DataFrame, edges: DataFrame, hot: dict | None = None) -> DataFrame:
    """(id, mean_path): mean hop distance over reachable nodes, itself included.

    The distances of a node add up to what the sizes of its sets within 0, 1, .. hops lack of the last one; ``reach`` counts
    those sizes without (source, node) rows. Cited nodes are numbered first; ``hot`` are the keys to split when edges are numbered.
    """
    cited = edges.select(F.col("dst").alias("id")).distinct().withColumn("_late", F.lit(0))
    ordered = nodes.select("id").join(cited, "id", "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
    index = cut_lineage(global_rank(ordered, ["_late", "id"], name="idx"))
    n_cited = index.filter("_late = 0").count()
    links = cut_lineage(index_edges(edges.select("src", "dst").distinct(), index, hot, hot).select(
        F.col("src_idx").alias("idx"), F.col("dst_idx").alias("to")))
    own = F.col("_late")  # a cited node is among those counted
    sizes = list(reach_sizes(links, n_cited))
    if not sizes:
        return index.select("id", F.lit(0.0).alias("mean_path"))
    hops = [s.select("idx", F.col("n"), F.lit(k).alias("k")) for k, s in enumerate(sizes, 1)]
    last = F.max(F.when(F.col("k") == len(hops), F.col("n")))
    per = reduce(DataFrame.unionByName, hops).groupBy("idx").agg(last.alias("n"), F.sum("n").alias("s"))
    reached = F.coalesce("n", F.lit(0)) + own
    # the last size times the hops, less the sizes within 0 .. hops - 1; within 0 hops a node reaches itself
    lack = F.lit(len(hops)) * reached - (F.coalesce(F.col("s") - F.col("n"), F.lit(0)) + own * (len(hops) - 1) + 1)
    return index.join(per, "idx", "left").select("id", (lack / reached).alias("mean_path"))


def clustering(nodes: DataFrame, edges: DataFrame, hot: dict | None = None) -> DataFrame:
    """(id, clustering): directed clustering coefficient, self-loops ignored.

    Undirected pairs carry m = number of directions and point from the lower to the higher
    degree, which bounds every neighbour list by sqrt(2 * edges) even for hubs. Each pair
    intersects its two ends' lists; triangles are credited through partial sums.
    """
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("m"))
    )
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "m")
    sizes = ends.groupBy("id").agg(
        F.sum("m").alias("deg"), F.sum((F.col("m") == 2).cast("long")).alias("both"), F.count("*").alias("near")
    )
    hub = hot_keys(ends, "id") if hot is None else hot
    near_a = sizes.select(F.col("id").alias("a"), F.col("near").alias("na"))
    near_b = sizes.select(F.col("id").alias("b"), F.col("near").alias("nb"))
    sized = hot_join(hot_join(pairs, near_a, "a", hub, ["b"]), near_b, "b", hub, ["a"])
    up = F.struct("na", "a") <= F.struct("nb", "b")
    oriented = sized.select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"),
        "m",
    )
    lists = oriented.groupBy("u").agg(
        F.collect_list(F.struct("v", "m")).alias("all"),
        F.collect_list(F.when(F.col("m") == 1, F.col("v"))).alias("one"),
        F.collect_list(F.when(F.col("m") == 2, F.col("v"))).alias("two"),
    )
    lists = cut_lineage(lists)
    from_u = lists.select(
        "u", F.col("one").alias("u1"), F.col("two").alias("u2"), F.explode("all").alias("e")
    ).select("u", "u1", "u2", F.col("e.v").alias("v"), F.col("e.m").alias("m"))
    of_v = lists.select(F.col("u").alias("v"), F.col("one").alias("v1"), F.col("two").alias("v2"))
    both = hot_join(from_u, of_v, "v", hub, ["u"])

    def closing(x: str, y: str, factor: int):
        return F.transform(
            F.array_intersect(x, y), lambda w: F.struct(w.alias("id"), (F.col("m") * factor).alias("t"))
        )

    third = F.concat(
        closing("u1", "v1", 1), closing("u1", "v2", 2), closing("u2", "v1", 2), closing("u2", "v2", 4)
    )
    credited = both.withColumn("_w", third).filter(F.size("_w") > 0).withColumn(
        "_sum", F.aggregate("_w", F.lit(0).cast("long"), lambda s, x: s + x["t"])
    )
    triangles = credited.select(
        F.explode(
            F.concat(
                "_w",
                F.array(
                    F.struct(F.col("u").alias("id"), F.col("_sum").alias("t")),
                    F.struct(F.col("v").alias("id"), F.col("_sum").alias("t")),
                ),
            )
        ).alias("c")
    ).select("c.*").groupBy("id").agg(F.sum("t").alias("t"))
    slots = F.col("deg") * (F.col("deg") - 1) - 2 * F.col("both")
    value = F.when(F.coalesce("t", F.lit(0)) > 0, F.col("t") / slots).otherwise(F.lit(0.0))
    return (
        nodes.select("id").join(sizes, "id", "left").join(triangles, "id", "left").select("id", value.alias("clustering"))
    )


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6,
    max_rounds: int = 100, rounds: int | None = None, hot: dict | None = None,
) -> DataFrame:
    """(id, pagerank). Stops when the total change is below nodes x tolerance, or after
    exactly ``rounds`` rounds; raises if ``max_rounds`` are not enough. Dangling mass is spread evenly.

    Edges are placed by (src, part) once and kept; parts split the sources with many edges. A round
    meets them with the ranks placed alike, so no edge moves; what moves is the sums per node.
    The dangling mass is a scalar subquery; only the total change reaches the driver.
    """
    n = nodes.count()
    if hot is None:
        hot = hot_keys(edges, "src")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("src", edges.schema["src"].dataType), T.StructField("_parts", T.IntegerType())])
    parts = F.broadcast(nodes.sparkSession.createDataFrame(list(hot.items()), schema))  # see hot_keys for the bound
    copies = F.coalesce("_parts", F.lit(1))
    fan = edges.groupBy("src").agg((F.lit(1.0) / F.count("*")).alias("w"))
    placed = edges.select("src", "dst").join(parts, "src", "left").select(
        "src", F.pmod(F.xxhash64("dst"), copies).cast("int").alias("part"), "dst").repartition(partitions, "src", "part").persist(
        StorageLevel.MEMORY_AND_DISK)
    state = cut_lineage(
        nodes.select("id").join(fan.select(F.col("src").alias("id"), "w"), "id", "left")
        .join(parts.withColumnRenamed("src", "id"), "id", "left")
        .select("id", F.lit(1.0 / n).alias("r"), F.lit(None).cast("double").alias("was"), "w", copies.alias("copies")))
    rounds_left = rounds if rounds is not None else max_rounds
    while rounds_left:
        rounds_left -= 1
        lost = state.filter("w IS NULL").agg(F.coalesce(F.sum("r"), F.lit(0.0))).scalar()
        base = F.lit((1.0 - damping) / n) + F.lit(damping / n) * lost
        sent = state.filter("w IS NOT NULL").select(
            F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"),
            (F.col("r") * F.col("w")).alias("share")).repartition(partitions, "src", "part")
        none = F.lit(None)
        flow = placed.join(sent, ["src", "part"]).select(
            F.col("dst").alias("id"), F.col("share").alias("in"), none.cast("double").alias("was"),
            none.cast("double").alias("w"), none.cast("int").alias("copies"))
        keep = state.select("id", F.lit(0.0).alias("in"), F.col("r").alias("was"), "w", "copies")
        state = cut_lineage(flow.unionByName(keep).groupBy("id").agg(
            F.sum("in").alias("in"), F.max("was").alias("was"), F.max("w").alias("w"), F.max("copies").alias("copies")).select(
            "id", (base + F.lit(damping) * F.col("in")).alias("r"), "was", "w", "copies"))
        if rounds is None:
            change = state.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] or 0.0
            if change < n * tolerance:
                break
    else:
        if rounds is None:
            raise ValueError(f"no convergence within {max_rounds} rounds")
    placed.unpersist()
    return state.select("id", F.col("r").alias("pagerank"))


def neighbour_stats(edges: DataFrame, values: DataFrame, hot: dict | None = None) -> DataFrame:
    """(id, avg, min, max) of values(id, value) over the nodes a node points to."""
    hot = hot_keys(edges, "dst") if hot is None else hot
    near = hot_join(edges, values.select(F.col("id").alias("dst"), "value"), "dst", hot, ["src"])
    return near.groupBy(F.col("src").alias("id")).agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def structure(degree: DataFrame, paths: DataFrame, cluster: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, struc): [in_degree, out_degree, mean_path, clustering, pagerank]."""
    joined = degree.join(paths.select("id", "mean_path"), "id").join(cluster, "id").join(ranks, "id")
    return joined.select(
        "id", F.array("in_degree", "out_degree", "mean_path", "clustering", "pagerank").alias("struc")
    )


def node_features(struc: DataFrame, cat: DataFrame, emb: DataFrame) -> DataFrame:
    """(id, struc, cat, emb), one row per node. emb: (id, vec)."""
    return struc.join(cat, "id").join(emb, "id").select("id", "struc", "cat", F.col("vec").alias("emb"))


def index_nodes(nodes: DataFrame) -> DataFrame:
    """(id, idx) by id order."""
    return global_rank(nodes.select("id"), ["id"], name="idx")


def index_edges(edges: DataFrame, index: DataFrame, hot_src: dict | None = None, hot_dst: dict | None = None) -> DataFrame:
    """(src_idx, dst_idx)."""
    hot_src = hot_keys(edges, "src") if hot_src is None else hot_src
    hot_dst = hot_keys(edges, "dst") if hot_dst is None else hot_dst
    left = hot_join(edges, index.select(F.col("id").alias("src"), F.col("idx").alias("src_idx")), "src", hot_src, ["dst"])
    both = hot_join(left, index.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx")), "dst", hot_dst, ["src"])
    return both.select("src_idx", "dst_idx")


def node_roles(index: DataFrame, splits: DataFrame, label_index: DataFrame, n_splits: int) -> DataFrame:
    """(split, id, idx, y, role): labelled nodes train or val, the others test with y = -1.

    splits: (id, split, role test|train); label_index: (id, y).
    """
    role = F.when(F.col("role") == "test", F.lit("val")).otherwise(F.col("role"))
    every = index.join(label_index, "id", "left").withColumn(
        "split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    )
    return every.join(splits.select("id", "split", role.alias("role")), ["id", "split"], "left").select(
        "split", "id", "idx", F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("role", F.lit("test")).alias("role")
    )


def induced_subgraph(
    edges: DataFrame, members: DataFrame, hot_src: dict | None = None, hot_dst: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """(index(id, idx), indexed edges) of the subgraph on ``members(id)``, numbered from 0."""
    index = index_nodes(members.distinct())
    return index, index_edges(edges, index, hot_src, hot_dst)


def neighbour_means(
    nodes: DataFrame, edges: DataFrame, features: DataFrame, rounds: int = 1, hot: dict | None = None
) -> DataFrame:
    """(id, vec): own features followed by the mean over citing nodes and oneself, repeated
    ``rounds`` times (each round widens the neighbourhood by one hop). A node's vector is sent once per group of nodes
    that it cites (``linked``), so hubs need no splitting on either end; ``hot`` is no longer read."""
    own = cut_lineage(nodes.select("id").join(features.select("id", doubles(F.col("vec")).alias("vec")), "id"))
    ends = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    loops = own.select(F.col("id").alias("source"), F.col("id").alias("target"))
    links = cut_lineage(ends.unionByName(loops).withColumn("weight", F.lit(1.0)))
    n_links, n_sources, n_targets = links.agg(
        F.count("*"), F.approx_count_distinct("source"), F.approx_count_distinct("target")).first()
    rows, columns = grid(n_links, n_sources, n_targets, 2 * edges.sparkSession.sparkContext.defaultParallelism)
    cells = as_cells(links, rows, columns)
    current, out = own, own.withColumnRenamed("vec", "_h0")
    for i in range(1, rounds + 1):
        means = linked_means(cells, current.withColumnRenamed("id", "source"), rows, columns, n_targets)
        current = cut_lineage(means.withColumnRenamed("target", "id"))
        out = out.join(current.withColumnRenamed("vec", f"_h{i}"), "id")
    return out.select("id", F.concat(*(F.col(f"_h{i}") for i in range(rounds + 1))).alias("vec"))
