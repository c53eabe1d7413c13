"""Queries over dense vectors: nearest gold, dispersion, entropy, components and projection.

Vectors with an even id are gold, the others generated; label is the category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.operators import clusters as cl
from sievecraft.operators import vector as v
from sievecraft.sources.records import spread, table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 2 == 0).alias("gold"))


def vec_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold category whose mean vector is nearest to each generated vector, and the cosine to it: an easier question than
    `vec_nearest_gold`."""
    rows = _rows(spark, sf_dir)
    centres = v.centroid(rows.where("gold"), ["label"], "embedding").select(F.col("label").alias("c"), "centroid")
    # As many rows as categories, held to that by the aggregation.
    near = rows.where("NOT gold").join(F.broadcast(centres)).withColumn("sim", v.dot(F.col("embedding"), F.col("centroid")) / (v.norm(F.col("embedding")) * v.norm(F.col("centroid"))))
    best = near.groupBy("vec_id").agg(F.max_by(F.struct("c", "sim"), F.struct(F.round("sim", 9), -F.col("c"))).alias("b"), F.max("label").alias("label"))
    return best.select("vec_id", F.col("b.c").alias("nearest"), F.round("b.sim", 5).alias("similarity"), (F.col("b.c") == F.col("label")).alias("same"))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact nearest of all other vectors for each vector whose id is divisible by 50, with both labels."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = v.nearest(spread(rows.where("vec_id % 50 = 0")), spread(rows.where("vec_id % 50 <> 0")), "vec_id", "embedding")
    labels = rows.select("vec_id", "label")
    found = found.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("query_label")), "query")
    return found.join(labels.select(F.col("vec_id").alias("nearest"), F.col("label").alias("nearest_label")), "nearest")


def vec_nearest_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each searched vector's nearest vector over all others, its category and the cosine; of equal ones the least id."""
    return _searched(spark, sf_dir).select("query", "nearest", "nearest_label", F.round("similarity", 5).alias("similarity"), (F.col("query_label") == F.col("nearest_label")).alias("same"))


def nearest_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct categories of the nearest vectors, and their number, per category of the searched ones."""
    by = _searched(spark, sf_dir).groupBy("query_label")
    return by.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("nearest_label")), ",").alias("labels"), F.count_if(F.col("query_label") == F.col("nearest_label")).alias("n_same"))


def vec_method_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity to the nearest vector of two methods (ids divisible by 100 and the others) and their difference."""
    one = F.when(F.col("query") % 100 == 0, F.col("similarity"))
    other = F.when(F.col("query") % 100 != 0, F.col("similarity"))
    out = _searched(spark, sf_dir).agg(F.avg(one).alias("a"), F.avg(other).alias("b"))
    return out.select(F.round("a", 5).alias("left_mean"), F.round("b", 5).alias("right_mean"), F.round(F.col("a") - F.col("b"), 5).alias("delta"))


#: Weight of the category in a vector that stands for an item, and the cosine from which on two are linked.
PULL, LINKED = 3.0, 0.92


def _pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors drawn towards an axis of their category, so that categories are dense regions."""
    rows = spread(_rows(spark, sf_dir))
    return rows.withColumn("embedding", F.transform(v.unit(F.col("embedding")), lambda x, i: x + F.when(i == F.col("label"), PULL).otherwise(0.0)))


def vec_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of gold vectors, named by their least id, with their sizes."""
    out = cl.clusters(_pulled(spark, sf_dir).where("gold"), "vec_id", "embedding", LINKED)
    return out.select(F.col("node").alias("vec_id"), F.col("component").alias("cluster"), "size")


def vec_cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category, how many generated vectors (ids that leave 1 over 50) have their nearest gold vector in each cluster, and
    how many clusters that makes."""
    rows = _pulled(spark, sf_dir)
    gold = rows.where("gold")
    found = v.nearest(rows.where("vec_id % 50 = 1"), gold, "vec_id", "embedding")
    found = found.join(cl.clusters(gold, "vec_id", "embedding", LINKED).select(F.col("node").alias("nearest"), "component"), "nearest")
    by = found.join(_rows(spark, sf_dir).select(F.col("vec_id").alias("query"), "label"), "query").groupBy("label", "component").agg(F.count(F.lit(1)).alias("n"))
    return by.select("label", F.col("component").alias("cluster"), "n", F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n_clusters"))


def vec_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - mean cosine of all pairs of a category."""
    return v.mean_pairwise_cosine(_rows(spark, sf_dir), ["label"], "embedding").select("label", "n", F.round(1 - F.col("mean_cosine"), 5).alias("dispersion"))


def cluster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.normalized_entropy(_rows(spark, sf_dir), ["gold"], "label", 10).select("gold", F.round("entropy", 6).alias("entropy"))


def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.select("vec_id", F.round(v.norm(F.col("embedding")), 5).alias("norm"), F.round(v.norm(v.unit(F.col("embedding"))), 5).alias("unit_norm"))


def category_nearest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_nearest(spark, sf_dir).groupBy("nearest").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"), F.round(F.avg("similarity"), 4).alias("mean_similarity"))


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two principal components, signs set so that the largest loading is positive; rounded coarsely."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _rows(spark, sf_dir).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="z").fit(rows).transform(rows)
    model = PCA(k=2, inputCol="z", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    out = model.transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(F.col("p")[0] * signs[0], 4).alias("x"), F.round(F.col("p")[1] * signs[1], 4).alias("y"))


QUERIES = {f.__name__: f for f in (vec_nearest, vec_nearest_gold, nearest_label_sets, vec_method_delta, vec_clusters, vec_cluster_counts, vec_dispersion, cluster_entropy, vec_norms, category_nearest_counts, pca_2d)}

_U = "list_transform(embedding, lambda x: x::DOUBLE)"
_NEAR = f"""ct AS (SELECT label AS c, list(m ORDER BY d) AS centroid FROM (SELECT label, d, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings WHERE vec_id % 2 = 0) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, label, c, list_dot_product({_U}, centroid) / sqrt(list_dot_product({_U}, {_U}) * list_dot_product(centroid, centroid)) AS sim FROM embeddings, ct WHERE vec_id % 2 = 1),
nr AS (SELECT vec_id, c AS nearest, round(sim, 5) AS similarity, c = label AS same FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, c) = 1)"""
_SEARCH = f"""sq AS (SELECT a.vec_id AS query, a.label AS query_label, b.vec_id AS nearest, b.label AS nearest_label, round(list_dot_product(a.u, b.u) / sqrt(list_dot_product(a.u, a.u) * list_dot_product(b.u, b.u)), 9) AS similarity
  FROM (SELECT vec_id, label, {_U} AS u FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, label, {_U} AS u FROM embeddings WHERE vec_id % 50 <> 0) b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) = 1)"""
_PULLED = f"""u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
p AS (SELECT vec_id, label, list_transform(e, lambda x, i: x + CASE WHEN i - 1 = label THEN {PULL} ELSE 0 END) AS e FROM u), g AS (SELECT * FROM p WHERE vec_id % 2 = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.e, b.e), 9) >= {LINKED}),
r(a, b) AS (SELECT vec_id, vec_id FROM g UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS vec_id, min(b) AS cluster, count(*) AS size FROM r GROUP BY a)"""
ORACLE_SQL = {
    "vec_clusters": f"WITH RECURSIVE {_PULLED} SELECT vec_id, cluster, size FROM c",
    "vec_cluster_counts": f"""WITH RECURSIVE {_PULLED}, n AS (SELECT q.vec_id, q.label, arg_min(g.vec_id, (-round(list_cosine_similarity(q.e, g.e), 9), g.vec_id)) AS nearest FROM p q JOIN g ON true WHERE q.vec_id % 50 = 1 GROUP BY ALL),
        b AS (SELECT label, cluster, count(*) AS n FROM n JOIN c ON c.vec_id = n.nearest GROUP BY ALL) SELECT label, cluster, n, count(*) OVER (PARTITION BY label) AS n_clusters FROM b""",
    "vec_nearest_gold": f"WITH {_SEARCH} SELECT query, nearest, nearest_label, round(similarity, 5) AS similarity, query_label = nearest_label AS same FROM sq",
    "nearest_label_sets": f"WITH {_SEARCH} SELECT query_label, count(*) AS n, array_to_string(list_sort(list(DISTINCT nearest_label)), ',') AS labels, count(*) FILTER (query_label = nearest_label) AS n_same FROM sq GROUP BY query_label",
    "vec_method_delta": f"WITH {_SEARCH} SELECT round(avg(similarity) FILTER (query % 100 = 0), 5) AS left_mean, round(avg(similarity) FILTER (query % 100 <> 0), 5) AS right_mean, round(avg(similarity) FILTER (query % 100 = 0) - avg(similarity) FILTER (query % 100 <> 0), 5) AS delta FROM sq",
    "vec_nearest": f"WITH {_NEAR} SELECT * FROM nr",
    "vec_dispersion": f"""SELECT a.label, max(n) AS n, round(1 - avg(list_dot_product(a.u, b.u) / (sqrt(list_dot_product(a.u, a.u)) * sqrt(list_dot_product(b.u, b.u)))), 5) AS dispersion
        FROM (SELECT vec_id, label, {_U} AS u, count(*) OVER (PARTITION BY label) AS n FROM embeddings) a JOIN (SELECT vec_id, label, {_U} AS u FROM embeddings) b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""",
    "cluster_entropy": "SELECT gold, round(-sum(p * ln(p)) / ln(10), 6) AS entropy FROM (SELECT vec_id % 2 = 0 AS gold, label, count(*) / sum(count(*)) OVER (PARTITION BY vec_id % 2 = 0) AS p FROM embeddings GROUP BY vec_id % 2 = 0, label) GROUP BY gold",
    "vec_norms": f"SELECT vec_id, round(sqrt(list_dot_product({_U}, {_U})), 5) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
    "category_nearest_counts": f"WITH {_NEAR} SELECT nearest, count(*) AS n, count(*) FILTER (same) AS n_same, round(avg(similarity), 4) AS mean_similarity FROM nr GROUP BY nearest",
}
