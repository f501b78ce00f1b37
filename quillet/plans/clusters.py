"""Queries over clusters of texts and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators import clusters as K
from quillet.plans.curation import _STOP, _WORDS, STOPWORDS


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vectors(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _dim(points: DataFrame) -> int:
    return points.agg(F.max(F.size("v"))).first()[0] or 0


def _labelled(spark, sf_dir: str) -> DataFrame:
    """The vectors, with their labels as clusters."""
    rows = _vectors(spark, sf_dir)
    return K.dense(rows.select("vec_id", "embedding")).join(rows.select("vec_id", F.col("label").alias("cluster")), "vec_id")


def _by_source(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "text", F.col("source").alias("cluster"))


def _silhouettes(spark, sf_dir: str) -> DataFrame:
    points = _labelled(spark, sf_dir)
    each = K.silhouettes(points, _dim(points))
    return each.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def _vector_clusters(spark, sf_dir: str) -> DataFrame:
    points = K.dense(_vectors(spark, sf_dir))
    return K.analysis(points, _dim(points))[0].select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


def _vector_analysis(spark, sf_dir: str) -> DataFrame:
    points = K.dense(_vectors(spark, sf_dir))
    return K.analysis(points, _dim(points))[1]


def _text_topics(spark, sf_dir: str) -> DataFrame:
    """Clusters of the documents' TF-IDF vectors: their share, first keywords and representative."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labelled, _ = K.analysis(K.tfidf(docs, stopwords=STOPWORDS), 1000, by="simpson")
    texts = docs.join(labelled.select("doc_id", "cluster"), "doc_id")
    return K.topics(labelled, K.keywords(texts, STOPWORDS)).join(K.representatives(labelled).select("cluster", "doc_id"), "cluster")


QUERIES = {
    "tfidf_weights": lambda s, d: K.weights(_docs(s, d), stopwords=STOPWORDS).withColumn("weight", F.round("weight", 6)),
    "cluster_keywords": lambda s, d: K.keywords(_by_source(s, d), STOPWORDS),
    "cluster_representatives": lambda s, d: K.representatives(_labelled(s, d)).withColumn("distance", F.round("distance", 6)),
    "cluster_sizes": lambda s, d: K.cluster_sizes(_docs(s, d).select(F.col("n_chars").alias("cluster"))),
    "label_silhouettes": _silhouettes,
    "vector_clusters": _vector_clusters,
    "vector_cluster_analysis": _vector_analysis,
    "text_topics": _text_topics,
}

_PARTS = "p AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL)"

ORACLE_SQL = {
    "tfidf_weights": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents WHERE regexp_matches(coalesce(text, ''), '\S')),
        c AS (SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS df FROM t WHERE term NOT IN ({_STOP}) GROUP BY 1 ORDER BY uses DESC, term LIMIT 1000),
        w AS (SELECT doc_id, term, count(*) * (ln((1 + (SELECT count(*) FROM documents WHERE regexp_matches(coalesce(text, ''), '\S'))) / (1 + any_value(df))) + 1) AS w FROM t JOIN c USING (term) GROUP BY 1, 2)
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "cluster_keywords": f"""WITH e AS (SELECT source AS cluster, doc_id, unnest({_WORDS}) AS word, unnest(range(len({_WORDS}))) AS pos FROM documents),
        c AS (SELECT cluster, word, count(*) AS n, min(doc_id * 10000000 + pos) AS first FROM e GROUP BY 1, 2),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first, word) <= 20)
        SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first, word) AS place, word, n FROM b WHERE word NOT IN ({_STOP}) AND length(word) > 2 QUALIFY place <= 5""",
    "cluster_representatives": f"""WITH {_PARTS}, c AS (SELECT label, i, avg(x) AS c FROM p GROUP BY 1, 2), d AS (SELECT label, vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM p JOIN c USING (label, i) GROUP BY 1, 2)
        SELECT label AS cluster, vec_id, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, vec_id) = 1""",
    "cluster_sizes": """WITH c AS (SELECT n_chars, count(*) AS n FROM documents GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_rows, count_if(n >= 2)::BIGINT AS num_clusters, count_if(n < 2)::BIGINT AS outlier_count, round(sum(n) / count_if(n >= 2), 1) AS avg_cluster_size,
        round(max(n) / sum(n), 4) AS largest_cluster_ratio, round(1 - sum(CASE WHEN n >= 2 THEN n * n END) / (sum(n) * sum(n)), 4) AS simpson FROM c""",
    "label_silhouettes": f"""WITH {_PARTS}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum((a.x - b.x) * (a.x - b.x)) AS d, count(DISTINCT b.vec_id) AS n FROM p a JOIN p b ON a.i = b.i GROUP BY 1, 2, 3),
        s AS (SELECT vec_id, label, max(CASE WHEN other = label THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN d / n END) AS b FROM d GROUP BY 1, 2)
        SELECT label AS cluster, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY 1""",
}
