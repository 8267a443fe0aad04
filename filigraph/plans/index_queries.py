"""Driver queries over stored indexes, and their SQL. Each builds its index in the work folder first, so that its whole work counts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from filigraph.operators import extraction, lexicon_table, retrieval, vector_index
from filigraph.operators.lexicon_table import LexiconTable
from filigraph.plans.queries import _DOT, BATCH_SQL, KEYWORD_SQL, LEXICON, OBJECTIVE_SQL, _docs, _table
from filigraph.work import new_path


def _index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    path = new_path(spark, "vector_index")
    vector_index.build_index(_table(spark, sf_dir, "embeddings"), path, sort=["label"])
    return vector_index.open_index(spark, path)


def _asked(spark: SparkSession, sf_dir: str):
    return _table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


def vector_index_topk(spark, sf_dir):
    """Every 50th vector against all cells: exact."""
    return vector_index.search_each(_index(spark, sf_dir), _asked(spark, sf_dir), 10, exhaustive=True)


def vector_index_filtered(spark, sf_dir):
    """The same among the rows of one label, which the files are sorted by."""
    return vector_index.search_each(_index(spark, sf_dir), _asked(spark, sf_dir), 10, where=F.col("label") == 3, exhaustive=True)


FILTERED_SQL = BATCH_SQL.replace("WHERE q.vec_id % 50 = 0", "WHERE q.vec_id % 50 = 0 AND e.label = 3")


def vector_index_probe(spark, sf_dir):
    """The same with as many probes as the index measured for itself."""
    return vector_index.search_each(_index(spark, sf_dir), _asked(spark, sf_dir), 10)


def vector_index_recall(spark, sf_dir):
    """One row: how many queries there were, and whether the probed cells gave at least nine tenths of what an exact search gives."""
    exact = retrieval.nearest_to_each(_table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10)
    found = vector_index.recall(vector_index_probe(spark, sf_dir), exact)
    return _asked(spark, sf_dir).agg(F.count(F.lit(1)).alias("queries")).withColumn("enough", F.lit(found >= 0.9))


RECALL_SQL = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0"


def vector_index_of_one(spark, sf_dir):
    """One query over an index with a part appended, all cells."""
    path = new_path(spark, "vector_index")
    vectors = _table(spark, sf_dir, "embeddings")
    vector_index.build_index(vectors.where("vec_id % 3 > 0"), path, sort=["label"])
    vector_index.append(spark, path, vectors.where("vec_id % 3 = 0"))
    query = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    return vector_index.search(vector_index.open_index(spark, path), query, 10, where=F.col("label") == 3, exhaustive=True).select("vec_id", "label", "score")


ONE_SQL = f"SELECT e.vec_id, e.label, {_DOT.format('e', 'q')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = 3 ORDER BY score DESC, vec_id LIMIT 10"

# --- lexicons as tables -----------------------------------------------------------------------------


def keyword_extraction_by_table(spark, sf_dir):
    """The keyword rules with the keywords in a table."""
    r = extraction.extract(_docs(spark, sf_dir), LexiconTable.of(spark, LEXICON))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|").alias(c.lower())
    return r.select(F.col("Company.ticker").cast("bigint").alias("doc_id"), names("Capability").alias("capabilities"), names("RiskTheme").alias("risks"), names("Initiative").alias("initiatives"))


def objective_sentences_by_table(spark, sf_dir):
    r = extraction.extract(_docs(spark, sf_dir), LexiconTable.of(spark, LEXICON))
    rows = r.select(F.col("Company.ticker").cast("bigint").alias("doc_id"), F.posexplode("StrategicObjective").alias("place", "o"))
    return rows.select("doc_id", "place", "o.objective_type", "o.text")


def keywords_of_a_table(spark, sf_dir):
    """All words of the benchmark's items as keywords, each found in all documents: how many a document has, and where the first of them are."""
    items = _table(spark, sf_dir, "benchmark")
    words = items.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))).alias("keyword")).where(F.length("keyword") >= 5).distinct()
    rows = words.select(F.lit("word").alias("kind"), F.substring("keyword", 1, 1).alias("category"), F.ascii("keyword").alias("category_place"), "keyword", F.lit(0).alias("place"))
    hits = lexicon_table.finder(rows)(F.lower("text"))
    found = _docs(spark, sf_dir).select("doc_id", F.coalesce(hits, F.array()).alias("h"))
    places = F.array_join(F.transform("h", lambda x: F.concat_ws("@", x["keyword"], x["at"])), "|")
    return found.select("doc_id", F.size("h").cast("bigint").alias("found"), F.md5(places).alias("places"))


TABLE_SQL = """WITH k AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 5),
h AS (SELECT doc_id, w, strpos(lower(text), w) - 1 AS pos FROM documents, k WHERE contains(lower(text), w)),
g AS (SELECT doc_id, count(*) AS found, string_agg(w || '@' || pos, '|' ORDER BY w) AS places FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(found, 0) AS found, md5(coalesce(places, '')) AS places FROM documents LEFT JOIN g USING (doc_id)"""

SPECS = {
    f.__name__: (f, sql)
    for f, sql in ((vector_index_topk, BATCH_SQL), (vector_index_filtered, FILTERED_SQL), (vector_index_probe, None), (vector_index_recall, RECALL_SQL), (vector_index_of_one, ONE_SQL),
        (keyword_extraction_by_table, KEYWORD_SQL), (objective_sentences_by_table, OBJECTIVE_SQL), (keywords_of_a_table, TABLE_SQL))
}
