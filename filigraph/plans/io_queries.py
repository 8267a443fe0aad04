"""Driver queries of sources, sinks, ingest, model back ends and composed views, each with its SQL.

Files go to the shared work folder and are read back by the engine's own readers. Model back ends are deterministic stand-ins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigraph import schemas
from filigraph.functions import text as tx
from filigraph.functions.vectors import normalised
from filigraph.operators import answers, chunking, extraction, graph as graphs, retrieval
from filigraph.plans import build
from filigraph.plans.ask import AskConfig, ask
from filigraph.plans.queries import CHUNK_CTE, GRAPH_CTE, INSIDE_CTE, KG_EDGES_SQL, KG_NODES_SQL, LEXICON, REC_CTE, TRIPLET_SQL, _docs, _records, _seeds, _table, star_graph
from filigraph.sources import fetch, readers, sinks
from filigraph.work import new_path

# --- files -----------------------------------------------------------------------------------------


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as ticker: few files, each with many texts."""
    return _table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("ticker"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def filing_manifest(spark, sf_dir):
    """A manifest of the suppliers, written as CSV and read as one; the addresses of each filing."""
    path = new_path(spark, "manifest")
    s = _table(spark, sf_dir, "supplier")
    name = F.concat(F.lit('"'), F.lower("s_name"), F.lit(', x".htm'))
    rows = s.select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.format_string("%010d-24-%06d", "s_suppkey", "s_nationkey").alias("accession"), name.alias("filename"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return readers.filing_list(spark, path).select("*", readers.filing_url("https://files.example").alias("url"))


MANIFEST_SQL = """WITH f AS (SELECT 'S' || s_suppkey AS ticker, printf('%010d', s_suppkey) AS cik, printf('%010d-24-%06d', s_suppkey, s_nationkey) AS accession, '"' || lower(s_name) || ', x".htm' AS filename FROM supplier)
SELECT *, 'https://files.example/' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' || filename AS url FROM f"""


def section_store(spark, sf_dir):
    """Sections written in folders by ticker and read back."""
    path = new_path(spark, "sections")
    sinks.write_sections(_by_language(spark, sf_dir).select("ticker", "text"), path)
    return spark.read.schema(schemas.SECTION).parquet(path).select("ticker", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


SECTION_STORE_SQL = "SELECT coalesce(lang, 'none') AS ticker, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM documents"


def section_files(spark, sf_dir):
    """One text file a nation, of its customers' names, found again by file name."""
    path = new_path(spark, "section_files")
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ticker"), F.concat(F.lit("Cust 'é' "), "c_name", F.lit("\n"), "c_mktsegment").alias("text"))
    written = sinks.write_section_files(rows, path).agg(F.sum("rows").alias("n")).first()["n"]
    return readers.sections(spark, path).select("ticker", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"), F.lit(written).alias("written"))


SECTION_FILES_SQL = """WITH t AS (SELECT 'N' || c_nationkey AS ticker, string_agg('Cust ''é'' ' || c_name || chr(10) || c_mktsegment, chr(10) ORDER BY 'Cust ''é'' ' || c_name || chr(10) || c_mktsegment) AS text FROM customer GROUP BY c_nationkey)
SELECT ticker, md5(text) AS digest, length(text) AS chars, (SELECT count(*) FROM customer) AS written FROM t"""


def _languages_chunked(spark, sf_dir):
    chunks = chunking.chunk(_by_language(spark, sf_dir), "doc_id")
    langs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("ticker"))
    return chunks.join(langs, "doc_id").select(*[x.split()[0] for x in schemas.CHUNK.split(", ")])


def chunk_store(spark, sf_dir):
    """Chunks written as JSON lines in folders by ticker and read back."""
    path = new_path(spark, "chunks")
    sinks.write_chunks(_languages_chunked(spark, sf_dir), path, "json")
    return _chunk_digests(spark.read.schema(schemas.CHUNK).json(path))


def chunk_files(spark, sf_dir):
    """Chunk files, one JSON array a ticker: all of them, read as one corpus."""
    path = new_path(spark, "chunk_files")
    sinks.write_chunk_files(_languages_chunked(spark, sf_dir), path).count()
    return _chunk_digests(readers.chunks(spark, path))


def chunk_file_of_one(spark, sf_dir):
    """Of the same files only that of one ticker; one that is not there gives no rows."""
    path = new_path(spark, "chunk_files")
    sinks.write_chunk_files(_languages_chunked(spark, sf_dir), path).count()
    return _chunk_digests(readers.chunks(spark, path, "en").unionByName(readers.chunks(spark, path, "no such")))


def _chunk_digests(chunks):
    return chunks.select("chunk_id", "ticker", "section", "page_estimate", "start_word", "end_word", F.md5("text").alias("digest"))


_CHUNK_ROWS = CHUNK_CTE + "SELECT chunk_id, coalesce(lang, 'none') AS ticker, 'Item 1' AS section, page_estimate, start_word, end_word, md5(chunks.text) AS digest FROM chunks JOIN documents USING (doc_id)"
ONE_CHUNK_FILE_SQL = f"SELECT * FROM ({_CHUNK_ROWS}) WHERE ticker = 'en'"


def _placed(table, *order):
    """The rows with their place within their document, by the order of the files."""
    doc = F.split("id" if "id" in table.columns else "src", ":")[1]
    return table.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("ord", *order)))


def graph_file_nodes(spark, sf_dir):
    """Nodes through the CSV files, in order: records in JSON, then both files, then their readers."""
    return _placed(_built(spark, sf_dir)[0]).select("id", "label", "ticker", "name", "text", "objective_type", "status", "risk_category", "place")


def graph_file_edges(spark, sf_dir):
    return _placed(_built(spark, sf_dir)[1]).select("src", "dst", "rel", "place")


def _built(spark, sf_dir, path=None):
    companies = _docs(spark, sf_dir).select("ticker", F.concat(F.lit('Doc "'), "ticker", F.lit('"')).alias("name"))
    return build.build_all(_docs(spark, sf_dir), path or new_path(spark, "graph_files"), LEXICON, companies.where(F.col("ticker").cast("long") % 2 == 0))


GRAPH_NODES_SQL = f"""SELECT id, label, CASE WHEN label = 'Company' THEN split_part(id, ':', 2) END AS ticker,
  CASE WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 2 = 0 AND label = 'Company' THEN 'Doc "' || split_part(id, ':', 2) || '"' ELSE nullif(trim(name, E' \n\t\r'), '') END AS name,
  text, objective_type, status, risk_category, CAST(row_number() OVER (PARTITION BY split_part(id, ':', 2) ORDER BY ord, id) AS INT) AS place FROM ({KG_NODES_SQL})"""
GRAPH_EDGES_SQL = f"SELECT src, dst, rel, CAST(row_number() OVER (PARTITION BY split_part(src, ':', 2) ORDER BY ord, src, dst) AS INT) AS place FROM ({KG_EDGES_SQL})"


def record_files(spark, sf_dir):
    """Nested records written as JSON and read back."""
    path = new_path(spark, "records")
    sinks.write_records(_records(spark, sf_dir), path)
    r = readers.records(spark, path, lines=True)
    texts = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return r.select(F.col("Company.ticker").alias("ticker"), F.md5("Mission.text").alias("mission"), F.md5(texts("StrategicObjective", "text")).alias("objectives"), texts("Capability", "name").alias("capabilities"), texts("RiskTheme", "risk_category").alias("risks"), F.size("Edges").alias("edges"))


RECORD_SQL = REC_CTE + """SELECT CAST(doc_id AS VARCHAR) AS ticker, md5(mission) AS mission, md5(array_to_string(list_transform(objectives, lambda o: o.text), '|')) AS objectives, array_to_string(capabilities, '|') AS capabilities,
  array_to_string(list_transform(risks, lambda r: r.risk_category), '|') AS risks,
  CAST(CAST(mission IS NOT NULL AS INT) + len(objectives) + len(capabilities) * (1 + CAST(len(objectives) > 0 AS INT)) + len(initiatives) * (1 + CAST(len(capabilities) > 0 AS INT)) + len(risks) AS INT) AS edges FROM rec"""


def missing_sources(spark, sf_dir):
    """Each source read where it is and where nothing is: rows, none, and the columns of both."""
    here, gone = new_path(spark, "here"), new_path(spark, "gone")
    names = _table(spark, sf_dir, "customer").select(F.concat(F.lit("N/"), F.col("c_nationkey").cast("string")).alias("ticker"), F.col("c_name").alias("text"))
    sinks.write_section_files(names, f"{here}/sections").count()
    sinks.write_chunk_files(_languages_chunked(spark, sf_dir), f"{here}/chunks").count()
    _built(spark, sf_dir, f"{here}/graph")
    read = {
        "sections": (readers.sections, "sections"), "chunks": (readers.chunks, "chunks"), "nodes": (readers.nodes, "graph/nodes.csv"),
        "edges": (readers.edges, "graph/edges.csv"), "records": (lambda s, p: readers.records(s, p, lines=True), "graph/records"),
    }
    parts = []
    for name, (reader, path) in read.items():
        there, absent = reader(spark, f"{here}/{path}"), reader(spark, f"{gone}/{path}")
        both = there.select(F.lit(1).alias("n"), F.lit(0).alias("none")).unionAll(absent.select(F.lit(0), F.lit(1)))
        columns = F.lit(len(there.columns) if there.columns == absent.columns else -1)
        parts.append(both.agg(F.sum("n").alias("n"), F.sum("none").alias("missing")).select(F.lit(name).alias("source"), "n", "missing", columns.alias("columns")))
    return reduce(DataFrame.unionByName, parts)


MISSING_SQL = f"""SELECT 'sections' AS source, count(DISTINCT c_nationkey) AS n, 0::BIGINT AS missing, 2 AS columns FROM customer
UNION ALL SELECT 'chunks', count(*), 0, 7 FROM ({CHUNK_CTE} SELECT * FROM chunks) UNION ALL SELECT 'nodes', count(*), 0, 10 FROM ({KG_NODES_SQL})
UNION ALL SELECT 'edges', count(*), 0, 4 FROM ({KG_EDGES_SQL}) UNION ALL SELECT 'records', count(*), 0, 7 FROM ({REC_CTE} SELECT * FROM rec)"""


def _supplier_page(url: str) -> str:
    """A stand-in for a host: some addresses fail in their plain form, some in both."""
    parts = url.split("/")
    key = int(parts[-3])
    if key % 10 == 3 and (key % 20 == 3 or not parts[-3].startswith("0")):
        raise OSError(f"no page {key}")
    return f"<title>x</title><p>ITEM 1. BUSINESS</p><p>{'word ' * (key * 37 % 1500)}</p><p>Item 2. Properties</p>"


def _filings(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.lit("1-24-5").alias("accession"), F.lit("f.htm").alias("filename"))


def download_status(spark, sf_dir):
    """The plain address, then the padded one, then the row's error."""
    d = fetch.download(_filings(spark, sf_dir), _supplier_page)
    return d.select("ticker", "status", F.length("html").cast("bigint").alias("chars"), "error")


_FAILS = "(s_suppkey % 20 = 3)"
DOWNLOAD_SQL = f"""SELECT 'S' || s_suppkey AS ticker, CASE WHEN {_FAILS} THEN 'FAILED' ELSE 'OK' END AS status,
  CASE WHEN NOT {_FAILS} THEN CAST(length('<title>x</title><p>ITEM 1. BUSINESS</p><p>') + 5 * (s_suppkey * 37 % 1500) + length('</p><p>Item 2. Properties</p>') AS BIGINT) END AS chars, CASE WHEN {_FAILS} THEN 'no page ' || s_suppkey END AS error FROM supplier"""


def ingest_run(spark, sf_dir):
    """Download, sections, chunks, their tables and the run's report lines."""
    run = build.ingest(_filings(spark, sf_dir), _supplier_page, new_path(spark, "ingest"))
    lines = fetch.summary_lines(run.summary).select("line")
    return lines


_SECTION_CHARS = "(length('ITEM 1. BUSINESS') + CASE WHEN w > 0 THEN 5 * w ELSE 0 END + CASE WHEN NOT with_end THEN 1 + length('Item 2. Properties') ELSE 0 END)"
INGEST_RUN_SQL = f"""WITH f AS (SELECT s_suppkey, s_suppkey * 37 % 1500 AS w FROM supplier),
g AS (SELECT *, 5 * w + 17 + CASE WHEN w > 0 THEN 0 ELSE 0 END > 100 AS with_end FROM f),
c AS (SELECT s_suppkey, {_SECTION_CHARS} AS chars, w + 3 + CASE WHEN with_end THEN 0 ELSE 3 END AS words FROM g)
SELECT CASE WHEN s_suppkey % 20 = 3 THEN 'S' || s_suppkey || ': FAILED - no page ' || s_suppkey
  ELSE 'S' || s_suppkey || ': ' || format('{{:,}}', chars) || ' chars, ' || CAST(greatest(0, ceil((words - 512) / 448.0)) + 1 AS BIGINT) || ' chunks' END AS line FROM c"""

# --- models ----------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _load_letters():
    """A stand-in for an embedding model: how often each letter occurs."""
    return lambda texts: np.array([[t.lower().count(c) for c in _LETTERS] for t in texts], np.float64)


def _no_model():
    raise RuntimeError("no such model")


def model_embed_topk(spark, sf_dir):
    """Embedding by a model whose first back end doesn't load, and the items nearest to a question's vector."""
    embedder = retrieval.ModelEmbedder(retrieval.first_that_loads(_no_model, _load_letters))
    items = embedder.embed(_table(spark, sf_dir, "benchmark"))
    asked = embedder.embed(spark.createDataFrame([("Where is the quick zebra?",)], "text string")).first()["embedding"]
    return retrieval.nearest(items, list(asked), 10, "item_id").select("item_id", "score")


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({text})) - length(replace(lower({text}), '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"


_COSINE = "round(list_inner_product(v, q) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(q, q)), 6)"
MODEL_EMBED_SQL = f"""WITH i AS (SELECT item_id, {_letters_sql("coalesce(text, '')")} AS v, {_letters_sql("'Where is the quick zebra?'")} AS q FROM benchmark)
SELECT item_id, {_COSINE} AS score FROM i ORDER BY score DESC, item_id LIMIT 10"""


def vectors_normalised(spark, sf_dir):
    """The index table: vectors of length one, whatever their length was."""
    long = _table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)))
    return retrieval.index(long).select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("embedding").alias("width"))


NORMALISED_SQL = """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 2)) AS e, len(embedding) AS width FROM embeddings)
SELECT vec_id, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first, round(list_sum(e) / sqrt(list_inner_product(e, e)), 6) AS total, CAST(width AS INT) AS width FROM v"""


def _answer_of(prompt: str) -> str:
    """A stand-in for a language model that gives a record for some texts, fails for others and answers the rest in prose."""
    words = prompt.split("\n\n", 1)[1].split()
    if len(words) % 3 == 0:
        raise RuntimeError("overloaded")
    return "I can't." if len(words) % 3 == 1 else f'Sure: {{"Mission": {{"text": "{len(words)} words"}}, "RiskTheme": [{{"name": "model", "risk_category": "macro"}}]}} Bye.'


def model_records(spark, sf_dir):
    """Records of a model where it gives one, else of the rules."""
    told = extraction.ModelExtractor(lambda: _answer_of).extract(_docs(spark, sf_dir))
    r = extraction.extract(told, LEXICON)
    return r.select("Company.ticker", F.md5("Mission.text").alias("mission"), F.coalesce(F.size("RiskTheme"), F.lit(0)).alias("risks"), F.size("Edges").alias("edges"))


MODEL_RECORD_SQL = REC_CTE + r""", w AS (SELECT doc_id, least(3000, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS ticker, md5(CASE WHEN n % 3 = 2 THEN n || ' words' ELSE mission END) AS mission, CAST(CASE WHEN n % 3 = 2 THEN 1 ELSE len(risks) END AS INT) AS risks,
  CAST(CASE WHEN n % 3 = 2 THEN 2 ELSE CAST(mission IS NOT NULL AS INT) + len(objectives) + len(capabilities) * (1 + CAST(len(objectives) > 0 AS INT)) + len(initiatives) * (1 + CAST(len(capabilities) > 0 AS INT)) + len(risks) END AS INT) AS edges
FROM rec JOIN w USING (doc_id)"""


def prompt_texts(spark, sf_dir):
    """What a language model would be asked about each item, and its answer cut to whole sentences."""
    name, text = F.concat(F.lit("Item "), F.col("item_id").cast("string")), F.coalesce("text", F.lit(""))
    asked = answers.prompt(F.lit("Why?"), name, F.lit("N/A"), F.lit("Strong"), text, F.lit("none"))
    replied = answers.ModelAnswerer(lambda: lambda p: None if len(p) % 2 else p[-60:] + " And th").answer(asked)
    return _table(spark, sf_dir, "benchmark").select("item_id", F.md5(asked).alias("prompt"), answers.chosen_answer(replied, F.lit("fallback")).alias("answer"))


_PROMPT = """'Answer the question from the evidence and the graph alone. Cite passages by number and say what is missing.' || E'\\n\\nCompany: Item ' || item_id || E'\\nMission: N/A\\nAlignment: Strong\\n\\nEvidence:\\n' || coalesce(text, '') || E'\\n\\nGraph:\\nnone\\n\\nQuestion: Why?'"""
PROMPT_SQL = f"""WITH p AS (SELECT item_id, {_PROMPT} AS p FROM benchmark), a AS (SELECT *, CASE WHEN length(p) % 2 = 0 THEN trim(substr(p, length(p) - 59) || ' And th', E' \n\t\r') END AS a FROM p),
k AS (SELECT *, length(a) - strpos(reverse(a), '.') + 1 AS stop FROM a)
SELECT item_id, md5(p) AS prompt, coalesce(CASE WHEN contains(a, '.') AND stop - 1 > length(a) * 0.5 THEN substr(a, 1, stop) ELSE a END, 'fallback') AS answer FROM k"""


def question_topics(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.topic(F.concat(F.lit(" What is the "), F.coalesce("text", F.lit("")), F.lit("? "))).alias("topic"))


TOPIC_SQL = "SELECT conv_id, turn, trim(replace(replace(lower(' What is the ' || coalesce(text, '') || '? '), 'what is the', ''), 'what are the', ''), E' \\n\\t\\r') AS topic FROM conversations"

# --- composed views ----------------------------------------------------------------------------------


def triplet_listing(spark, sf_dir):
    """The plain listing that stands in for a drawing: sides cut to 60 characters."""
    g = star_graph(spark, sf_dir, write=True)
    return graphs.triplets(g, graphs.induced(g, _seeds(spark, sf_dir))[1], 60)


LISTING_SQL = TRIPLET_SQL.replace(", 1, 80)", ", 1, 60)")


def profile_views(spark, sf_dir):
    """The overview of each nation: curated missions of some, lists for display."""
    seeds = _table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("seed"))
    companies = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ticker"), "n_name", F.when(F.col("n_regionkey") < 3, F.concat(F.lit("Serve "), "n_name")).alias("mission")).withColumnRenamed("n_name", "name")
    v = graphs.profile_view(star_graph(spark, sf_dir), seeds, companies)
    return v.select("ticker", "name", "nodes", "edges", "mission", F.array_join("capabilities", "|").alias("capabilities"), F.size("objectives").alias("objectives"), F.md5(F.array_join("risks", "|")).alias("risks"))


PROFILE_SQL = GRAPH_CTE + """
, h AS (SELECT n_nationkey AS k, n_name, n_regionkey, ord, dst, label, array_to_string(list_transform(regexp_extract_all(lower(shown), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || substr(x, 2)), '') AS item
  FROM nation JOIN edges ON src = 'Nation:' || n_nationkey JOIN d ON id = dst)
SELECT CAST(k AS VARCHAR) AS ticker, any_value(n_name) AS name, count(*) + 1 AS nodes, count(*) AS edges, CASE WHEN any_value(n_regionkey) < 3 THEN 'Serve ' || any_value(n_name) ELSE '' END AS mission,
  coalesce(string_agg(item, '|' ORDER BY ord, dst) FILTER (label = 'Capability'), '') AS capabilities, 0 AS objectives, md5(coalesce(string_agg(item, '|' ORDER BY ord, dst) FILTER (label = 'RiskTheme'), '')) AS risks FROM h GROUP BY k"""


class LetterEmbedder:
    """Counts of letters at length one, as expressions."""

    def embed(self, texts: DataFrame) -> DataFrame:
        low = F.lower(F.coalesce("text", F.lit("")))
        counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS])
        return texts.withColumn("embedding", F.explode(F.array(counts))).withColumn("embedding", normalised(F.col("embedding")))


def _asked(spark, sf_dir):
    """A question to one document as the company, over the chunks and the graph of all documents."""
    docs = _docs(spark, sf_dir)
    embedder = LetterEmbedder()
    records = extraction.extract(docs, LEXICON)
    g = graphs.load(extraction.nodes(records), extraction.edges(records))
    companies = docs.select("ticker", F.concat(F.lit("Document "), "ticker").alias("name"), F.lit("").alias("mission"), F.lit("Moderate").alias("alignment_label"))
    return ask("What is the tion of the erinth?", "1", embedder.embed(chunking.chunk(docs, "ticker")), embedder, g, companies, AskConfig(mode="pre"))


def ask_hybrid(spark, sf_dir):
    found = _asked(spark, sf_dir)
    spans = F.array_join(F.transform("evidence_spans", lambda s: F.concat_ws("~", s["chunk_id"], s["page"].cast("string"), s["confidence"].cast("string"), s["text"])), "|")
    paths = F.array_join(F.transform("kg_paths", lambda p: F.concat_ws("~", p["path"], p["description"])), "|")
    return found.select("question", "company", "answer", F.size("evidence_spans").alias("spans"), F.md5(spans).alias("spans_digest"), F.size("kg_paths").alias("paths"), F.md5(paths).alias("paths_digest"), F.array_join("pipeline_steps", ", ").alias("steps"))


def question_view(spark, sf_dir):
    """What the page of the same answer shows: shorter spans, the first eight paths."""
    v = answers.question_view(_asked(spark, sf_dir))
    return v.select("question", F.array_join(F.transform("spans", lambda s: F.concat_ws("~", s["place"], s["confidence"], s["text"])), "|").alias("spans"), F.array_join(F.transform("paths", lambda p: p["path"]), "|").alias("paths"))


_WANT = "['what', 'is', 'the', 'tion', 'of', 'erinth?']"
_TOPIC_SCORE = "CASE WHEN contains(lower(shown), 'tion of the erinth?') THEN 0.9 WHEN contains(lower(shown), 'tion') OR contains(lower(shown), 'of') OR contains(lower(shown), 'the') OR contains(lower(shown), 'erinth?') THEN 0.7 ELSE 0.5 END"
ASK_CTE = CHUNK_CTE + REC_CTE.replace("\nWITH rec", "\n, rec", 1) + f"""
, hits AS (SELECT chunk_id, page_estimate, text, round(list_inner_product(v, q) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(q, q)), 6) AS score,
    len(list_intersect({_WANT}, list_distinct(regexp_split_to_array(lower(text), '\\s+')))) / 6.0 AS again
  FROM (SELECT *, {_letters_sql('text')} AS v, {_letters_sql("'What is the tion of the erinth?'")} AS q FROM chunks WHERE doc_id = 1) ORDER BY score DESC, chunk_id LIMIT 10),
placed AS (SELECT *, row_number() OVER (ORDER BY again DESC, score DESC, chunk_id) AS place FROM hits),
raw_nodes AS (SELECT * FROM ({KG_NODES_SQL.replace(REC_CTE, '', 1).strip().removeprefix(',').strip().join(['WITH ', '']) if KG_NODES_SQL.replace(REC_CTE, '', 1).strip().startswith(',') else KG_NODES_SQL.replace(REC_CTE, '', 1)})),
raw_edges AS (SELECT * FROM ({KG_EDGES_SQL.replace(REC_CTE, '', 1).strip().removeprefix(',').strip().join(['WITH ', '']) if KG_EDGES_SQL.replace(REC_CTE, '', 1).strip().startswith(',') else KG_EDGES_SQL.replace(REC_CTE, '', 1)})),
d AS (SELECT id, max_by(label, ord) AS label, coalesce(nullif(max_by(text, ord) FILTER (text IS NOT NULL), ''), nullif(max_by(name, ord) FILTER (name IS NOT NULL), ''), '') AS shown FROM raw_nodes WHERE split_part(id, ':', 2) = '1' GROUP BY id),
edges AS (SELECT src, dst, max_by(rel, ord) AS rel, min(ord) AS ord FROM raw_edges WHERE split_part(src, ':', 2) = '1' GROUP BY src, dst),
h1 AS (SELECT dst AS n1, rel AS e1, ord AS o1 FROM edges WHERE src = 'Company:1'),
h2 AS (SELECT h1.*, dst AS n2, rel AS e2, ord AS o2 FROM h1 JOIN edges ON src = n1 WHERE dst <> 'Company:1'),
h3 AS (SELECT h2.*, dst AS n3, rel AS e3, ord AS o3 FROM h2 JOIN edges ON src = n2 WHERE dst <> 'Company:1' AND dst <> n1),
found AS (SELECT 1 AS branch, o1, NULL AS o2, n1 AS node_id, label, shown, CAST({_TOPIC_SCORE} AS DOUBLE) AS score FROM h1 JOIN d ON id = n1
  UNION ALL SELECT 2, o1, o2, n2, label, shown, 0.4 FROM h2 JOIN d ON id = n2),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, branch, o1, o2 NULLS FIRST, node_id) AS place FROM found),
paths AS (SELECT o1, NULL AS o2, NULL AS o3, 'Company:1 →[' || e1 || ']→ ' || label AS path, shown AS description FROM h1 JOIN d ON id = n1
  UNION ALL SELECT o1, o2, NULL, 'Company:1 → ' || a.label || ' → ' || b.label, e1 || ' → ' || e2 FROM h2 JOIN d a ON a.id = n1 JOIN d b ON b.id = n2
  UNION ALL SELECT o1, o2, o3, 'Company:1 → ' || a.label || ' → ' || b.label || ' → ' || c.label, e1 || ' → ' || e2 || ' → ' || e3 FROM h3 JOIN d a ON a.id = n1 JOIN d b ON b.id = n2 JOIN d c ON c.id = n3)"""
ASK_SQL = ASK_CTE + """
SELECT 'What is the tion of the erinth?' AS question, '1' AS company,
  concat_ws(chr(10) || chr(10), '**Document 1** (Moderate)' || chr(10) || chr(10) || '**Mission:** ' || chr(10),
    '**Key Findings from 10-K:**' || chr(10) || chr(10) || (SELECT string_agg(place || '. ' || trim(substr(text, 1, 250), E' \\n\\t\\r'), chr(10) || chr(10) ORDER BY place) FROM placed WHERE place <= 4),
    chr(10) || '**Knowledge Graph Insights:**' || chr(10) || chr(10) || (SELECT string_agg('- **' || label || '**: ' || substr(shown, 1, 150), chr(10) || chr(10) ORDER BY place) FROM top WHERE place <= 4)) AS answer,
  CAST((SELECT count(*) FROM placed WHERE place <= 5) AS INT) AS spans,
  md5((SELECT string_agg(chunk_id || '~' || page_estimate || '~' || CAST(round(score, 2) AS VARCHAR) || '~' || substr(text, 1, 300), '|' ORDER BY place) FROM placed WHERE place <= 5)) AS spans_digest,
  CAST((SELECT count(*) FROM paths) AS INT) AS paths, md5((SELECT string_agg(path || '~' || description, '|' ORDER BY o1, coalesce(o2, -1), coalesce(o3, -1), path, description) FROM paths)) AS paths_digest,
  'Vector Retrieval, Graph Retrieval, Reranker, KG-RAG Reasoner' AS steps"""
VIEW_SQL = ASK_CTE + """
SELECT 'What is the tion of the erinth?' AS question,
  (SELECT string_agg('10-K Item 1, page ' || page_estimate || '~' || CAST(round_even(round(score, 2) * 100, 0) AS INT) || '%~' || CASE WHEN length(substr(text, 1, 300)) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, '|' ORDER BY place) FROM placed WHERE place <= 5) AS spans,
  (SELECT string_agg(path, '|' ORDER BY nth) FROM (SELECT path, row_number() OVER (ORDER BY o1, coalesce(o2, -1), coalesce(o3, -1), path, description) AS nth FROM paths) WHERE nth <= 8) AS paths"""

SPECS = {
    f.__name__: (f, sql)
    for f, sql in (
        (filing_manifest, MANIFEST_SQL), (section_store, SECTION_STORE_SQL), (section_files, SECTION_FILES_SQL), (chunk_store, _CHUNK_ROWS), (chunk_files, _CHUNK_ROWS), (chunk_file_of_one, ONE_CHUNK_FILE_SQL),
        (graph_file_nodes, GRAPH_NODES_SQL), (graph_file_edges, GRAPH_EDGES_SQL), (record_files, RECORD_SQL), (missing_sources, MISSING_SQL), (download_status, DOWNLOAD_SQL), (ingest_run, INGEST_RUN_SQL),
        (model_embed_topk, MODEL_EMBED_SQL), (vectors_normalised, NORMALISED_SQL), (model_records, MODEL_RECORD_SQL), (prompt_texts, PROMPT_SQL), (question_topics, TOPIC_SQL),
        (triplet_listing, LISTING_SQL), (profile_views, PROFILE_SQL), (ask_hybrid, ASK_SQL), (question_view, VIEW_SQL),
    )
}
