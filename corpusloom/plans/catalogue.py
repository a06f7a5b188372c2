"""Registered queries on the driver tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.functions import values as V
from corpusloom.operators import blocks as B
from corpusloom.operators import dialogue as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import graph as G
from corpusloom.operators import ordering as O
from corpusloom.operators import registry as RG
from corpusloom.operators import rerank as RR
from corpusloom.operators import retrieval as R
from corpusloom.operators import sequences as S
from corpusloom.plans.runtime import read, scratch, ship, spread
from corpusloom.sources import archives as A
from corpusloom.sources import html as H
from corpusloom.sources import papers as P
from corpusloom.streaming import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries: every vector whose id is divisible by 100."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, e.vec_id, label, list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]) AS sim FROM q, embeddings e WHERE {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= {k})
"""


# ---- retrieval


@query(_KNN.format(where="label <> 3", k=5) + "SELECT query_id, vec_id, rank::INT AS rank, round(sim, 3) AS similarity, round(exp(sim) / sum(exp(sim)) OVER (PARTITION BY query_id), 3) AS probability FROM t")
def knn_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 with a metadata filter, softmax probabilities."""
    return R.with_probabilities(R.knn(_queries(spark, sf_dir), read(spark, sf_dir, "embeddings"), 5, [B.Filter("label", "ne", 3)]))


@query("""
WITH d AS (SELECT vec_id, label, quality FROM embeddings LEFT JOIN labels ON vec_id = doc_id)
SELECT 'eq' AS kind, count(*) AS n FROM d WHERE quality = 1
UNION ALL SELECT 'ne', count(*) FROM d WHERE quality IS DISTINCT FROM 1
UNION ALL SELECT 'range', count(*) FROM d WHERE label >= 2 AND label < 7
UNION ALL SELECT 'and', count(*) FROM d WHERE label > 2 AND label <= 5 AND quality IS DISTINCT FROM 0
UNION ALL SELECT 'none', count(*) FROM d""")
def knn_filter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter kind over vectors with optional metadata."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    d = read(spark, sf_dir, "embeddings").select("vec_id", "label").join(labels, "vec_id", "left")
    f = B.Filter
    cases = {"eq": [f("quality", "eq", 1)], "ne": [f("quality", "ne", 1)], "range": [f("label", "gte", 2), f("label", "lt", 7)], "and": [f("label", "gt", 2), f("label", "lte", 5), f("quality", "ne", 0)], "none": []}
    counted = d.agg(*[F.count_if(F.coalesce(c, F.lit(False)) if (c := B.compile_filters(v)) is not None else F.lit(True)).alias(k) for k, v in cases.items()])
    return counted.unpivot([], list(cases), "kind", "n")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]) AS sim,
  len(list_filter(list_zip(qv, embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS dist FROM q, embeddings),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM s QUALIFY n <= 30)
SELECT query_id, vec_id, round(sim, 3) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INT AS rank FROM c QUALIFY rank <= 10""")
def knn_quantized_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-bit candidates, three times as many as wanted, rescored exactly."""
    found = R.knn_quantized(_queries(spark, sf_dir), read(spark, sf_dir, "embeddings"), 10, 64, 3.0)
    return found.withColumn("similarity", F.round("similarity", 3))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]) AS sim,
  len(list_filter(list_zip(qv, embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS dist FROM q, embeddings WHERE query_id <> vec_id),
e AS (SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10),
p AS (SELECT f AS oversampling, query_id, vec_id, sim FROM s, (VALUES (1.0), (3.0), (5.0), (10.0)) o(f)
  QUALIFY row_number() OVER (PARTITION BY f, query_id ORDER BY dist, vec_id) <= 10 * f),
a AS (SELECT oversampling, query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY oversampling, query_id ORDER BY sim DESC, vec_id) <= 10)
SELECT oversampling::DOUBLE AS oversampling, round(count(e.vec_id) / count(*)::DOUBLE, 6) AS precision_at_10 FROM a LEFT JOIN e USING (query_id, vec_id) GROUP BY 1""")
def ann_precision_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the quantised path's ten that the exact path has, by oversampling."""
    vectors, queries = read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir)
    exact = R.knn(queries, vectors, 10, exclude_self=True).select("query_id", "vec_id", F.lit(1).alias("hit"))
    found = None
    for f in (1.0, 3.0, 5.0, 10.0):
        one = R.knn_quantized(queries, vectors, 10, 64, f, exclude_self=True).select(F.lit(f).alias("oversampling"), "query_id", "vec_id")
        found = one if found is None else found.unionByName(one)
    joined = found.join(exact, ["query_id", "vec_id"], "left")
    return joined.groupBy("oversampling").agg(F.round(F.count("hit") / F.count("*"), 6).alias("precision_at_10"))


@query("""
WITH h AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM h)
SELECT vec_id, len(v)::INT AS dimensions, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS last FROM n""")
def matryoshka_truncate_renormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 16 dimensions at length one."""
    d = read(spark, sf_dir, "embeddings").select("vec_id", V.truncate_and_normalize("embedding", 16).alias("v"))
    return d.select("vec_id", F.size("v").alias("dimensions"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"))


@query("""SELECT label, vec_id, round(exp(embedding[1]::DOUBLE) / sum(exp(embedding[1]::DOUBLE)) OVER (PARTITION BY label), 9) AS probability FROM embeddings""")
def score_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of a score within each label."""
    d = read(spark, sf_dir, "embeddings").withColumn("s", F.get("embedding", F.lit(0)).cast("double"))
    return d.select("label", "vec_id", F.round(V.softmax(F.col("s"), ["label"]), 9).alias("probability"))


@query(_KNN.format(where="e.vec_id <> query_id", k=10) + """,
rel AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1),
h AS (SELECT t.query_id, rank, row_number() OVER (PARTITION BY t.query_id ORDER BY rank) AS seen FROM t JOIN rel USING (query_id, vec_id)),
g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, sum(seen / rank::DOUBLE) AS ps, count(*) AS hits FROM h GROUP BY 1)
SELECT query_id, round(coalesce(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(relevant, 10) + 1)]), 0), 6) AS ndcg, round(coalesce(ps / least(relevant, 10), 0), 6) AS average_precision,
 round(coalesce(hits / relevant::DOUBLE, 0), 6) AS recall, round(coalesce(hits / 10.0, 0)::DOUBLE, 6) AS precision FROM n LEFT JOIN g USING (query_id)""")
def ndcg_map_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics at 10; vectors of the query's label are relevant."""
    vectors = read(spark, sf_dir, "embeddings")
    found = R.knn(_queries(spark, sf_dir), vectors, 10, exclude_self=True)
    own = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = vectors.select("vec_id", "label").join(F.broadcast(own), "label").where("vec_id <> query_id").select("query_id", "vec_id")
    m = RR.ranking_metrics(found, relevant, 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


# ---- blocks


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("-", "source", "doc_id").alias("document_title"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("section_title"), F.col("text").alias("content"), "lang", "source")


_BLOCKS = "b AS (SELECT doc_id, source || '-' || doc_id AS document_title, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS section_title, text AS content, lang, source FROM documents)"


@query(f"WITH {_BLOCKS} SELECT doc_id, CASE WHEN section_title = '' THEN document_title ELSE document_title || ' > ' || section_title END AS full_title, length(CASE WHEN section_title = '' THEN document_title ELSE document_title || ' > ' || section_title END || ' ' || content) AS combined_length FROM b")
def block_full_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full titles and the lengths of combined texts."""
    return _blocks(spark, sf_dir).select("doc_id", T.full_title("document_title", "section_title").alias("full_title"), F.length(T.combined_text("document_title", "section_title", "content")).cast("long").alias("combined_length"))


@query("""
WITH t AS (SELECT p_partkey, repeat(p_name || ' (' || p_brand || ') ', 3) || p_type AS s FROM part), h AS (SELECT p_partkey, left(s, 60) AS h FROM t)
SELECT p_partkey, CASE WHEN contains(right(h, 50), ')') THEN left(h, length(h) - instr(reverse(right(h, 50)), ')') + 1) ELSE h END AS title FROM h""")
def block_title_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cut after the last closing parenthesis near their end."""
    s = F.concat(F.repeat(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") ")), 3), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", T.truncate_string(s, 60).alias("title"))


@query("""
WITH s AS (SELECT doc_id, trim(regexp_extract(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '^[^\\n]*')) || ' > ' || repeat('x', (doc_id % 3) * 200) AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, trim(t) AS t FROM s),
c AS (SELECT doc_id, CASE WHEN length(t) > 400 AND regexp_matches(t, ' > ') THEN left(t, length(t) - instr(reverse(t), ' > ') - 2) ELSE t END AS t FROM a)
SELECT doc_id, CASE WHEN length(t) > 400 THEN '' ELSE t END AS section_title FROM c""")
def section_title_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as section titles, shortened by heading, emptied if still too long."""
    first = T.strip(F.element_at(F.split(T.strip("text"), "\n"), 1))
    long = F.concat(first, F.lit(" > "), F.repeat(F.lit("x"), (F.col("doc_id") % 3 * 200).cast("int")))
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.valid_section_title(long).alias("section_title"))


@query("""SELECT page_id, replace(regexp_extract(url_decode(replace(url, '+', '%2B')), '[^/]*$'), '_', ' ') AS entity, url || '#' || 'Two_words' AS block_url FROM pages""")
def url_entity_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity names from urls, and urls of a section."""
    return read(spark, sf_dir, "pages").select("page_id", T.url_to_entity_name("url").alias("entity"), T.block_url("url", F.lit("One > Two words (in English: Zwei)"), F.lit("de")).alias("block_url"))


@query("""
WITH u AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN ' ' || url || '#' WHEN page_id % 4 = 2 THEN 'mailto:' || url ELSE url END AS u FROM pages),
n AS (SELECT page_id, u, CASE WHEN u = '' THEN NULL ELSE regexp_replace(trim(u), '#$', '') END AS url FROM u)
SELECT page_id, url, coalesce(url LIKE 'http%' OR url LIKE 'ftp%', true) AS valid FROM n""")
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised urls and whether they are allowed."""
    k, u = F.col("page_id") % 4, F.col("url")
    made = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), u, F.lit("#"))).when(k == 2, F.concat(F.lit("mailto:"), u)).otherwise(u)
    return read(spark, sf_dir, "pages").select("page_id", T.normalize_url(made).alias("url"), T.is_valid_url(made).alias("valid"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS content, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS title,
 CASE WHEN doc_id % 13 = 0 THEN 'javascript:x' ELSE 'https://a.org' END AS url, CASE WHEN doc_id % 17 = 0 THEN '2023-22-01' ELSE '2024-1-5' END AS date FROM documents)
SELECT CASE WHEN coalesce(trim(content), '') = '' THEN 'empty content' WHEN title = '' THEN 'empty document title' WHEN url NOT LIKE 'http%' THEN 'invalid url' WHEN date = '2023-22-01' THEN 'invalid date' ELSE 'valid' END AS reason, count(*) AS n FROM d GROUP BY 1""")
def block_validity_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by the first rule they break."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 7 == 0, "  ").otherwise(F.col("text")).alias("content"), F.when(k % 11 == 0, "").otherwise(F.col("source")).alias("document_title"),
        F.when(k % 13 == 0, "javascript:x").otherwise("https://a.org").alias("url"), F.when(k % 17 == 0, "2023-22-01").otherwise("2024-1-5").alias("last_edit_date"),
    )
    good, bad = B.validate_blocks(d)
    return good.select(F.lit("valid").alias("reason")).unionAll(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT event_id, json_structure(props)::VARCHAR AS shape, (event_id % 9000)::INT AS num_tokens FROM events),
c AS (SELECT shape AS chosen FROM s GROUP BY 1 ORDER BY count(*) DESC LIMIT 1),
f AS (SELECT CASE WHEN shape IS DISTINCT FROM chosen THEN 'metadata' WHEN num_tokens NOT BETWEEN 5 AND 8000 THEN 'tokens' END AS fault FROM s, c)
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""")
def metadata_schema_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another metadata shape than most, or outside the token limits."""
    return B.collection_faults(read(spark, sf_dir, "events").select("props", (F.col("event_id") % 9000).cast("int").alias("num_tokens")), "props")


@query("SELECT lang AS language, count(*) AS n, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY 1")
def doc_language_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by language."""
    return read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("characters"))


@query("SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text, that of the smallest id: an aggregation with partial sums, keyed by digest so texts are not shuffled."""
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), F.struct("doc_id", "lang", "n_chars").alias("row"))
    return d.groupBy("digest").agg(F.min_by("row", "row.doc_id").alias("row")).select("row.*")


@query("""
WITH t AS (SELECT doc_id, source, regexp_extract(text, '^[^\n]*') AS title FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, source, length(title) AS title_length FROM t QUALIFY source = min(source) OVER (PARTITION BY title)""")
def title_dedup_across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a title's first file; later files' rows of that title go."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", F.regexp_extract("text", r"^[^\n]*", 0).alias("title"))
    return S.first_file_wins(d, "title", "source").select("doc_id", "source", F.length("title").cast("long").alias("title_length"))


@query("""
WITH t AS (SELECT n_name AS key, 'T' || n_nationkey AS value FROM nation WHERE n_nationkey % 3 = 0), r AS (SELECT n_name AS node, r_name AS root FROM nation JOIN region ON n_regionkey = r_regionkey),
tr AS (SELECT r_name AS key, CASE WHEN r_regionkey = 1 THEN '' ELSE 'R' || r_regionkey END AS value FROM region WHERE r_regionkey < 4), m AS (SELECT * FROM t UNION ALL SELECT * FROM tr)
SELECT n_nationkey, n_name AS entity, coalesce(a.value, b.value) AS translation FROM nation LEFT JOIN m a ON n_name = a.key LEFT JOIN r ON n_name = node LEFT JOIN m b ON root = b.key""")
def translation_two_path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's translation, else that of its root."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    own = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key"), F.concat(F.lit("T"), "n_nationkey").alias("value"))
    roots = region.where("r_regionkey < 4").select(F.col("r_name").alias("key"), F.when(F.col("r_regionkey") == 1, "").otherwise(F.concat(F.lit("R"), "r_regionkey")).alias("value"))
    redirects = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("root"))
    return S.translate_two_paths(nation.select("n_nationkey", F.col("n_name").alias("entity")), own.unionByName(roots), redirects)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def untranslated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the cache (labels) does not have."""
    return S.uncached(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def root_articles_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are roots."""
    return S.keep_roots(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 AND p_partkey % 7 <> 0),
m AS (SELECT p_partkey AS root, p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM e) UNION ALL SELECT root, src FROM m JOIN e ON e.dst = m.node)
SELECT root, count(*) AS members, max(node) AS largest FROM m GROUP BY 1""")
def redirect_forest_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of redirects, by root."""
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = nodes.where("node > 1 AND node % 7 <> 0").select(F.col("node").alias("src"), F.expr("node div 2").alias("dst"))
    return G.forest_members(edges, nodes).groupBy("root").agg(F.count("*").alias("members"), F.max("node").alias("largest"))


@query("""
SELECT o_custkey AS customer, count(*) AS orders, min(o_orderkey) AS component FROM orders GROUP BY 1""")
def bipartite_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of orders and customers: each customer's smallest order."""
    # even nodes are orders, odd ones customers
    e = read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("u"), (F.col("o_custkey") * 2 + 1).alias("v"))
    found = G.connected_components(e, "u", "v").withColumn("leaf", F.col("node") % 2 == 0).withColumn("key", F.expr("node div 2"))
    of = found.where("NOT leaf").select(F.col("component").alias("__c"), F.col("key").alias("customer"))
    orders = found.where("leaf").groupBy("component").agg(F.count("*").alias("orders"), F.min("key").alias("smallest"))
    return of.join(orders, F.col("__c") == F.col("component")).select("customer", "orders", F.col("smallest").alias("component"))


_CHAINS = """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey - p_size AS dst FROM part WHERE p_partkey > p_size),
m AS (SELECT p_partkey AS root, p_partkey AS node FROM part WHERE p_partkey <= p_size UNION ALL SELECT root, src FROM m JOIN e ON e.dst = m.node)
"""


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part points ``p_size`` places back: long chains and branches."""
    part = read(spark, sf_dir, "part")
    return part.where("p_partkey > p_size").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_size")).alias("dst"))


@query(_CHAINS + "SELECT node, min(root) AS component FROM m WHERE node IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY 1")
def component_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of long chains."""
    return G.connected_components(_chains(spark, sf_dir))


@query(_CHAINS + "SELECT node, min(root) AS root FROM m GROUP BY 1")
def redirect_chain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of every node of long chains."""
    return G.root_of(G.forest_members(_chains(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), node="node"))


@query("SELECT p_size AS target, count(DISTINCT p_name) AS n, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS sources FROM part GROUP BY 1")
def redirect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names that redirect to a target."""
    sets = G.redirect_sets(read(spark, sf_dir, "part"), "p_name", "p_size")
    return sets.select("target", "n", F.array_join("sources", "|").alias("sources"))


# ---- sequences


@query("""
WITH h AS (SELECT conv_id, turn, sum(length(text) + 10) OVER (PARTITION BY conv_id ORDER BY turn) AS e, length(text) AS n FROM conversations), s AS (SELECT conv_id, turn, e - 10 AS s, e FROM h)
SELECT conv_id, turn, e::BIGINT AS body_start, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY turn), 1000000)::BIGINT AS body_end FROM s""")
def section_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies between the headers of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    h = read(spark, sf_dir, "conversations").withColumn("end", F.sum(F.length("text") + 10).over(w)).withColumn("start", F.col("end") - 10).withColumn("length", F.lit(1_000_000).cast("long"))
    return S.section_boundaries(h, "conv_id", "turn", "start", "end", "length").select("conv_id", "turn", "body_start", "body_end")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, (o_orderkey % 50)::BIGINT AS low, (o_orderkey % 50 + 20)::BIGINT AS high, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
p AS (SELECT c_custkey, (c_custkey % 40)::BIGINT AS a, (c_custkey % 40 + 10)::BIGINT AS b FROM customer)
SELECT c_custkey, a, b, (SELECT min(place) FROM s WHERE s.o_custkey = p.c_custkey AND a >= low AND b <= high)::INT AS place FROM p""")
def paragraph_in_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first interval of its key that contains each span."""
    k = F.col("o_orderkey") % 50
    s = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), k.alias("low"), (k + 20).alias("high"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"))
    p = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("a"), (F.col("c_custkey") % 40 + 10).alias("b"))
    return S.assign_interval(p, s, "c_custkey", "a", "b", "low", "high", "place").select("c_custkey", "a", "b", "place")


@query("""
WITH e AS (SELECT user_id, event_id, event_id AS s, event_id + (event_id % 3) AS e, event_type FROM events),
n AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM e), i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM n)
SELECT user_id, min(s) AS s, max(e) AS e, string_agg(event_type, '|' ORDER BY event_id) AS event_type, count(*) AS n FROM i GROUP BY user_id, k""")
def gaps_and_islands_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching spans joined, their texts in order."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("s"), (F.col("event_id") + F.col("event_id") % 3).alias("e"), "event_type")
    return S.merge_islands(e, ["user_id"], "event_id", "s", "e", "event_type", "|")


@query("SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, min(turn) AS first_order FROM conversations GROUP BY 1, 2")
def section_text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each conversation and role joined in order."""
    return S.concat_by_section(read(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text")


@query("""
WITH x AS (SELECT unnest(range(0, 101, 5))::DOUBLE AS percent), d AS (SELECT list_sort(list(n_chars::DOUBLE)) AS v FROM documents WHERE n_chars IS NOT NULL), p AS (SELECT percent, v, percent / 100.0::DOUBLE * (len(v) - 1) AS pos FROM x, d)
SELECT percent, round(v[floor(pos)::INT + 1] + (pos - floor(pos)) * (v[ceil(pos)::INT + 1] - v[floor(pos)::INT + 1]), 4) AS value FROM p""")
def token_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth percentile of text lengths."""
    return S.percentiles(read(spark, sf_dir, "documents"), "n_chars").withColumn("value", F.round("value", 4))


@query("""
WITH d AS (SELECT n_chars AS v FROM documents WHERE n_chars IS NOT NULL), e AS (SELECT [0, 10, 10, 100, 1000, 10000, 100000, 1000000] AS e),
i AS (SELECT unnest(range(7))::INT AS bucket), c AS (SELECT least(len(list_filter(e, lambda x: x <= v)) - 1, 6)::INT AS bucket, count(*) AS n FROM d, e WHERE v BETWEEN 0 AND 1000000 GROUP BY 1)
SELECT bucket, e[bucket + 1]::DOUBLE AS low, e[bucket + 2]::DOUBLE AS high, coalesce(n, 0) AS n FROM i JOIN e ON true LEFT JOIN c USING (bucket)""")
def token_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths between given edges."""
    return S.bucket_counts(read(spark, sf_dir, "documents"), "n_chars", [0, 10, 10, 100, 1000, 10_000, 100_000, 1_000_000])


@query("""
WITH b AS (SELECT least(floor((ln(greatest(n_chars, 1)) - ln(1)) / ((ln(100000) - ln(1)) / 50)), 49)::INT AS bin, n_chars FROM documents)
SELECT bin, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT sum(n_chars) FROM documents), 9) AS share FROM b GROUP BY 1""")
def token_length_log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths in 50 logarithmic bins."""
    return S.log_histogram(read(spark, sf_dir, "documents"), "n_chars", 50, 1.0, 100_000.0).withColumn("share", F.round("share", 9))


@query("""
WITH v AS (SELECT user_id, count(*) AS views FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(*) > 0),
h AS (SELECT 'head' AS part, * FROM (SELECT * FROM v ORDER BY views DESC, user_id LIMIT 10)), t AS (SELECT 'tail' AS part, * FROM (SELECT * FROM v ORDER BY views, user_id DESC LIMIT 10))
SELECT part, user_id, views, row_number() OVER (PARTITION BY part ORDER BY views DESC, user_id)::INT AS place FROM (SELECT * FROM h UNION ALL SELECT * FROM t)""")
def views_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most and ten least viewed."""
    v = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("views")).where("views > 0")
    return S.head_and_tail(v, 10, "views", "user_id")


@query("""
WITH m AS (SELECT user_id, event_type, month(ts) * 100 + day(ts) AS d, event_id FROM events WHERE event_type = 'purchase' OR event_type = 'click'), f AS (SELECT user_id, min_by(event_id, (d, event_id)) AS event_id FROM m GROUP BY 1)
SELECT user_id, event_id, doc_id, source FROM f JOIN documents ON doc_id = user_id""")
def recent_titles_union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence over a union of lists, joined to the documents."""
    e = read(spark, sf_dir, "events").withColumn("d", F.month("ts") * 100 + F.dayofmonth("ts"))
    lists = e.where("event_type = 'purchase'").unionByName(e.where("event_type = 'click'"))
    first = lists.groupBy("user_id").agg(F.min_by("event_id", F.struct("d", "event_id")).alias("event_id"))
    return first.join(read(spark, sf_dir, "documents").select("doc_id", "source"), F.col("user_id") == F.col("doc_id"))


@query("""
SELECT item_id, a.doc_id AS first_id, b.doc_id AS second_id FROM benchmark JOIN documents a ON a.doc_id = item_id JOIN documents b ON b.doc_id = item_id + 1 WHERE a.lang = b.lang ORDER BY item_id LIMIT 10""")
def multihop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with both supporting documents, the first ten."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    a, b = d.select(F.col("doc_id").alias("first_id"), F.col("lang").alias("l1")), d.select(F.col("doc_id").alias("second_id"), F.col("lang").alias("l2"))
    q = read(spark, sf_dir, "benchmark").select("item_id")
    return q.join(a, F.col("item_id") == F.col("first_id")).join(b, F.col("item_id") + 1 == F.col("second_id")).where("l1 = l2").orderBy("item_id").limit(10).select("item_id", "first_id", "second_id")


@query("""
WITH t AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark), n AS (SELECT count(*) AS n FROM t)
SELECT slot, item_id FROM (SELECT unnest(range(500))::BIGINT AS slot) s, n JOIN t ON true WHERE t.i = slot % n""")
def repeat_topics_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics repeated to 500 slots."""
    return S.repeat_round_robin(read(spark, sf_dir, "benchmark").select("item_id"), 500, "item_id").select("slot", "item_id")


@query("SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def first_block_per_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each title."""
    return B.first_per_key(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"])


@query("""
WITH l AS (SELECT conv_id, turn, role || ': ' || regexp_replace(coalesce(text, ''), ' ?\\[\\d+\\]', '', 'g') AS line FROM conversations)
SELECT conv_id, turn, string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM l""")
def dialogue_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns and the current one as text."""
    return S.dialogue_history(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 2).select("conv_id", "turn", "history")


@query("""
WITH p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
SELECT 'exp-' || conv_id || '-' || k AS _id, 'exp' AS experiment_id, conv_id AS dialog_id, k::INT AS turn_id, 'system' AS system_name, CASE WHEN role = 'user' THEN text END AS user_utterance, CASE WHEN role = 'assistant' THEN text END AS agent_utterance FROM p""")
def dialogue_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row for each turn."""
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    item = F.struct("turn", said("user").alias("user_utterance"), said("assistant").alias("agent_utterance"))
    d = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("dialogue_id")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return D.log_rows(d, "exp", "system").drop("agent_log_object")


@query("""
WITH c AS (SELECT doc_id, 'See [' || (doc_id % 5 + 1) || '] and [' || (doc_id % 3 + 1) || '], not [9].' AS s, doc_id % 5 + 1 AS a, doc_id % 3 + 1 AS b FROM documents)
SELECT doc_id, CASE WHEN a = b THEN 'See [1] and [1], not [9].' WHEN a < b THEN 'See [1] and [2], not [9].' ELSE 'See [2] and [1], not [9].' END AS shifted,
 CASE WHEN a = b THEN 'r' || a WHEN a < b THEN 'r' || a || ',r' || b ELSE 'r' || b || ',r' || a END AS kept FROM c""")
def citation_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations renumbered without gaps."""
    mark = lambda k: F.concat(F.lit("["), (F.col("doc_id") % k + 1).cast("string"), F.lit("]"))
    s = F.concat(F.lit("See "), mark(5), F.lit(" and "), mark(3), F.lit(", not [9]."))
    text, kept = T.shift_references(s, F.array(*[F.lit(f"r{i}") for i in range(1, 6)]))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("shifted"), F.array_join(kept, ",").alias("kept"))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+')"


@query(f"""
WITH t AS (SELECT doc_id, doc_id // 20 AS k, list_distinct({_WORDS}) AS w FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 9) AS jaccard FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id WHERE len(a.w) + len(b.w) > 0""")
def pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity within result lists of twenty: all documents, list by list."""
    t = read(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("k"), "doc_id", F.array_distinct(T.words(F.coalesce("text", F.lit("")))).alias("w"))
    a, b = t.select("k", F.col("doc_id").alias("a"), F.col("w").alias("wa")), t.select("k", F.col("doc_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, "k").where("a < b AND size(wa) + size(wb) > 0").select("a", "b", F.round(V.jaccard("wa", "wb"), 9).alias("jaccard"))


@query(f"""
WITH RECURSIVE t AS (SELECT doc_id, doc_id // 20 AS list, list_distinct({_WORDS}) AS w FROM documents),
j AS (SELECT a.list, a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.list = b.list AND a.doc_id < b.doc_id
  WHERE len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w))) AND len(a.w) + len(b.w) > 0),
f AS (SELECT list, list_sort(list(doc_id)) AS ids FROM t GROUP BY 1),
g AS (SELECT list, 1 AS i, []::BIGINT[] AS kept FROM f
  UNION ALL SELECT g.list, i + 1, CASE WHEN EXISTS (SELECT 1 FROM j WHERE j.list = g.list AND j.b = f.ids[i] AND list_contains(g.kept, j.a)) THEN kept ELSE list_append(kept, f.ids[i]) END FROM g JOIN f ON f.list = g.list WHERE i <= len(f.ids))
SELECT g.list, unnest(kept) AS doc_id FROM g JOIN f ON f.list = g.list WHERE i = len(f.ids) + 1""")
def near_dup_greedy_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered greedy near-duplicate removal inside result lists of twenty."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr("doc_id div 20").alias("list"), T.words(F.coalesce("text", F.lit(""))).alias("tokens"))
    return B.near_dedup_ordered(d, ["list"], "doc_id", "tokens").select("list", "doc_id")


@query("""
WITH t AS (SELECT event_id, -(event_id % 7 + 1) / 2.0::DOUBLE AS ly, -(event_id % 5 + 1) / 3.0::DOUBLE AS ln FROM events)
SELECT event_id, round(exp(ly / 5) / (exp(ly / 5) + exp(ln / 5)), 9) AS yes FROM t""")
def yes_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempered probability of yes."""
    e = F.col("event_id")
    item = lambda t, x: F.struct(F.lit(t).alias("token"), x.alias("logprob"))
    top = F.array(item(" Yes", -(e % 7 + 1) / 2.0), item("no", -(e % 5 + 1) / 3.0), item("not", F.lit(-0.1)), item("maybe", F.lit(-0.2)))
    return read(spark, sf_dir, "events").select("event_id", F.round(V.yes_probability(top), 9).alias("yes"))


_LISTS = """
l AS (SELECT item_id AS query_id, b.text AS query, d.doc_id, d.text AS content, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark b JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result list for every benchmark item; every document is in one of them."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    items = b.agg(F.max("query_id") + 1).first()[0] or 1
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), (F.col("doc_id") % items).alias("query_id"))
    return d.join(b, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))


@query(f"""
WITH {_LISTS}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS q, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS c FROM l),
s AS (SELECT query_id, doc_id, rank, CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q)::DOUBLE ELSE 0 END AS score FROM w)
SELECT * FROM (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS rank FROM s) WHERE rank <= 5""")
def rerank_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists by a lexical score, the best five."""
    return RR.rerank_pointwise(_lists(spark, sf_dir), RR.lexical_score("query", F.coalesce("content", F.lit("")))).where("rank <= 5").select("query_id", "doc_id", F.round("rerank_score", 9).alias("score"), "rank")


@query()
def rerank_listwise_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows from the tail over every item's whole list, longer texts first."""

    def choose(rows):
        return [int(i) for i in rows["size"].to_numpy().argsort(kind="stable")[::-1]]

    lists = _lists(spark, sf_dir).select("query_id", "doc_id", F.coalesce(F.length("content"), F.lit(0)).alias("size"), "rank")
    return RR.rerank_listwise(lists, choose).select("query_id", "doc_id", "rank")


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("role = 'assistant' AND before IS NOT NULL")
    return c.select("conv_id", "turn", F.round(RR.rouge_l("before", "text"), 6).alias("rouge_l"))


@query("""
WITH p AS (SELECT * FROM (VALUES ('user'), ('assistant'), ('system'), ('refine')) v(prompt)), m AS (SELECT role, avg(length(text)) AS v, count(*) AS n FROM conversations GROUP BY 1)
SELECT prompt, round(v, 6) AS mean_length, coalesce(n, 0) AS n FROM p LEFT JOIN m ON prompt = role""")
def label_metrics_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric's mean by prompt; prompts without examples are reported."""
    prompts = spark.createDataFrame([("user",), ("assistant",), ("system",), ("refine",)], "prompt string")
    outputs = read(spark, sf_dir, "conversations").select(F.col("role").alias("prompt"), F.col("text").alias("prediction"), F.col("text").alias("gold"))
    return E.means_by_prompt(outputs, prompts, {"mean_length": lambda p, _: F.length(p)}).select("prompt", F.round("mean_length", 6).alias("mean_length"), "n")


# ---- HTML and text


@query()
def html_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as blocks."""
    return H.html_to_blocks(spread(read(spark, sf_dir, "pages").select("page_id", "html")), ["page_id"])


@query("""SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) AS links, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS headings FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, links and headings of pages."""
    return H.page_outline(spread(read(spark, sf_dir, "pages").select("page_id", "html")), "page_id")


_UNESCAPED = "regexp_replace(replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;?', '&', 'g')"


@query(f"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<head.*?</head>|<script.*?</script>|<style.*?</style>|<title.*?</title>', '', 'g'), '<[^>]*>', ' ', 'g') AS t, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)
SELECT page_id, trim(regexp_replace({_UNESCAPED.format("h")}, '\\s+', ' ', 'g')) AS last_section, length(regexp_replace({_UNESCAPED.format("t")}, '\\s+', '', 'g')) AS characters FROM b""")
def html_text_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of a page is in its blocks: characters but blanks, section titles once; and the last block's section."""
    blocks = H.html_to_blocks(spread(read(spark, sf_dir, "pages").select("page_id", "html")), ["page_id"])
    solid = lambda c: F.length(F.regexp_replace(c, r"\s+", "")).cast("long")
    of = blocks.groupBy("page_id").agg(F.sum(solid("content")).alias("text"), F.collect_set("section_title").alias("s"), F.max_by("section_title", "block_no").alias("last_section"))
    return of.select("page_id", "last_section", (F.col("text") + F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + solid(x))).alias("characters"))


@query()
def recursive_text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of at most 600 tokens."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(P.split_text("text")).alias("piece", "content"))
    return d.select("doc_id", "piece", F.length("content").alias("characters"), T.count_tokens("content").alias("tokens"))


@query(r"""
WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, line, len(regexp_extract_all(line, '{T}')) AS own, len(regexp_extract_all(coalesce(source, '') || ' ' || line, '{T}')) AS whole
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE line <> ''),
f AS (SELECT doc_id, k, 0 AS pack, whole AS tokens, length(line) AS characters FROM l WHERE k = 1
  UNION ALL SELECT l.doc_id, l.k, CASE WHEN tokens + own < 120 THEN pack ELSE pack + 1 END, CASE WHEN tokens + own < 120 THEN tokens + own ELSE whole END, CASE WHEN tokens + own < 120 THEN characters + 1 + length(line) ELSE length(line) END FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1)
SELECT doc_id, pack::INT AS pack, max(tokens)::INT AS num_tokens, max(characters)::INT AS characters FROM f GROUP BY 1, 2""".replace("{T}", T.TOKEN))
def greedy_pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents packed to under 120 tokens."""
    lines = read(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "content")).where("content <> ''")
    lines = lines.select("doc_id", F.col("source").alias("document_title"), F.lit("").alias("section_title"), "line", "content")
    packed = B.pack_blocks(lines, 120, ["doc_id"], "line")
    return packed.select("doc_id", "pack", "num_tokens", F.length("content").alias("characters"))


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.' || k)) AS present FROM events, (SELECT json_keys(props)[1] AS k FROM events ORDER BY event_id LIMIT 1) GROUP BY 1""")
def json_props_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata field read from JSON."""
    e = read(spark, sf_dir, "events")
    key = F.get(F.json_object_keys("props"), F.lit(0))
    first = e.orderBy("event_id").limit(1).select(key.alias("k"))
    d = e.join(F.broadcast(first)).withColumn("v", F.try_element_at(F.from_json("props", "map<string,string>"), F.col("k")))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("present"))


@query("""
WITH d AS (SELECT doc_id, coalesce(source, '?') AS a, coalesce(lang, '?') || ' (' || doc_id || ')' AS b FROM documents)
SELECT doc_id, 2::BIGINT AS distinct_translations, 'X (in English: ' || a || ')' AS title, 'Y (in English: ' || b || ') > X' AS section, 'Z, X' || repeat(', X', 2) || ' (in English: ' || doc_id || ')' AS content FROM d""")
def translation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced translation marks of title, section and content, kept where they come first."""
    a, b = F.coalesce("source", F.lit("?")), F.concat(F.coalesce("lang", F.lit("?")), F.lit(" ("), "doc_id", F.lit(")"))
    mark = lambda name, x: F.concat(F.lit(f"{name} (in English: "), x, F.lit(")"))
    section = F.concat_ws(" > ", mark("Y", b), mark("X", a))
    content = F.concat_ws(", ", mark("Z", b), mark("X", a), mark("X", a), mark("X", F.col("doc_id").cast("string")))
    d = read(spark, sf_dir, "documents").select("doc_id", mark("X", a).alias("t"), section.alias("s"), content.alias("c"))
    once = d.withColumn("__d", T.deduplicate_translations("t", "s", "c"))
    return once.select("doc_id", F.size(F.array_distinct(T.english_translations("s"))).cast("long").alias("distinct_translations"), F.col("__d.document_title").alias("title"), F.col("__d.section_title").alias("section"), F.col("__d.content").alias("content"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN true WHEN doc_id % 4 = 2 THEN false ELSE true END AS disambiguation FROM documents""")
def disambiguation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disambiguation pages by template, title, exclusion and text."""
    k = F.col("doc_id") % 4
    templates = F.when(k == 0, F.array(F.lit("Template:Disambig"))).when(k == 2, F.array(F.lit("About"))).otherwise(F.array().cast("array<string>"))
    title = F.when(k == 1, "Mercury (disambiguation)").otherwise("Mercury")
    return read(spark, sf_dir, "documents").select("doc_id", A.is_disambiguation(templates, title, F.lit("Mercury may also refer to:")).alias("disambiguation"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%B %d, %Y') AS human, o_orderdate >= TIMESTAMP '1996-06-01' - INTERVAL 30 DAY AS recent FROM orders""")
def edit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read from text, written for people, compared with a previous run."""
    d = read(spark, sf_dir, "orders").withColumn("t", V.parse_edit_date(F.date_format("o_orderdate", "yyyy-M-d'T'HH:mm:ss'Z'")))
    return d.select("o_orderkey", V.iso_date("t").alias("iso"), V.human_date("t").alias("human"), V.modified_since(F.col("t"), "1996-06-01").alias("recent"))

# ---- stores, embeddings, views of results


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')) AS word FROM documents),
h AS (SELECT doc_id, ('0x' || md5(word)[1:7])::BIGINT % 64 AS place, 1 - 2 * (('0x' || md5(word)[8:8])::INT & 1) AS s FROM w),
g AS (SELECT doc_id, place, sum(s) AS v FROM h GROUP BY 1, 2 HAVING sum(s) <> 0),
n AS (SELECT doc_id, count(*) AS filled, sum(abs(v)) / sqrt(sum(v * v)) AS weight FROM g GROUP BY 1)
SELECT doc_id, coalesce(filled, 0)::INT AS filled, round(coalesce(weight, 0), 6) AS weight FROM documents LEFT JOIN n USING (doc_id)""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as vectors of hashed words: places filled, and the sum of their sizes at length one."""
    asked = spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    found = RG.embed_queries(asked, RG.HashedWords(64), RG.EmbeddingModel("hashed words", 64))
    return found.select(F.col("query_id").alias("doc_id"), F.size(F.filter("query_vector", lambda x: x != 0)).alias("filled"), F.round(F.aggregate("query_vector", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("weight"))


@query("""
SELECT n_name AS key, arg_max(n_comment, n_nationkey) AS value FROM (SELECT n_name, n_nationkey, n_comment, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE r_name = 'ASIA' GROUP BY 1""".replace("n_comment", "'T' || n_nationkey"))
def translation_map_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation map appended in batches and read for one language."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("language"), F.col("n_name").alias("translation_key"), F.concat(F.lit("T"), "n_nationkey").alias("translation_value"))
    store = A.TranslationMap(spark, scratch(spark, "translations"))
    store.append(rows.where("language <= 'ASIA'").withColumn("translation_value", F.lit("old")))
    store.append(rows.unionByName(rows))
    return store.load("ASIA")


@query("""
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END::INT AS label FROM embeddings""")
def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection: added twice, changed by upsert, saved, damaged and loaded again."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    store = R.Collection(spark, scratch(spark, "collections"), "vectors", "vec_id", indexed=("label",))
    store.add(rows.where("vec_id % 2 = 0"))
    store.add(rows)
    store.upsert(rows.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100))
    store.snapshot("good")
    store.upsert(rows.withColumn("label", F.lit(-1)))
    store.load("good")
    store.clean()
    return store.read()


@query()
def knn_inverted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search over a collection partitioned by cell: cells, sign bits, exact scores."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = R.Cells.fit(vectors, "embedding", 16)
    store = R.Collection(spark, scratch(spark, "collections"), "cells", "vec_id", "cell")
    store.add(cells.assign(vectors, "embedding"))
    found = R.knn_cells(_queries(spark, sf_dir), store.read(), cells, 10, 64, probes=10, oversampling=10.0)
    return found.withColumn("similarity", F.round("similarity", 3))


@query(_KNN.format(where="e.vec_id <> query_id", k=10) + """,
o AS (SELECT 'none' AS reranker, query_id, vec_id, rank FROM t UNION ALL SELECT 'reversed', query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) FROM t),
rel AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1), k AS (SELECT unnest([5, 10])::INT AS k), r AS (SELECT unnest(['none', 'reversed']) AS reranker),
h AS (SELECT reranker, k, o.query_id, rank, row_number() OVER (PARTITION BY reranker, k, o.query_id ORDER BY rank) AS seen FROM o JOIN rel USING (query_id, vec_id), k WHERE rank <= k),
g AS (SELECT reranker, k, query_id, sum(1 / log2(rank + 1)) AS dcg, sum(seen / rank::DOUBLE) AS ps, count(*) AS hits FROM h GROUP BY 1, 2, 3),
m AS (SELECT r.reranker, k.k, n.query_id, coalesce(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(relevant, k.k) + 1)]), 0) AS ndcg, coalesce(ps / least(relevant, k.k), 0) AS ap, coalesce(hits / relevant::DOUBLE, 0) AS rec, coalesce(hits / k.k::DOUBLE, 0) AS pre FROM n CROSS JOIN k CROSS JOIN r LEFT JOIN g ON g.query_id = n.query_id AND g.k = k.k AND g.reranker = r.reranker)
SELECT reranker, k, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS average_precision, round(avg(rec), 6) AS recall, round(avg(pre), 6) AS precision FROM m GROUP BY 1, 2""")
def reranker_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics before and after a reranker that turns lists round."""
    vectors, queries = read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir)
    found = R.knn(queries, vectors, 10, exclude_self=True)
    own = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = vectors.select("vec_id", "label").join(F.broadcast(own), "label").where("vec_id <> query_id").select("query_id", "vec_id")
    turned = lambda x: RR.rerank_pointwise(x, -F.col("similarity")).drop("rerank_score")
    m = RR.compare_rerankers(found, relevant, {"reversed": turned}, (5, 10))
    return m.select("reranker", "k", "queries", *[F.round(c, 6).alias(c) for c in m.columns[3:]])


@query("SELECT vec_id AS query_id FROM embeddings e WHERE vec_id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM embeddings f WHERE f.label = 3 AND f.vec_id = e.vec_id)")
def unanswered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a result among the vectors of one label."""
    own = read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("query_id"))
    return R.unanswered(_queries(spark, sf_dir), own)


@query("SELECT source, bool_and(coalesce(quality = 1, false)) AS verified FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def all_claims_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources all of whose documents are labelled good."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return E.all_supported(d.withColumn("label", F.when(F.col("quality") == 1, "SUPPORTS").otherwise("REFUTES")), "source")


@query("""
WITH m AS (SELECT r_name AS entity, lower(n_name[1:2]) AS language, 'label ' || min(n_name) AS name, 1 AS place FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
  UNION ALL SELECT r_name, lower(n_name[1:2]), 'link ' || max(n_name), 0 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT r_name, unnest(['en', 'commons']), 'x', 0 FROM region)
SELECT entity, language, arg_min(name, place) AS name FROM m WHERE language NOT IN ('en', 'en-gb', 'en-ca', 'commons', 'simple') GROUP BY 1, 2""")
def available_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of an entity's links and labels, links first, English and services left out."""
    d = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("language", F.lower(F.left("n_name", F.lit(2))))
    collected = lambda rows, name, alias: rows.groupBy("r_name", "language").agg(name.alias("name")).groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("language", "name"))).alias(alias))
    labels = collected(d, F.concat(F.lit("label "), F.min("n_name")), "labels")
    links = collected(d.where("n_nationkey % 2 = 0"), F.concat(F.lit("link "), F.max("n_name")), "links")
    services = F.create_map(F.lit("en"), F.lit("x"), F.lit("commons"), F.lit("x"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    both = labels.join(links, "r_name", "left").withColumn("links", V.merged_options(services, F.coalesce("links", none)))
    return both.select(F.col("r_name").alias("entity"), F.explode(V.available_languages("links", "labels")).alias("language", "name"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_linenumber * 10 AS low, l_linenumber * 10 + least(floor(max(l_quantity)), 9) AS high FROM lineitem GROUP BY 1, 2),
p AS (SELECT o_orderkey, 10 + o_custkey % 60 AS a, 10 + o_custkey % 60 + 2 AS b FROM orders)
SELECT o_orderkey, a::BIGINT AS a, b::BIGINT AS b, (SELECT min(l_linenumber) FROM o WHERE l_orderkey = o_orderkey AND a >= low AND b <= high)::INT AS place FROM p""")
def paragraph_in_disjoint_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one section of an order that holds a span; sections do not overlap."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("place")).agg(F.floor(F.max("l_quantity")).alias("size"))
    low = F.col("place").cast("long") * 10
    sections = lines.select("o_orderkey", low.alias("low"), (low + F.least("size", F.lit(9))).alias("high"), "place")
    at = 10 + F.col("o_custkey") % 60
    spans = read(spark, sf_dir, "orders").select("o_orderkey", at.alias("a"), (at + 2).alias("b"))
    return S.assign_disjoint(spans, sections, "o_orderkey", "a", "b", "low", "high", "place")


@query("""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role AS title, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, string_agg('[' || k || '] Title: ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS prompt,
  string_agg('<strong>[a' || (k + 2) || '] Title: ' || title || '</strong>' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY k) FILTER (k <= 2) AS review, count(*) FILTER (k <= 2)::INT AS shown,
  string_agg('#### [' || title || '](https://a.org/' || conv_id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS markdown FROM c GROUP BY 1)
SELECT conv_id, md5(prompt) AS prompt, md5(review) AS review, shown, md5(markdown) AS markdown FROM t""")
def result_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as text for a prompt, for a reader, and as Markdown."""
    item = F.struct("turn", F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("https://a.org/"), "conv_id").alias("url"))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    review = T.result_review("r", first=3, limit=2, prefix="a")
    return c.select("conv_id", F.md5(T.result_string("r")).alias("prompt"), F.md5(review["text"]).alias("review"), review["shown"].alias("shown"), F.md5(T.result_markdown("r")).alias("markdown"))


@query(r"""
WITH u AS (SELECT page_id, url, html FROM pages), f AS (SELECT page_id, 'my ' || replace(replace(url, '://', ' <'), '/', '?') || '%.jsonl.gz' AS name, url, html FROM u)
SELECT page_id, regexp_replace(regexp_replace(name, '["%*/:<>?|\\]', '-', 'g'), ' ', '_', 'g') AS safe, split_part(name, '.', 1) AS stem,
 trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, CASE WHEN page_id % 2 = 0 THEN url ELSE 'Chatbot: ' || url END AS said,
 'Title: ' || url || chr(10) || left(html, 600) AS embedded FROM f""".replace("split_part(name, '.', 1)", "regexp_extract(name, '^[^.]*')"))
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe file names, names without extensions, tags, prefixes, embedding texts and excerpts of pages."""
    p = read(spark, sf_dir, "pages")
    name = F.concat(F.lit("my "), F.replace(F.replace("url", F.lit("://"), F.lit(" <")), F.lit("/"), F.lit("?")), F.lit("%.jsonl.gz"))
    said = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("User:  "), "url")).otherwise(F.concat(F.lit("Chatbot: "), "url"))
    return p.select("page_id", T.secure_file_name(name).alias("safe"), T.remove_all_extensions(name).alias("stem"), T.first_tag("html", "title").alias("title"), T.remove_prefix(said).alias("said"), T.embedding_text("url", T.prompt_excerpt("html")).alias("embedded"))


@query("""
WITH p AS (SELECT doc_id, doc_id % 7 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'https://x.org/' || doc_id || '.pdf' WHEN 1 THEN 'https://arxiv.org/pdf/' || doc_id WHEN 2 THEN 'https://arxiv.org/oa/' || doc_id WHEN 3 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/' || doc_id || '/pdf/'
 WHEN 4 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' WHEN 5 THEN 'https://aclanthology.org/' || doc_id || '.pdf' END AS url, k IN (1, 3, 4, 5) AS in_subset,
 CASE WHEN k < 3 THEN (k + 1) || '. Results' ELSE 'Results' END AS section FROM p""")
def paper_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best url of a paper, whether it belongs to a sub-collection, and numbered sections."""
    k, i = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    at = lambda n: F.when(k == n, i)
    ids = F.create_map(F.lit("arxiv"), F.coalesce(at(1), F.lit("")), F.lit("pubmedcentral"), at(3), F.lit("pubmed"), at(4), F.lit("acl"), at(5))
    pdf = F.when(k == 0, F.array(F.concat(F.lit("https://x.org/"), i, F.lit(".pdf")))).otherwise(F.array().cast("array<string>"))
    oa = F.when(k == 2, F.concat(F.lit("https://export.arxiv.org/oa/"), i))
    url = T.paper_url(pdf, at(1), oa, at(3), at(4), at(5))
    return read(spark, sf_dir, "documents").select("doc_id", url.alias("url"), A.in_subset(ids).alias("in_subset"), T.section_with_number(F.when(k < 3, (k + 1).cast("string")), F.lit("Results")).alias("section"))


@query("""
WITH d AS (SELECT doc_id, coalesce(source, '') AS e, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'the' WHEN 2 THEN '1984' WHEN 3 THEN 'Well known (place)' ELSE 'Title name (x)' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN e || ' (in English: Well known)' ELSE e END AS name FROM d""")
def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their English ones; not for frequent words, numbers, or what the title says."""
    k = F.col("doc_id") % 5
    t = F.when(k == 1, "the").when(k == 2, "1984").when(k == 3, "Well known (place)").when(k == 4, "Title name (x)")
    return read(spark, sf_dir, "documents").select("doc_id", S.translated_name(F.coalesce("source", F.lit("")), t, F.lit("A title NAME here"), frozenset({"the"})).alias("name"))


@query("""
SELECT 'rows' AS kind, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 0
UNION ALL SELECT 'corrupt', count(*), NULL FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT 'converted', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT 'rejected', count(*), NULL FROM documents WHERE doc_id % 10 = 0""")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines with damaged lines: read with resume by id, and converted to Parquet."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    folder = scratch(spark, "lines")
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{"), F.left("value", F.lit(12)))).otherwise(F.col("value"))
    d.select(broken.alias("value")).write.option("compression", "gzip").text(f"{folder}/a.jsonl")
    seen = d.where("doc_id % 3 = 0").select("doc_id")
    rows, corrupt = A.read_blocks(spark, f"{folder}/a.jsonl", "doc_id long, text string", seen, "doc_id")
    rejected = A.jsonl_to_parquet(spark, f"{folder}/a.jsonl", f"{folder}/b.parquet", "doc_id long, text string", pattern="*")
    counts = lambda x, kind: x.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids")
    none = F.lit(None).cast("long").alias("ids")
    refused = spark.range(1).select(F.lit("rejected").alias("kind"), F.lit(rejected).cast("long").alias("n"), none)
    return counts(rows, "rows").unionByName(corrupt.agg(F.count("*").alias("n")).select(F.lit("corrupt").alias("kind"), "n", none)).unionByName(counts(spark.read.parquet(f"{folder}/b.parquet"), "converted")).unionByName(refused)


@query("""
WITH d AS (SELECT doc_id, source, n_chars, lang FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-03-0' || (doc_id % 9 + 1) END AS last_edit_date, '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n":' || n_chars || '}' AS block_metadata, source AS document_title FROM d""".replace("SELECT doc_id, CASE", "SELECT doc_id::VARCHAR AS section_title, CASE"))
def old_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the old layout: names, dates, and unknown columns as metadata."""
    k = F.col("doc_id")
    old = read(spark, sf_dir, "documents").select(k.alias("id"), F.col("source").alias("article_title"), F.concat(F.lit("Top > "), k).alias("full_section_title"), F.when(k % 3 == 0, F.concat(F.lit("3:"), k % 9 + 1, F.lit(":24"))).alias("last_edit_date"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_chars").alias("n"))
    return B.migrate_old_blocks(old).select("section_title", "last_edit_date", "block_metadata", "document_title")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE repeat('word ', (doc_id % 9 + 1)::INT) END AS c FROM documents)
SELECT CASE WHEN c = '' THEN 'empty content' ELSE 'tokens' END AS fault, count(*) AS n FROM d WHERE c = '' OR doc_id % 9 + 1 < 5 GROUP BY 1
UNION ALL SELECT 'not JSON', count(*) FROM labels WHERE quality = 0 HAVING count(*) > 0
UNION ALL SELECT 'metadata', count(*) FROM d WHERE c <> '' AND doc_id % 11 = 10 HAVING count(*) > 0""".replace("doc_id % 9 + 1 < 5 GROUP BY 1", "(doc_id % 9 + 1 < 5 AND doc_id % 11 <> 10) GROUP BY 1"))
def upload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upload would be refused for."""
    k = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        F.lit("t").alias("document_title"), F.when(k % 7 == 0, "").otherwise(F.repeat(F.lit("word "), (k % 9 + 1).cast("int"))).alias("content"),
        F.when(k % 11 == 10, '{"a":"x"}').otherwise('{"a":1}').alias("block_metadata"), k.alias("row"),
    )
    corrupt = read(spark, sf_dir, "labels").where("quality = 0").select(F.lit("x").alias("_corrupt_record"))
    return B.upload_faults(rows, corrupt)


@query("SELECT count(DISTINCT source) AS articles, (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en') AS kept, count(DISTINCT source) - (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en') AS skipped, round(100.0::DOUBLE * (count(DISTINCT source) - (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en')) / count(DISTINCT source), 6) AS skipped_percent, count(source) - count(DISTINCT source) AS duplicates FROM documents")
def step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles seen, kept and skipped, and duplicates, of a step."""
    d = read(spark, sf_dir, "documents")
    return B.run_counters(d, d.where("lang = 'en'"), "source")


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id FROM documents), b AS (SELECT row_number() OVER (ORDER BY item_id DESC) - 1 AS position, item_id FROM benchmark)
SELECT position, doc_id, item_id FROM a FULL JOIN b USING (position)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items side by side, by position."""
    return O.zip_rows(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "benchmark").select("item_id"), [F.col("doc_id")], [F.desc("item_id")])


@query("SELECT count(*) AS files, sum(p_size * 1000)::BIGINT AS bytes, round(sum(p_size * 1000) / 1e9, 9)::DOUBLE AS gigabytes FROM part")
def dump_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of an index page's lines."""
    line = F.concat(F.lit('<a href="'), "p_name", F.lit('">x</a> 01-Jan-2024 10:00   '), F.col("p_size") * 1000)
    lines = read(spark, sf_dir, "part").select(line.alias("value")).unionByName(spark.createDataFrame([("<hr>",), ("",)], "value string"))
    return A.dump_sizes(lines).withColumn("gigabytes", F.round("gigabytes", 9))


@query("SELECT max(release) AS release FROM (SELECT strftime(o_orderdate, '%Y-%m') AS release, count(*) AS files FROM orders GROUP BY 1) WHERE files >= 17")
def latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest month with enough files."""
    releases = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("release")).agg(F.count("*").alias("files"))
    return A.latest_complete(releases, 17)


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, round(1 - i / n::DOUBLE, 9) AS score FROM c""")
def list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that follow a ranked list's order."""
    lists = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list("turn"))).alias("ranked"))
    both = F.arrays_zip(F.col("ranked").alias("turn"), RR.list_scores("ranked").alias("score"))
    return lists.select("conv_id", F.inline(both).alias("turn", "score")).withColumn("score", F.round("score", 9))


@query("""
WITH c AS (SELECT conv_id, arg_min(text, turn) AS said FROM conversations GROUP BY 1), n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)
SELECT conv_id AS dialogue_id, said || '|more ' || said AS asked, 'Both [2], not [1].' AS agent_utterance, (SELECT string_agg(n_name, '|' ORDER BY k) FROM n WHERE k IN (1, 4)) AS cited FROM c""")
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn graph with deterministic models: queries and a claim, results de-duplicated across both, some without findings, citations renumbered."""
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("dialogue_id")).agg(F.min_by("text", "turn").alias("utterance")).withColumn("history", F.col("utterance"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("title"), F.lit("https://a.org").alias("url"), F.concat_ws(" ", "n_name", "n_nationkey").alias("content"))
    numbered = O.with_global_index(nations, [F.col("k")], "place")

    def search(queries: DataFrame, depth: int) -> DataFrame:
        # a claim finds what its query found, from the second on
        first = F.when(F.col("query_id").startswith("llm_claims"), 1).otherwise(0)
        found = queries.select("query_id", F.explode(F.sequence(first.cast("long"), (first + depth - 1).cast("long"))).alias("place"), first.alias("first"))
        return found.join(F.broadcast(numbered), "place").select("query_id", (F.col("place") - F.col("first") + 1).alias("rank"), "title", "url", "content")

    hooks = D.Hooks(
        queries=lambda h: F.array(h, F.concat(F.lit("more "), h)), claims=lambda h: F.array(h), draft=lambda h, passages: F.lit("Both [3], not [1]."),
        summary=lambda u, content: F.when(content.endswith(" 2"), "None").otherwise(F.concat(F.lit("- "), content)),
    )
    out = D.run_turns(turns, search, hooks, D.Config(query_pre=2, query_post=2, claim_pre=3, claim_post=3))
    return out.select("dialogue_id", F.array_join("search_query", "|").alias("asked"), "agent_utterance", F.array_join(F.transform("references", lambda r: r["title"]), "|").alias("cited"))


# ---- streaming, checked against the same windows over the table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = read(spark, sf_dir, "events").schema
    jvm_path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(kind).parquet(jvm_path if _is_dir(spark, jvm_path) else f"{jvm_path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drain(spark: SparkSession, frame: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream until its source is drained; the result as a table in the shared folder, rewritten by each micro-batch."""
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    q = frame.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(frame.schema).parquet(path).withColumn("total", F.round("total", 4))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums by type, as a stream."""
    return _drain(spark, W.tumbling(_stream(spark, sf_dir), "1 day", ["event_type"], "40 days"))


@query("""
WITH s AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events)
SELECT w AS window_start, w + INTERVAL 12 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2, 3""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hours, every six."""
    return _drain(spark, W.sliding(_stream(spark, sf_dir), "12 hours", "6 hours", ["event_type"], "40 days"))


@query("""
WITH l AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six quiet hours."""
    return _drain(spark, W.sessions(_stream(spark, sf_dir), "6 hours", ["user_id"], "40 days"))


@query("SELECT event_type AS id, max(event_id) AS newest FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they land, batch by batch, into a collection whose rows they replace."""
    store = R.Collection(spark, scratch(spark, "collections"), "latest")

    def upsert(df: DataFrame) -> None:
        new = df.groupBy(F.col("event_type").alias("id")).agg(F.max("event_id").alias("newest"))
        if store.exists():  # a batch that comes again changes nothing
            new = new.unionByName(store.read()).groupBy("id").agg(F.max("newest").alias("newest"))
        store.upsert(new)

    W.upsert_stream(_stream(spark, sf_dir), lambda df: df.where("event_type IS NOT NULL"), upsert, scratch(spark, "stream-state")).awaitTermination()
    return store.read()
