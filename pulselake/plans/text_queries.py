"""Queries over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.scalar import rnd as round_
from pulselake.plans import views
from pulselake.plans.base import Registry
from pulselake.plans.views import rnd
from pulselake.session import Scratch, read_table
from pulselake.text import corpus
from pulselake.text.vector_index import VectorIndex

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
TERMS = ["tion", "heit", "ción", "elle", "ing", "license", "token", "example"]
_STOP = ", ".join(f"'{w}'" for w in corpus.STOP)
_TOK = f"list_filter(string_split(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g')), '[^\\p{{L}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@query("doc_tokens", f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct, {_TOK}[1] AS first_token FROM documents")
def doc_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", corpus.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


_WORDS = f"words AS (SELECT doc_id, unnest({_TOK}) AS token FROM documents)"


@query("token_counts", f"WITH {_WORDS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM words GROUP BY 1 ORDER BY n DESC, token LIMIT 100")
def token_counts(spark, sf_dir):
    return corpus.token_counts(docs(spark, sf_dir))


@query("corpus_statistics", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, grouping(lang, source) AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def corpus_statistics(spark, sf_dir):
    d = docs(spark, sf_dir)
    d.createOrReplaceTempView("pulselake_docs")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, grouping_id(lang, source) AS level FROM pulselake_docs GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")


@query("topic_distribution", "SELECT lang AS topic, count(*) AS n FROM documents GROUP BY 1")
def topic_distribution(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("n"))


@query("keyword_relevance", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def keyword_relevance(spark, sf_dir):
    return corpus.relevant(docs(spark, sf_dir), ["license", "token"]).select("doc_id")


@query("keyword_topk", f"""WITH t AS (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term),
 h AS (SELECT term, count(*) AS n FROM documents JOIN t ON contains(lower(text), term) GROUP BY 1)
 SELECT term, n, round(n / max(n) OVER (), 4) AS score FROM h""")
def keyword_topk(spark, sf_dir):
    return corpus.keyword_scores(docs(spark, sf_dir), TERMS)


_PAIRS = f"{_WORDS}, v AS (SELECT token FROM words GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 40), d AS (SELECT DISTINCT doc_id, token FROM words WHERE token IN (SELECT token FROM v)), co AS (SELECT a.token AS a, b.token AS b, count(*) AS n FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.token < b.token GROUP BY 1, 2 HAVING count(*) >= 2)"


@query("keyword_cooccurrence", f"WITH {_PAIRS} SELECT a, b, n FROM co")
def keyword_cooccurrence(spark, sf_dir):
    return frequent_pairs(spark, sf_dir)


def frequent_pairs(spark, sf_dir):
    """Pairs among the 40 most frequent tokens; the tokens are written once and read twice."""
    held = docs(spark, sf_dir).select("doc_id", corpus.tokens(F.col("text")).alias("tokens"))
    held = Scratch(spark, "tokens").write(held, "tokens")
    return corpus.cooccurrence(held, corpus.token_counts(held, 40))


@query("related_terms", f"""WITH RECURSIVE {_PAIRS}, top AS (SELECT * FROM co ORDER BY n DESC, a, b LIMIT 60),
 e AS (SELECT a, b FROM top UNION SELECT b, a FROM top),
 s AS (SELECT min(a) AS t FROM top),
 w AS (SELECT t, 0 AS k FROM s UNION SELECT e.b, w.k + 1 FROM w JOIN e ON e.a = w.t WHERE w.k < 2)
 SELECT DISTINCT t AS term FROM w WHERE t NOT IN (SELECT t FROM s) ORDER BY 1 LIMIT 20""")
def related_terms(spark, sf_dir):
    top = frequent_pairs(spark, sf_dir).orderBy(F.desc("n"), "a", "b").limit(60)
    start = top.agg(F.min("a")).first()[0]
    return corpus.related_terms(top, start, 2)


@query("keyword_cooccurrence_all")
def keyword_cooccurrence_all(spark, sf_dir):
    """Each term's three strongest partners of all pairs; keyword_cooccurrence counts the words its SQL names."""
    return corpus.strongest_partners(docs(spark, sf_dir))


@query("related_terms_all")
def related_terms_all(spark, sf_dir):
    """related_terms over every term's strongest partners."""
    edges = Scratch(spark, "related").write(keyword_cooccurrence_all(spark, sf_dir).select(F.col("term").alias("a"), F.col("partner").alias("b")), "edges")
    start = edges.agg(F.min("a")).first()[0]
    return corpus.related_terms(edges, start, 2)


@query("html_fields", r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)), '') AS h1, len(regexp_extract_all(html, '(?i)<a\s')) AS links, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS paragraphs FROM pages""")
def html_fields(spark, sf_dir):
    return corpus.html_fields(read_table(spark, sf_dir, "pages")).drop("metas")


@query("page_slugs", r"SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM pages")
def page_slugs(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", corpus.slug(F.col("url")).alias("slug"))


@query("topic_similarity")
def topic_similarity(spark, sf_dir):
    t = corpus.text_similarity(docs(spark, sf_dir), ["tion", "elle", "heit", "shred"])
    return t.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("hashed_embedding")
def hashed_embedding(spark, sf_dir):
    return corpus.hashed_embedding(docs(spark, sf_dir).where("doc_id is not null")).groupBy("doc_id").agg(F.count("*").alias("places"), F.sum(F.col("v") * F.col("v")).alias("norm2"))


@query("vector_topk", f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
 d AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance FROM embeddings, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS nth FROM d) SELECT query_id, vec_id, {rnd('distance', 5)} AS distance, nth FROM r WHERE nth <= 3""")
def vector_topk(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return corpus.vector_topk(e, q, 3).withColumn("distance", round_("distance", 5))


@query("corpus_search", f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
 d AS (SELECT query_id, doc_id, text, lang, source, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance FROM embeddings JOIN documents ON doc_id = vec_id, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS nth FROM d) SELECT query_id, nth, doc_id, {rnd('distance', 5)} AS distance, text, lang, source FROM r WHERE nth <= 3""")
def corpus_search(spark, sf_dir):
    """The three documents nearest to every hundredth vector, through a new index of all documents with a vector; exact."""
    work = Scratch(spark, "corpus_search")
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.struct("lang", "source").alias("metadata"))
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = work.write(e.join(d, "vec_id"), "rows")
    index = VectorIndex(spark, f"{work.root}/index").learn(rows).append(rows)
    found = index.search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), exact=True, work=work)
    return found.select("query_id", F.col("nth").cast("long").alias("nth"), F.col("vec_id").alias("doc_id"), round_("distance", 5).alias("distance"), "text", "metadata.lang", "metadata.source")


@query("population_sql", f"WITH {views.BRONZE_SQL} SELECT patient_id, {rnd('avg(metric_value)', 6)} AS avg_heart_rate, count(*) AS n FROM bronze WHERE metric_type = 'heart_rate' GROUP BY 1")
def population_sql(spark, sf_dir):
    views.bronze(spark, sf_dir).createOrReplaceTempView("pulselake_bronze")
    return spark.sql("SELECT patient_id, floor(avg(metric_value) * 1000000 + 0.5 + 1e-7) / 1000000.0D AS avg_heart_rate, count(*) AS n FROM pulselake_bronze WHERE metric_type = 'heart_rate' GROUP BY patient_id")


@query("population_features")
def population_features(spark, sf_dir):
    h = lambda k, s: F.pmod(F.xxhash64("patient_id", F.lit(s)), F.lit(k))
    means = population_sql(spark, sf_dir)
    return means.select("patient_id", "avg_heart_rate", (20 + h(60, 1)).alias("age"), (h(40, 2) + 18).alias("bmi"), h(2, 3).alias("label"))
