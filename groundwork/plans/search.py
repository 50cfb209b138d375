"""Retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions.text import STOPWORDS, collapse_umlauts, question_language, stem, words
from ..operators import retrieval as R
from .registry import query, table

#: Passages up to which their words are broadcast; more meet the documents' words in a shuffle.
PROBE_ITEMS = 100_000

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = (
    "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN ("
    + _STOP
    + ")), lambda w: left(replace(replace(replace(w, 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), 6)))"
)


def _tokens(text):
    """Tokens of text that is taken as folded once in lower case: what the SQL can say too."""
    kept = F.filter(words(F.lower(text)), lambda w: ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda w: stem(collapse_umlauts(w))))


def document_fields(docs: DataFrame) -> DataFrame:
    """doc_id, field, token: the first line is a document's label, the rest its description."""
    line = F.split("text", "\n", 2)
    parts = docs.select("doc_id", F.get(line, F.lit(0)).alias("label"), F.coalesce(F.get(line, F.lit(1)), F.lit("")).alias("rest"))
    both = F.array(F.struct(F.lit("label").alias("field"), _tokens(F.col("label")).alias("tokens")), F.struct(F.lit("description").alias("field"), _tokens(F.col("rest")).alias("tokens")))
    return parts.select("doc_id", F.explode(both).alias("f")).select("doc_id", "f.field", F.explode("f.tokens").alias("token"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(_tokens(F.col("text"))).alias("token"))


_FIELDS = f"""
    fields AS (
        SELECT doc_id, 'label' AS field, unnest({_TOKENS.format("split_part(text, chr(10), 1)")}) AS token FROM documents
        UNION ALL
        SELECT doc_id, 'description', unnest({_TOKENS.format("CASE WHEN contains(text, chr(10)) THEN text[strpos(text, chr(10)) + 1:] ELSE '' END")}) FROM documents
    ), total AS (SELECT count(DISTINCT doc_id) AS n FROM fields),
    df AS (SELECT token, count(DISTINCT doc_id) AS df, ln(1 + any_value(n) / count(DISTINCT doc_id)) AS idf FROM fields, total GROUP BY token)
"""
_HITS = f"""
    {_FIELDS}, asked AS (
        SELECT item_id, token, coalesce(idf, ln(1 + n)) AS idf, ln(1 + n) AS rarest
        FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark) LEFT JOIN df USING (token), total
        WHERE NOT coalesce(n >= 8 AND df >= 0.75 * n, false)
    ), mass AS (SELECT item_id, sum(idf) AS mass, max(rarest) AS rarest FROM asked GROUP BY ALL),
    best AS (SELECT doc_id, token, max(CASE field WHEN 'label' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS w, bool_or(field = 'label') AS anchor FROM fields GROUP BY ALL),
    scored AS (
        SELECT item_id, doc_id, round(sum(w * idf), 9) AS score, sum(idf) FILTER (anchor) AS anchored
        FROM asked JOIN best USING (token) GROUP BY ALL HAVING anchored IS NOT NULL
    ), top AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 3
    ), hits AS (
        SELECT item_id, doc_id, score, rank, anchored / mass AS share, anchored / rarest AS weight FROM top JOIN mass USING (item_id)
        QUALIFY score >= 0.2 * max(score) OVER (PARTITION BY item_id)
    )
"""


@query(f"WITH {_FIELDS} SELECT token, df, round(idf, 6) AS idf FROM df")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.document_frequency(document_fields(table(spark, sf_dir, "documents")), "doc_id")
    return df.select("token", "df", F.round("idf", 6).alias("idf"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_hits(passages(spark, sf_dir), document_fields(table(spark, sf_dir, "documents")), "item_id", "doc_id")


@query(f"WITH {_HITS} SELECT item_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM hits")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"""
    WITH {_HITS}
    SELECT item_id, round(max(share), 4) AS share, round(max(weight), 4) AS weight,
           CASE WHEN max(weight) >= 1.5 OR max(share) >= 0.5 THEN 'strong' ELSE 'weak' END AS verdict
    FROM hits GROUP BY item_id
""")
def match_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _hits(spark, sf_dir).groupBy("item_id").agg(F.max("share").alias("share"), F.max("weight").alias("weight"))
    none = F.lit(None).cast("double")  # no semantic signal: words alone decide
    return best.select("item_id", F.round("share", 4).alias("share"), F.round("weight", 4).alias("weight"), S.verdict(F.col("share"), F.col("weight"), none).alias("verdict"))


_NEAR = """
    q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
    long AS (SELECT query_id, vec_id, unnest(e)::DOUBLE AS x, unnest(embedding)::DOUBLE AS y FROM embeddings, q),
    scored AS (SELECT query_id, vec_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cosine FROM long GROUP BY ALL)
"""


@query(f"""
    WITH {_NEAR}
    SELECT query_id, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank
    FROM scored WHERE cosine >= 0.5 QUALIFY rank <= 10
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all rows, in blocks."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    out = R.cosine_top(asked, rows, None, "query_id", "vec_id")
    return out.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


@query("""
    WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50),
    b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC, toxic, doc_id) AS r
          FROM documents JOIN labels USING (doc_id) QUALIFY r <= 50)
    SELECT source, doc_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 6) AS score
    FROM a FULL JOIN b USING (source, doc_id)
""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    w = Window.partitionBy("source")
    long = docs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id"))).filter("rank <= 50")
    good = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("rank", F.row_number().over(w.orderBy(F.desc("quality"), "toxic", "doc_id"))).filter("rank <= 50")
    return R.fuse([long, good], ["source", "doc_id"]).select("source", "doc_id", F.round("score", 6).alias("score"))


@query("""
    WITH w AS (SELECT item_id, text, regexp_extract(text, '[^ ]+') AS first FROM benchmark)
    SELECT DISTINCT item_id, doc_id FROM w JOIN documents d ON contains(d.text, w.text)
""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage. Words narrow the pairs by an equi-join; whole texts decide."""
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the passage's longest inner word, between spaces, must be a word of the document
    inner = F.filter(F.slice(F.split("text", " "), F.lit(2), F.greatest(F.size(F.split("text", " ")) - 2, F.lit(0))), lambda w: w != "")
    rare = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    keyed = items.select("item_id", F.col("text").alias("passage"), rare["word"].alias("word"))
    few = items.count() <= PROBE_ITEMS
    probe = lambda df: F.broadcast(df) if few else df
    # a document's words meet the probe words where they are read; only those that match are shuffled
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    asked = keyed.filter("word is not null")
    narrowed = terms.join(probe(asked.select("word").distinct()), "word", "left_semi")
    pairs = narrowed.join(probe(asked), "word").select("doc_id", "item_id", "passage")
    found = pairs.join(docs, "doc_id").filter(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    bare = keyed.filter("word is null").select("item_id", "passage")  # passages of one or two words: no word to join on
    if not bare.isEmpty():
        found = found.unionByName(docs.join(bare, F.contains("text", F.col("passage"))).select("item_id", "doc_id"))
    return found.distinct()


@query(f"""
    WITH {_HITS}, truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    n AS (SELECT item_id, count(*) AS expected FROM truth GROUP BY ALL)
    SELECT item_id, any_value(expected) AS expected, round(count(hits.doc_id) FILTER (rank <= 3 AND truth.doc_id IS NOT NULL) / any_value(expected)::DOUBLE, 6) AS recall_3,
           coalesce(bool_or(rank = 1 AND truth.doc_id IS NOT NULL), false) AS top_1
    FROM n LEFT JOIN hits USING (item_id) LEFT JOIN truth USING (item_id, doc_id) GROUP BY item_id
""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = contamination(spark, sf_dir).withColumn("true", F.lit(True))
    n = truth.groupBy("item_id").agg(F.count("*").alias("expected"))
    hits = _hits(spark, sf_dir).select("item_id", "doc_id", "rank")
    good = hits.join(truth, ["item_id", "doc_id"]).groupBy("item_id").agg(F.count("*").alias("got"), F.bool_or(F.col("rank") == 1).alias("first"))
    out = n.join(good, "item_id", "left")
    return out.select("item_id", "expected", F.round(F.coalesce("got", F.lit(0)) / F.col("expected"), 6).alias("recall_3"), F.coalesce("first", F.lit(False)).alias("top_1"))


# Fixed lists for the vote: function words of two languages
LANGUAGES = {"en": ["the", "of", "and", "to", "is", "what", "how", "which"], "de": ["der", "die", "und", "das", "ist", "wie", "was", "welche"]}


@query("""
    WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: true) AS words FROM documents),
    c AS (SELECT lang, len(list_filter(words, lambda x: x IN ('the','of','and','to','is','what','how','which'))) AS en,
                 len(list_filter(words, lambda x: x IN ('der','die','und','das','ist','wie','was','welche'))) AS de FROM w)
    SELECT lang, CASE WHEN en > de THEN 'en' WHEN de > en THEN 'de' END AS voted, count(*) AS documents FROM c GROUP BY ALL
""")
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = question_language(F.col("text"), LANGUAGES)
    return table(spark, sf_dir, "documents").groupBy("lang", voted.alias("voted")).agg(F.count("*").alias("documents"))


@query(f"""
    WITH t AS (SELECT source, doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents),
    n AS (SELECT source, token, count(*) AS documents FROM t GROUP BY ALL)
    SELECT source, token, documents, row_number() OVER (PARTITION BY source ORDER BY documents DESC, token)::INT AS rank FROM n QUALIFY rank <= 20
""")
def source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("source", F.explode(_tokens(F.col("text"))).alias("token"))
    n = t.groupBy("source", "token").agg(F.count("*").alias("documents"))
    order = Window.partitionBy("source").orderBy(F.desc("documents"), "token")
    return n.withColumn("rank", F.row_number().over(order)).filter("rank <= 20").select("source", "token", "documents", "rank")
