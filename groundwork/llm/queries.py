"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("repeats_history")


def op2_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat_views import views

    out = views(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.withColumn("mask", mask)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import scored

    return scored(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import LONG_WORDS, without_repeated_spans

    return without_repeated_spans(_table(spark, sf_dir, "documents"), passage=LONG_WORDS)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import without_earlier_strings

    out = without_earlier_strings(_table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32(doc_id) ends in 0, the words from number a = g % n on are those of a period
    p = 1 + floor((n - a) / (3 + g % 8)), g being the rest of that number."""
    from pyspark.sql import functions as F

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"), F.size(words).alias("n"))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .periodic_runs import periodic_runs

    out = periodic_runs(_with_planted_repeats(_table(spark, sf_dir, "documents")))
    out = out.withColumn("longest", F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as low)))"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.back")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.low")).alias("period"), F.expr("1000 * longest.length div -longest.low").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_chat_views, op3_language_model, op4_best_fit_packing, op5_neighbours, op6_mixing, op7_pii, op8_sentence_spans, op9_near_dedup, op10_quality, op11_importance, op12_suffix_dedup, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            WITH t AS (
                SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
            ), h AS (SELECT doc_id, sha256(body) AS text_sha256 FROM t)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM h WINDOW w AS (PARTITION BY text_sha256)
        """,
        "op2_chat_views": r"""
            WITH t AS (
                SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
                FROM conversations
            ), p AS (
                SELECT DISTINCT conv_id AS of, role AS assistant FROM t WHERE role <> 'system'
            ), s AS (
                SELECT *, role = assistant AS own,
                       CASE WHEN role = 'system' THEN '<|im_start|>system' WHEN role = assistant THEN '<|im_start|>assistant'
                            ELSE '<|im_start|>user name=' || regexp_replace(replace(role, '<|', '< |'), '\s', '_', 'g') END || chr(10) AS head
                FROM t JOIN p ON conv_id IS NOT DISTINCT FROM of
            ), a AS (
                SELECT *, sum(length(head) + length(text) + 11) OVER (
                           PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS after
                FROM s
            )
            SELECT conv_id, assistant, 0::BIGINT AS part, 0::BIGINT AS start, count(*)::INT AS n_turns, (count(*) FILTER (own))::INT AS n_trained,
                   string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
                   coalesce(string_agg((after - 11 - length(text))::BIGINT || ':' || (after - 1)::BIGINT, ',' ORDER BY after) FILTER (own), '') AS mask
            FROM a GROUP BY conv_id, assistant
        """,
        "op11_importance": r"""
            WITH tbl AS (
                SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
            ), texts AS (
                SELECT 's' AS corpus, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
            ), rows AS (
                SELECT row_number() OVER () AS r, corpus, doc_id,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                FROM texts
            ), feats AS (
                SELECT r, corpus, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM rows
            ), per AS (SELECT r, corpus, f, count(*) AS n FROM feats GROUP BY ALL
            ), hashed AS (
                SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
                       lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
                FROM (SELECT DISTINCT f FROM per), tbl
            ), b AS (SELECT r, corpus, bucket, sum(n) AS n FROM per JOIN hashed USING (f) GROUP BY ALL
            ), c AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 's'), 0) AS s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS t FROM b GROUP BY bucket
            ), gains AS (
                SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c
            ), sums AS (SELECT r, sum(n * gain) AS gain, sum(n)::BIGINT AS n FROM b JOIN gains USING (bucket) GROUP BY r
            ), scored AS (
                SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
                       coalesce(CASE WHEN gain % n < 0 THEN (gain - gain % n) // n - 1 ELSE (gain - gain % n) // n END, 0)::BIGINT AS weight,
                       ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
                FROM rows LEFT JOIN sums USING (r) WHERE corpus = 's'
            ), noisy AS (
                SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM noisy
            )
            SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked
        """,
        "op12_suffix_dedup": """
            WITH t AS (
                SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents
            ), w AS (
                SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, x, unnest(range(n_bytes - 49)) AS i FROM t)
            ), f AS (
                SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1
            ), hit AS (
                SELECT DISTINCT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id
            ), runs AS (
                SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
                FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)
            ), spans AS (
                SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run
            ), kept AS (
                SELECT doc_id, substr(x, 2 * lag(b, 1, 0) OVER o + 1, 2 * (a - lag(b, 1, 0) OVER o)) AS piece, a, b FROM spans JOIN t USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY a)
            ), by_doc AS (
                SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(piece, '' ORDER BY a) AS head FROM kept GROUP BY doc_id
            )
            SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
                   sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
            FROM t LEFT JOIN by_doc USING (doc_id)
        """,
        "op13_periodic_runs": r"""
            WITH tbl AS (
                SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
            ), d AS (
                SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                       xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
                FROM documents, tbl
            ), g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d
            ), a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g
            ), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
            ), words AS (
                SELECT doc_id, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
                FROM (SELECT *, unnest(range(n)) AS i FROM p)
            ), grams AS (
                SELECT doc_id, i, hash(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS gram, n FROM words
            ), pairs AS (
                SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
                FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
                WHERE y.i + 6 <= y.n
            ), stretches AS (
                SELECT doc_id, min(i) AS start, count(*) + 5 + q AS length, q AS period FROM pairs GROUP BY doc_id, q, island
            ), runs AS (
                SELECT doc_id, start, length, min(period) AS period FROM stretches WHERE length >= 12 AND length >= 2 * period GROUP BY doc_id, start, length
            ), dropped AS (
                SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
            ), by_run AS (
                SELECT doc_id, count(*) AS n_runs, max(struct_pack(a := length, b := -start, c := -period)) AS top,
                       string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
                FROM runs GROUP BY doc_id
            ), kept AS (
                SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
            )
            SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -top.b AS start, top.a AS length, -top.c AS period, (1000 * top.a // -top.c)::BIGINT AS exponent_milli,
                   sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
            FROM documents LEFT JOIN by_run USING (doc_id) LEFT JOIN kept USING (doc_id)
        """,
    }
