"""The registered queries of the subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .ann import nearest_neighbours
from .bitsliced import ranked_search
from .langid import fit_languages, predict_languages, trainable
from .mixing import mix_sources
from .ngram_join import similar_groups
from .packing import pack_documents, public_tokenizer
from .passages import repeated_passages
from .phrases import phrase_collocations
from .quality import fit_quality, held_out, score_quality
from .sharding import shard_documents
from .topk import exact_topk
from .toxicity import fit_toxicity, score_toxicity
from .warc import warc_round_trip


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best candidates of each vector whose id is divisible by 100."""
    return exact_topk(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_ngram_groups(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the group that five-word shingles and a similarity of 0.75 give them."""
    return similar_groups(_table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return warc_round_trip(_table(spark, folder, "pages"))


def op4_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix with weights 3, 1, 2 and 150 % of all words takes of each document."""
    return mix_sources(_table(spark, folder, "documents"))


def op5_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(_table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"))


def op6_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs = _table(spark, folder, "documents")
    learned = trainable(F.col("doc_id"))
    model = fit_languages(docs.filter(learned))
    return predict_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (~learned).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    """24 shards of near equal size."""
    return shard_documents(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """20 near neighbours of each vector whose id is divisible by 20."""
    return nearest_neighbours(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document, learned from the labels of four of five folds."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held = held_out(F.col("doc_id"), 5, 0)
    learned = labels.filter(~held & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(docs.select("doc_id", "text"), learned)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that repeat one of a document with a smaller id."""
    return repeated_passages(_table(spark, folder, "documents"))


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents of each benchmark item."""
    return ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of four of five folds."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held = held_out(F.col("doc_id"), 5, 0)
    learned = labels.filter(~held & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs.select("doc_id", "text"), learned)
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of 2 to 4 words of each language."""
    return phrase_collocations(_table(spark, folder, "documents"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_ngram_groups": op2_ngram_groups,
    "op3_warc": op3_warc,
    "op4_mixed_sources": op4_mixed_sources,
    "op5_packed": op5_packed,
    "op6_languages": op6_languages,
    "op7_shards": op7_shards,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_passages": op10_passages,
    "op11_lexical": op11_lexical,
    "op12_toxicity": op12_toxicity,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_lexical": r"""
        WITH t AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
        ), sizes AS (
            SELECT r, count(*) AS n FROM t GROUP BY r
        ), corpus AS (
            SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM sizes
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), tf AS (
            SELECT r, doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL
        ), w AS (
            SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, corpus GROUP BY term, documents
        ), s AS (
            SELECT item_id, r, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN sizes USING (r), corpus
            GROUP BY item_id, r, doc_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM s WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op13_phrases": r"""
        WITH p AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                  FROM documents)
        ), g AS (
            SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))
        ), f AS (
            SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase
        ), t AS (
            SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30
        ), cuts AS (
            SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS m FROM c
        ), s AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, m, x.a AS l, y.a AS r,
                   ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
            FROM cuts
            JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:m], ' ')
            JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[m + 1:], ' ')
        ), lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) AS o FROM s
        ), spots AS (
            SELECT lang, a, w, unnest(range(1, len(w) + 1)) AS i FROM c WHERE k > 2
        ), windows AS (
            SELECT lang, a, w, i, unnest(range(i + 1, len(w) + 1)) AS j FROM spots
        ), inside AS (
            SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer
            FROM windows WHERE j - i + 1 < len(w) GROUP BY ALL
        ), ranked AS (
            SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank
            FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
            WHERE o = 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)
        )
        SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t ON t.lang = ranked.lang WHERE rank <= 2000
    """,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
