"""The queries over whole tables that apply these operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 8)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import sample_quality

    return sample_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language_id import fit_languages, held_out, identify_languages

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit_languages(docs.where(~F.col("held_out")))
    return identify_languages(docs, model, carry=("held_out",))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip of every text: its ids, and whether decoding them gives it back."""
    from pyspark.sql import functions as F

    from .pieces import PieceModel, decode_pieces, encode_pieces

    model = PieceModel.load(tokenizer("piece_bpe_32k.model"))
    encoded = encode_pieces(table(spark, sf_dir, "documents"), model, carry=("text",))
    whole = F.coalesce("text", F.lit("")) == F.col("decoded")
    return decode_pieces(encoded, model).select("doc_id", "n_pieces", whole.alias("round_trip"), "pieces")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .multi_index import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotations import link_quotations

    return link_quotations(table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, distance=3)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_kmeans import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def q_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11's edited texts alone."""
    return op11_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def q_license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 finds of the phrases alone."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def q_token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's sizes, and whether its counts lie between none and one for each byte, on the right side of the limit."""
    from pyspark.sql import functions as F

    fits = (F.col("n_tokens") <= F.col("n_bytes")) & ((F.col("n_tokens") > 0) == (F.col("n_bytes") > 0)) & (F.col("over_limit") == (F.col("n_tokens") > 512))
    return op10_token_counts(spark, sf_dir).select("doc_id", "n_bytes", fits.alias("fits"))


def q_shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's sizes, and by shard whether its slots have no gap and its bytes are within a twentieth of the mean."""
    from pyspark.sql import functions as F

    rows = op1_sharding(spark, sf_dir)
    loads = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum("size").alias("load")).collect()
    mean = sum(r["load"] for r in loads) / 8
    laws = spark.createDataFrame([(r["shard"], r["n"] == r["slots"] == r["high"] + 1 and r["low"] == 0, abs(r["load"] - mean) <= mean / 20) for r in loads], "shard int, gapless boolean, even boolean")
    return rows.join(F.broadcast(laws), "shard").select("doc_id", "size", "gapless", "even")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_sharding, op2_quality, op3_language_id, op4_pieces, op5_licenses, op6_multi_index, op7_quotations, op8_simhash, op9_decontamination, op10_token_counts, op11_fingerprints, op12_divergence, op13_ball_kmeans)
    return {f.__name__: f for f in (*numbered, q_edited_texts, q_license_base, q_token_bytes, q_shard_laws)}


#: Words as op5 takes them, and the phrases that name a license.
LICENSE_SQL = r"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
t as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) - 1 as i from w),
p as (select *, lead(a) over q as b, lead(a, 2) over q as c, lead(a, 3) over q as d from t window q as (partition by doc_id order by i)),
m as (select doc_id, i, case when a = 'under' and b = 'the' and c = 'mit' and d = 'license' then 'mit' when a = 'apache' and b = 'license' and c = 'version' and d = '2' then 'apache-2' when a = 'cc' and b = 'by' and c = 'nc' then 'cc-by-nc' end as label from p),
g as (select doc_id, count(*) as n, min(i) as low, max(i) as high, list_sort(list_distinct(list(label))) as labels from m where label is not null group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, low::bigint as first_word, high::bigint as last_word, coalesce(array_to_string(labels, ','), '') as base_labels from w left join g using (doc_id)"""


#: The last third of each text replaced by the beginning of the next by descending id, after the last that of the first.
EDITED_SQL = """with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select *, coalesce(lead(t) over w, first_value(t) over w) as o from d window w as (order by doc_id desc rows between unbounded preceding and unbounded following))
select doc_id, length(t)::bigint as n_chars, sha256(left(t, length(t) - length(t) // 3) || left(o, length(t) // 3)) as edited_sha256 from n"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; models, automata and hashes can't be."""
    from . import ball_kmeans_sql, divergence_sql, quotations_sql

    return {
        "op7_quotations": quotations_sql.SQL,
        "op12_divergence": divergence_sql.SQL,
        "op13_ball_kmeans": ball_kmeans_sql.SQL,
        "q_edited_texts": EDITED_SQL,
        "q_license_base": LICENSE_SQL,
        "q_token_bytes": "select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, true as fits from documents",
        "q_shard_laws": "select doc_id, (strlen(coalesce(text, '')) + 1)::bigint as size, true as gapless, true as even from documents",
    }
