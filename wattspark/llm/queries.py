"""Registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattspark.llm import common as C, licences, line_dedup, merkle, mixing, pii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    C.ship(spark)
    return spark.read.parquet(f"{d}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark, d):
    from wattspark.llm import token_files as T
    path = T.write_token_files(documents(spark, d), C.scratch(spark, "token-files"), vocabulary(), end_id=2)
    return T.read_token_files(spark, path, digest=True)


@query("op2_pii")
def op2_pii(spark, d):
    return pii.digest(pii.detect(documents(spark, d)))


@query("op3_quality_lines")
def op3_quality_lines(spark, d):
    from wattspark.llm import crf
    docs = documents(spark, d)
    return crf.judge(docs, crf.fit(docs, spark.read.parquet(f"{d}/labels.parquet")))


@query("op4_mixing")
def op4_mixing(spark, d):
    return mixing.calibrate(documents(spark, d))


ORACLE["op4_mixing"] = mixing.oracle()


@query("op5_token_counts")
def op5_token_counts(spark, d):
    from wattspark.llm import token_counts as T
    return T.count_tokens(documents(spark, d), vocabulary(), limit=1024)


@query("op6_decontaminate")
def op6_decontaminate(spark, d):
    from wattspark.llm import decontaminate as D
    return D.find(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


@query("op7_jaccard_classes")
def op7_jaccard_classes(spark, d):
    from wattspark.llm import groupjoin as G
    return G.classes(documents(spark, d))


@query("op8_language_id")
def op8_language_id(spark, d):
    from pyspark.sql import functions as F
    from wattspark.llm import langid as L
    docs = documents(spark, d)
    # null ids are neither learned from nor held out
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = L.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return L.predict(docs.withColumn("held_out", held_out), model, keep=["held_out"])


@query("op9_licences")
def op9_licences(spark, d):
    return licences.scan(documents(spark, d))


ORACLE["op9_licences"] = licences.oracle()


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, d):
    from wattspark.llm import suffixes as S
    out = S.dedup(documents(spark, d))
    return out.withColumn("touched", out["n_removed"] > 0)


@query("op11_line_dedup")
def op11_line_dedup(spark, d):
    return line_dedup.digest(line_dedup.dedup(documents(spark, d), min_docs=10, min_chars=1))


ORACLE["op11_line_dedup"] = line_dedup.oracle(min_docs=10, min_chars=1)


@query("op12_periodic_runs")
def op12_periodic_runs(spark, d):
    from wattspark.llm import periodic as P
    return P.digest(P.collapse(P.planted(documents(spark, d)), min_words=12))


@query("op13_merkle_manifest")
def op13_merkle_manifest(spark, d):
    docs = documents(spark, d)
    return merkle.digest(merkle.verify(docs, merkle.third(docs["doc_id"])))


ORACLE["op13_merkle_manifest"] = merkle.oracle()
