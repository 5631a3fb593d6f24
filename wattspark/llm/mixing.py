"""Mixing sources to target weights (operator 4): iterative proportional fitting, then sampling.

Token counts per (source, language, topic) cell are raked: in turn for source, language and topic,
each cell's weight is multiplied by target share / present share of its margin value, for a fixed number
of sweeps. A cell's weight over its token count, with mean 1 over all tokens, calibrates its documents:
each is expected ``rate * weight`` times in the sample, drawn by a hash of its id, so a lost task redraws
the same. ``copies`` says how often: ``sample`` returns a document that many times, without a limit, so that its token
shares meet the targets. Targets default to the margin's own shares to the power ``alpha``, renormalised (1: as is,
0: uniform); a table of (dimension, value, share) can be given instead, whose missing values get 0.

DataFrame functions only. Cells come from a partial (map-side) aggregate, so a hot source costs one
row per task. Margins are aggregates joined back to the cells; each is joined by Spark's choice. Each
step's cells are written to shared scratch, which keeps plans short and survives lost executors.

Tokens are estimated by words. The topic is the first of ``TOPICS`` whose predicate holds.

Defined results: null source or language is the value ``(none)``; a null or empty text has 0 tokens and
counts in no margin, its weight is that of its cell if that has tokens, else 0; rows with the same id draw alike;
an empty table gives an empty result; extra columns pass through ``sample`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattspark.llm.common import settle

DIMENSIONS = ("source", "lang", "topic")
#: (topic, words of which one must be in the text); the last holds for every other text
TOPICS = [("tabular", [" | "]), ("legal", ["icense", "rights reserved", "opyright"]), ("contact", ["@"]), ("prose", [])]
CELLS_A_TASK = 100_000


def topic_of(text: Column) -> Column:
    """The first of ``TOPICS`` of which a word occurs."""
    out = None
    for name, words in TOPICS[:-1]:
        has = F.lit(False)
        for w in words:
            has = has | text.contains(w)
        out = F.when(has, F.lit(name)) if out is None else out.when(has, F.lit(name))
    return out.otherwise(F.lit(TOPICS[-1][0]))


def _cell_columns(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(docs["text"], F.lit(""))
    return {"source": F.coalesce(docs["source"], F.lit("(none)")), "lang": F.coalesce(docs["lang"], F.lit("(none)")), "topic": topic_of(text),
            "n_tokens": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")}


def targets_of(cells: DataFrame, alpha: float) -> DataFrame:
    """(dimension, value, share): each margin's shares to the power ``alpha``, renormalised."""
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])).alias("m"), "tokens").select("m.*", "tokens")
    power = long.groupBy("dimension", "value").agg(F.sum("tokens").alias("tokens")).select("dimension", "value", F.pow("tokens", F.lit(alpha)).alias("p"))
    whole = power.groupBy("dimension").agg(F.sum("p").alias("all"))
    return power.join(whole, "dimension").select("dimension", "value", (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: DataFrame, sweeps: int) -> DataFrame:
    """``cells`` (``source, lang, topic, tokens``) with ``weight``: raked share over token share."""
    n, whole = cells.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    out = cells.select(*DIMENSIONS, "tokens", (F.col("tokens") / F.lit(float(max(whole, 1)))).alias("w"))
    for _ in range(sweeps):
        for d in DIMENSIONS:
            # one row per value of the margin
            margin = out.groupBy(d).agg(F.sum("w").alias("have")).join(targets.where(F.col("dimension") == d).select(F.col("value").alias(d), "share"), d, "left")
            factor = margin.select(d, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("f"))
            # the weights are used twice in each step: written, or the plan would double with every step
            out = settle(out.join(factor, d).select(*DIMENSIONS, "tokens", (F.col("w") * F.col("f")).alias("w")).coalesce(1 + n // CELLS_A_TASK), "raked")
    return out.select(*DIMENSIONS, (F.col("w") * F.lit(float(max(whole, 1))) / F.col("tokens")).alias("weight"))


def margin_error(weights: DataFrame, cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``dimension, error``: per margin the largest relative difference between a value's weighted token share and its target
    (of targets above 0 that some cell can meet)."""
    n = cells.join(weights, list(DIMENSIONS)).withColumn("w", F.col("tokens") * F.col("weight"))
    long = n.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])).alias("m"), "w").select("m.*", "w")
    whole = long.groupBy("dimension").agg(F.sum("w").alias("all"))
    have = long.groupBy("dimension", "value").agg(F.sum("w").alias("w")).join(whole, "dimension").join(targets.where("share > 0"), ["dimension", "value"])
    return have.groupBy("dimension").agg(F.max(F.abs(F.col("w") / F.col("all") / F.col("share") - 1)).alias("error"))


def _draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the id's md5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def _copies(weight: Column, draw: Column, rate: float) -> Column:
    want = F.round(weight * rate, 9)
    return (F.floor(want) + F.when(draw < want - F.floor(want), 1).otherwise(0)).cast("long")


def weigh(docs: DataFrame, alpha: float = 0.5, sweeps: int = 6, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(slim rows ``doc_id, source, lang, topic, n_tokens``, weight per cell)."""
    slim = settle(docs.select(docs["doc_id"], *[c.alias(n) for n, c in _cell_columns(docs).items()]), "slim")
    cells = settle(slim.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return slim, rake(cells, targets if targets is not None else settle(targets_of(cells, alpha), "targets"), sweeps)


def calibrate(docs: DataFrame, alpha: float = 0.5, sweeps: int = 6, rate: float = 1.0, seed: str = "mix", targets: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, copies`` for every row of ``docs``."""
    slim, weights = weigh(docs, alpha, sweeps, targets)
    rows = slim.join(weights, list(DIMENSIONS), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return rows.select("doc_id", *DIMENSIONS, "n_tokens", F.round("weight", 6).alias("weight"), _copies(F.col("weight"), _draw(F.col("doc_id"), seed), rate).alias("copies"))


def sample(docs: DataFrame, alpha: float = 0.5, sweeps: int = 6, rate: float = 1.0, seed: str = "mix", targets: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as many times as the calibrated draw takes it, with all their columns."""
    _, weights = weigh(docs, alpha, sweeps, targets)
    weights = weights.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("weight").alias("__weight"))
    keys = {f"__{n}": c for n, c in _cell_columns(docs).items() if n in DIMENSIONS}
    rows = docs.withColumns(keys).join(weights, list(keys), "left")
    rows = rows.withColumn("__copies", _copies(F.coalesce("__weight", F.lit(0.0)), _draw(F.col("doc_id"), seed), rate)).where("__copies >= 1")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def oracle(alpha: float = 0.5, sweeps: int = 6, rate: float = 1.0, seed: str = "mix", documents: str = "documents") -> str:
    """DuckDB SQL for ``calibrate(documents)``."""
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{w}')" for w in words) + f" THEN '{name}'" for name, words in TOPICS[:-1]) + f" ELSE '{TOPICS[-1][0]}' END"
    sql = f"""WITH slim AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic,
   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {documents}),
 cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM slim WHERE n_tokens > 0 GROUP BY ALL),
 w0 AS MATERIALIZED (SELECT *, sum(tokens) OVER () AS whole, tokens / sum(tokens) OVER () AS w FROM cells)"""
    for d in DIMENSIONS:
        sql += f",\n t_{d} AS MATERIALIZED (SELECT {d} AS v, pow(sum(tokens), {alpha}) / sum(pow(sum(tokens), {alpha})) OVER () AS share FROM cells GROUP BY {d})"
    k = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            sql += f",\n w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, whole, w * (share / sum(w) OVER (PARTITION BY {d})) AS w FROM w{k} JOIN t_{d} ON v = {d})"
            k += 1
    draw = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{seed}'), 1, 13) AS BIGINT) AS DOUBLE) / {float(16 ** 13)!r}"
    return sql + f"""
, final AS (SELECT slim.*, coalesce(w * whole / tokens, 0.0) AS weight, {draw} AS draw FROM slim LEFT JOIN w{k} USING (source, lang, topic)),
 wanted AS (SELECT *, round(weight * {rate}, 9) AS want FROM final)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, CAST(floor(want) + CASE WHEN draw < want - floor(want) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM wanted"""
