"""Line dedup (operator 11): lines that many documents share are dropped everywhere.

A text is split at newlines; a line's key is the line without ASCII white space at both ends and with
A-Z lower-cased. Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` documents
lose all their lines in all documents; the other lines are joined by newlines again, in their order.

DataFrame functions only. Each row gets a number and the hashes of its lines, 128 bits of SHA-256 each, and
is written to shared scratch; everything after that moves hashes and positions, not lines:

* documents per hash: (hash, document) pairs are made distinct, then counted; both steps combine before
  they shuffle, so a line of every document costs a row per task, not one per document;
* the frequent hashes that hold at least one in ``HOT`` of all pairs are at most ``HOT`` many whatever the
  input's size: these are broadcast. The others are joined by hash, where none has more than that share;
* what is dropped is gathered as positions per row, never per hash or per document id, and the row's own
  number joins it to the row. A row without dropped lines meets nothing.

Defined results: a null or empty text is one empty line, whose key has no code points and is never dropped while
``min_chars`` is 1 or more; a text that loses all lines becomes empty; rows of the same ``doc_id`` are one document for
the counts (so are those with a null id), and each is cut by itself; extra columns pass through ``dedup``
untouched, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattspark.llm.common import settle

#: at most so many hashes are broadcast
HOT = 20_000
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    # without other than one-byte characters ``lower`` does the same, faster
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(key: Column, min_chars: int) -> Column:
    """128 bits of SHA-256; null for keys that are too short to count."""
    return F.when(F.char_length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent(lines: DataFrame, min_docs: int) -> DataFrame:
    """``h, n``: hashes of ``lines`` (``doc, h``) that occur in at least ``min_docs`` documents."""
    return lines.groupBy("h", "doc").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows of ``docs`` with ``text`` cut, and ``n_lines`` and ``n_dropped`` (before / by the cut) as last columns."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    inner = F.struct(*[docs[c] for c in columns]).alias("row")  # the caller's names can't meet those used here
    hashes = F.transform(_lines(docs["text"]), lambda x: key_hash(line_key(x), min_chars))
    rows = settle(docs.select(F.monotonically_increasing_id().alias("r"), docs["doc_id"].alias("doc"), inner, hashes.alias("hs")), "lines")

    many = settle(frequent(rows.select("doc", F.explode("hs").alias("h")).where("h IS NOT NULL"), min_docs), "frequent")
    pairs = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, cold = many.where(F.col("n") * HOT >= pairs).select("h"), many.where(F.col("n") * HOT < pairs).select("h")

    at = rows.select("r", F.posexplode("hs").alias("pos", "h")).where("h IS NOT NULL").join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "h", "left")
    rest = at.where("is_hot IS NULL").select("h", "r", "pos").join(cold, "h", "left_semi")
    gone = at.where("is_hot").select("r", "pos").unionByName(rest.select("r", "pos")).groupBy("r").agg(F.collect_list("pos").alias("gone"))

    lines = _lines(F.col("row.text"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))  # ascending, each once
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col("all"), i)), "\n"))
    out = rows.select("r", "row", lines.alias("all")).join(gone, "r", "left")
    fields = [kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    return out.select(*fields, F.size("all").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(cut: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of ``dedup``'s rows."""
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle(min_docs: int = 10, min_chars: int = 1, documents: str = "documents") -> str:
    """DuckDB SQL for ``digest(dedup(documents))``."""
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
 lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM texts),
 keyed AS (SELECT *, translate(trim(line, {blank}), '{UPPER}', '{LOWER}') AS k FROM lines),
 many AS (SELECT k FROM keyed WHERE length(k) >= {min_chars} GROUP BY k HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= {min_docs})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM many)) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM many)), '')) AS kept_sha256
FROM keyed GROUP BY r"""
