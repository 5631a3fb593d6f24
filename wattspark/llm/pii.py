"""PII (operator 2): patterns find entities, corpus co-occurrence finds the terms that reveal them.

Entities are e-mail addresses, IP addresses, card and phone numbers. A term that stands in a document with an
entity, at any distance, discloses it as far as seeing the term tells of the entity: with document frequencies over
the whole corpus, ``PMI(entity; term) / IC(entity)``, which is 1 if the term is never seen elsewhere. In documents
with the entity, all occurrences of terms of at least ``generalise`` are generalised, those of at least ``remove``
removed, if ``support`` different texts show the pair (by default one text, or copies of one, is no evidence).

Terms are runs of letters, marks and digits outside the entities, compared in lower case, and one definition of
"the document has the term" serves every count. A run of letters under four characters is replaced only in a
document that has it with a capital (names), so that short function words stay.

DataFrame functions only. The document frequency of every term comes from one partial aggregate over the whole
corpus. Pairs are made only of entities that ``support`` texts have, once for each different text (copies are
counted), and added up by a partial aggregate; nothing is broadcast but by Spark's own size check.

Offsets count code points. Defined results: a null text counts as empty and has no spans; rows equal in id
and text get the same spans; an empty table gives an empty result; extra columns pass through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattspark.llm.common import settle

# fixed values: the patterns of the base kinds. The first part of an address and of an IP starts only where a
# run starts (or the last match ended), and loops are possessive: same matches, but linear in the text.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: cheap conditions without which a text has no span of the kind
MAYBE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{M}\p{N}]++"
#: letters that a term needs to be replaced in lower case
LETTERS = 4
_EMPTY = "cast(array() as array<struct<s:int,e:int,v:string>>)"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _spans(text: str, pattern: str) -> str:
    """SQL: all matches as structs (start, end, text), from the pieces between them and their lengths."""
    p = _quoted(pattern)
    return f"""aggregate(
      filter(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (a, b) -> named_struct('a', length(a), 'b', length(b), 'v', b)), z -> z.v is not null),
      named_struct('pos', 0, 'out', {_EMPTY}),
      (acc, z) -> named_struct('pos', acc.pos + z.a + z.b, 'out', concat(acc.out, array(named_struct('s', acc.pos + z.a, 'e', acc.pos + z.a + z.b, 'v', z.v)))),
      acc -> acc.out)"""


def entities(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and per kind an array of its base spans."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.select("doc_id", "text", *[
        F.when(MAYBE[k](F.col("text")), F.filter(F.expr(_spans("text", p)), _valid(k))).otherwise(F.expr(_EMPTY)).alias(k)
        for k, p in KINDS.items()])


def _valid(kind: str):
    def check(x: Column) -> Column:
        digits = F.regexp_replace(x["v"], "[^0-9]", "")
        if kind == "ip":
            return x["v"].rlike(f"^{_BYTE}(?:[.]{_BYTE}){{3}}$")
        if kind == "card":
            return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)
    return check


#: SQL: ``text`` with blanks for the spans of ``every``, so that offsets stay
_MASKED = """aggregate(sort_array(every), named_struct('pos', 0, 'out', ''),
      (acc, x) -> named_struct('pos', greatest(acc.pos, x.e), 'out', if(x.e > acc.pos,
        concat(acc.out, substring(text, acc.pos + 1, greatest(x.s - acc.pos, 0)), repeat(' ', x.e - greatest(x.s, acc.pos))), acc.out)),
      acc -> concat(acc.out, substring(text, acc.pos + 1)))"""


def find(docs: DataFrame) -> DataFrame:
    """Base spans of each row, settled: ``doc_id, h1, h2``, the kinds, ``entities`` and ``words`` (both different
    ones), and of rows with an entity ``masked``, the text with blanks for them."""
    rows = entities(docs)
    every = "concat(" + ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'entity', concat('{k}:', lower(x.v))))" for k in KINDS) + ")"
    rows = rows.withColumn("every", F.expr(every))
    rows = rows.withColumn("masked", F.when(F.size("every") > 0, F.expr(_MASKED)))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("masked", "text"), F.lit(TERM), F.lit(0)), F.lower))
    return settle(rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                              *[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS],
                              F.array_distinct(F.transform("every", lambda x: x["entity"])).alias("entities"), words.alias("words"), "masked"), "pii")


def holders(found: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(``entity, of_entity`` of the entities that ``support`` texts have; the texts with such, once each:
    ``h1, h2, copies, held, words``, settled)."""
    rows = found.where(F.size("entities") > 0)
    known = settle(rows.select("h1", F.explode("entities").alias("entity")).groupBy("entity")
                   .agg(F.count("*").alias("of_entity"), F.count_distinct("h1").alias("texts")).where(F.col("texts") >= support).drop("texts"), "pii-known")
    # the words stay behind while the entities are looked up
    held = (rows.select("h1", "h2", "entities").dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode("entities").alias("entity"))
            .join(known, "entity").groupBy("h1", "h2").agg(F.collect_list("entity").alias("held")))
    texts = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    return known, settle(held.join(texts, ["h1", "h2"]), "pii-held")


def _pairs(texts: DataFrame) -> DataFrame:
    return texts.select("h1", "h2", "copies", F.explode("held").alias("entity"), "words").select("h1", "h2", "copies", "entity", F.explode("words").alias("term"))


def disclosures(found: DataFrame, known: DataFrame, texts: DataFrame, generalise: float, support: int) -> DataFrame:
    """``entity, term, disclosure`` of the pairs that disclose at least ``generalise``."""
    n_docs = found.count()
    pairs = _pairs(texts).groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    with_term = found.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("of_term"))
    rows = pairs.join(known, "entity").join(with_term, "term")
    pmi = F.log(F.lit(float(n_docs)) * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    content = F.log(F.lit(float(n_docs)) / F.col("of_entity"))
    return rows.select("entity", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= generalise)


#: SQL: where the terms of ``told`` stand in ``masked``
_HITS = f"""aggregate(
      filter(zip_with(split(masked, {_quoted(TERM)}, -1), regexp_extract_all(masked, {_quoted(TERM)}, 0), (a, b) -> named_struct('a', length(a), 'v', b, 'term', lower(b))), z -> z.v is not null),
      named_struct('pos', 0, 'out', {_EMPTY}),
      (acc, z) -> named_struct('pos', acc.pos + z.a + length(z.v), 'out', if(array_contains(told.term, z.term),
        concat(acc.out, array(named_struct('s', acc.pos + z.a, 'e', acc.pos + z.a + length(z.v), 'v', z.v))), acc.out)),
      acc -> acc.out)"""


def detect(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, support: int = 2) -> DataFrame:
    """Per row ``doc_id, h1, h2``, the base kinds and ``terms`` (start, end, term, removed), settled."""
    found = find(docs)
    known, texts = holders(found, support)
    pairs = disclosures(found, known, texts, generalise, support)
    told = (_pairs(texts).join(pairs, ["entity", "term"]).groupBy("h1", "h2", "term").agg((F.max("disclosure") >= remove).alias("removed"))
            .groupBy("h1", "h2").agg(F.collect_list(F.struct("term", "removed")).alias("told")))
    base = ["doc_id", "h1", "h2", *KINDS]
    rows = found.where(F.size("entities") > 0).join(told, ["h1", "h2"], "left").select(*base, "told", F.when(F.col("told").isNotNull(), F.expr(_HITS)).alias("hits"))
    # a short word without a digit needs a capital somewhere in the document
    apt = rf"filter(hits, x -> x.e - x.s >= {LETTERS} or x.v rlike r'\p{{N}}' or exists(hits, y -> lower(y.v) = lower(x.v) and y.v <> lower(y.v)))"
    named = f"transform({apt}, x -> named_struct('s', x.s, 'e', x.e, 'term', lower(x.v), 'removed', told.removed[int(array_position(told.term, lower(x.v))) - 1]))"
    empty = F.expr("cast(array() as array<struct<s:int,e:int,term:string,removed:boolean>>)")
    rows = rows.select(*base, F.coalesce(F.expr(named), empty).alias("terms"))
    return rows.unionByName(found.where(F.size("entities") == 0).select(*base, empty.alias("terms")))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts, the hash of the base spans and all spans as text."""
    def named(kind):
        return lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))

    def joined(kinds):
        return F.array_join(F.concat(*[F.transform(c, named(k)) for k, c in kinds]), ",")

    base = [(k, F.col(k)) for k in KINDS]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined([*base, ("term", F.col("terms"))]).alias("spans"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with entities replaced by their kind and disclosing terms by ``[TERM]`` or nothing."""
    found = detect(docs, **thresholds)

    def replaced(kind):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("by"))

    every = F.concat(*[F.transform(k, replaced(k)) for k in KINDS],
                     F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["removed"], "").otherwise("[TERM]").alias("by"))))
    spans = (found.select("doc_id", "h1", "h2", F.sort_array(every).alias("spans")).where(F.size("spans") > 0)
             .select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__h1", "__h2"]))
    rows = docs.withColumns({"__a": F.xxhash64(F.coalesce("text", F.lit(""))), "__b": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2")), "left")
    # spans in order; one that starts inside another is cut to what is behind it
    built = F.expr("""aggregate(__spans, named_struct('pos', 0, 'out', ''),
      (acc, x) -> named_struct('pos', greatest(acc.pos, x.e), 'out', if(x.s >= acc.pos, concat(acc.out, substring(text, acc.pos + 1, x.s - acc.pos), x.by), acc.out)),
      acc -> concat(acc.out, substring(text, acc.pos + 1)))""")
    return rows.select(*[F.when(F.col("__spans").isNotNull(), built).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
