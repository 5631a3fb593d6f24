"""Merkle dataset manifest (operator 13): hash trees over the rows of a table, with proofs.

Leaves are the hashes of rows. The leaves of one group, in order, form a tree: every ``FANOUT`` consecutive
nodes (the last run may be shorter, even one) become the hash of their concatenated digests, level by
level, until one is left, the group's subroot; the subroots, in the order of their groups, form the top tree.

Each level is a slot pivot: conditional aggregates spread the children of a parent over ``FANOUT`` columns
``c0, c1, ..``; the columns concatenated give the parent's hash, the columns without a node's own give its
siblings to the left and to the right. Proofs go down the same pivots: a parent hands its own path to its
children, so that only the last step has a row per leaf. The path, a list of (left, right) digests, folds
over a leaf to the root.

A node's place in its tree comes without a window over a group, which might hold all rows: rows are range-partitioned and
sorted by (group, order), numbered in each partition and written to shared scratch; rows per (partition, group)
are summed up, one record for each partition and each group, and give the offset of each partition's rows. The join
that adds them has the same keys, so that a hot group still spreads over its partitions. Each
level has an eighth of the rows of the one below; their number is the driver's only collected value.

Defined results: groups and ids may be null and come first; rows of the same id follow each other by leaf; equal rows
are separate leaves; a null field is ``-``; an empty table has no rows and no root; only the fields named are hashed, extra columns don't
matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattspark.llm.common import settle

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"c{k}" for k in range(FANOUT)]
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(fields: dict[str, Column]) -> Column:
    """Hash of the fields in order, each its byte length and value."""
    text = [c.cast("string") for c in fields.values()]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree`` (the number of the row's group in ascending order), ``idx`` (its own in the group) and
    ``size`` (the group's rows)."""
    # equal rows may go to different partitions: the tie-breaker comes last
    keys = [group, *order, "tie"]
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(ordered.drop("tie").withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright(F.col("at"), 33)  # the partition of a generated number
    chunks = settle(placed.groupBy(part.alias("part"), F.col(group).alias("g")).agg(F.min("at").alias("low"), F.count("*").alias("n")), "chunks")
    groups = chunks.groupBy("g").agg(F.min("low").alias("first"), F.sum("n").alias("size")).withColumn("begins", F.shiftright("first", 33))
    # ``first`` ascends with the group: its number is that of the groups which begin in partitions before, and before it in its own
    begun = groups.groupBy("begins").agg(F.count("*").alias("new"))
    begun = begun.select("begins", (F.sum("new").over(Window.orderBy("begins")) - F.col("new")).alias("before"))  # a row per partition
    tree = F.col("before") + F.row_number().over(Window.partitionBy("begins").orderBy("first")) - 1
    trees = groups.join(begun, "begins").select(F.col("g").alias("g2"), tree.alias("tree"), "size")
    done = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    starts = chunks.select("part", "g", "low", done.alias("done")).join(trees, F.col("g").eqNullSafe(F.col("g2"))).drop("g2")
    starts = settle(starts, "starts")
    rows = placed.withColumn("of", part).join(starts, (F.col("of") == F.col("part")) & F.col(group).eqNullSafe(F.col("g")))
    return rows.select("tree", (F.col("done") + F.col("at") - F.col("low")).alias("idx"), "size", *rows_of(placed, "at"))


def rows_of(df: DataFrame, *without: str) -> list[str]:
    return [c for c in df.columns if c not in without]


def grow(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """(pivots from the lowest level up, ``tree, subroot``) of ``leaves`` (``tree, idx, size, hash``), of whose trees none
    has over ``most``. ``size`` is the number of the tree's nodes on the present level."""
    levels, roots, nodes = [], None, leaves
    while True:
        done = nodes.where("size = 1").select("tree", F.col("hash").alias("subroot"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            return levels, roots
        slot = F.col("idx") % FANOUT
        spread = nodes.where("size > 1").groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(
            F.max("size").alias("size"), *[F.max(F.when(slot == k, F.col("hash"))).alias(c) for k, c in enumerate(SLOTS)])
        up = F.ceil(F.col("size") / FANOUT).cast("long")
        levels.append(settle(spread.select("tree", "idx", up.alias("size"), *SLOTS, sha(F.concat_ws("", *SLOTS)).alias("hash")), "level"))
        nodes, most = levels[-1].select("tree", "idx", "size", "hash"), -(-most // FANOUT)


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tree, idx, path`` and the other columns of ``tops`` (``tree, path, ..``) for every leaf. A path has a leaf's siblings
    on each level, then the path of its tree."""
    nodes, kept = tops.withColumn("idx", F.lit(0).cast("long")), rows_of(tops, "path")
    for i, level in enumerate(reversed(levels)):
        children = [F.when(F.col(own).isNotNull(), F.struct((F.col("idx") * FANOUT + k).alias("idx"), F.concat(F.array(F.struct(
            F.concat_ws("", *SLOTS[:k]).alias("left"), F.concat_ws("", *SLOTS[k + 1:]).alias("right"))), F.col("path")).alias("path"))) for k, own in enumerate(SLOTS)]
        # a tree that is lower than this level has no parents here: it waits as it is
        below = F.when(F.col(SLOTS[0]).isNull(), F.array(F.struct("idx", "path"))).otherwise(F.array_compact(F.array(*children)))
        nodes = nodes.join(level.select("tree", "idx", *SLOTS), ["tree", "idx"], "left").select(*kept, F.explode(below).alias("c")).select(*kept, "c.idx", "c.path")
        if i + 1 < len(levels):
            nodes = settle(nodes, "paths")
    return nodes


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda h, s: sha(F.concat(s["left"], h, s["right"])))


def siblings(path: Column) -> Column:
    """All digests of a path, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (which have ``leaf``; none of the names added here) with ``subroot``, ``root`` and ``path`` (siblings up to the root)."""
    placed = settle(numbered(settle(rows, "leaves"), group, [*order, "leaf"]), "numbered")
    most, trees = placed.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    levels, roots = grow(placed.select("tree", "idx", "size", F.col("leaf").alias("hash")), most)
    roots = settle(roots, "subroots")
    # the top tree: its leaves are the subroots, which have their numbers
    upper, root = grow(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), F.col("subroot").alias("hash")), trees)
    root = root.select("tree", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(upper, root).select(F.col("idx").alias("tree"), "root", "path").join(roots, "tree")
    return placed.join(descend(levels, settle(tops, "tops")), ["tree", "idx"]).drop("tree", "idx", "size")


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Manifest of ``docs`` and check of each row against it: ``doc_id, leaf, subroot, root, path``, ``folded_root``, the root that
    the row gives with its path, and ``verified``. Where ``tampered`` holds, the row checked has its text's A-Z in lower case."""
    fields = {c: docs[c] for c in FIELDS}
    changed = fields | {"text": F.translate(docs["text"], UPPER, LOWER)}
    slim = docs.select(docs["doc_id"], docs["lang"], leaf(fields).alias("leaf"), F.when(F.lit(False) if tampered is None else tampered, leaf(changed)).alias("changed"))
    out = manifest(slim, "lang", ["doc_id"]).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def third(doc_id: Column) -> Column:
    """Whether 3 divides the unsigned crc32 of the decimal id; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def digest(checked: DataFrame) -> DataFrame:
    """``verify``'s rows with the path as ``proof_sha256``."""
    return checked.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for ``digest(verify(documents, third(doc_id)))``: recursion up the trees, then along each row's path."""
    def digest_of(text: str) -> str:
        field = "coalesce(strlen({0}) || ':' || {0}, '-')"
        return "sha256(" + " || ".join(field.format(text if c == "text" else f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"

    step = "lambda y, z: xor(y >> 1, (y & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})), 4294967295)"

    def tree(name: str, base: str) -> str:
        return f"""{name}(lvl, tree, idx, hash, size) AS (SELECT 0, tree, idx, hash, count(*) OVER (PARTITION BY tree) FROM {base}
  UNION ALL SELECT lvl + 1, tree, idx, hash, count(*) OVER (PARTITION BY tree) FROM (
   SELECT lvl, tree, idx // {FANOUT} AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM {name} WHERE size > 1 GROUP BY lvl, tree, idx // {FANOUT}))"""

    sides = ", ".join(f"coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (WHERE s.idx {c} n.idx), '') AS {a}" for c, a in (("<", "l"), (">", "r")))

    def beside(name: str, nodes: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT n.lvl, n.tree, n.idx, {sides} FROM {nodes} n JOIN {nodes} s ON s.lvl = n.lvl AND s.tree = n.tree AND s.idx // {FANOUT} = n.idx // {FANOUT} WHERE n.size > 1 GROUP BY n.lvl, n.tree, n.idx)"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, {digest_of('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest_of(lower)} ELSE {digest_of('text')} END AS other FROM {documents}),
 placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
 base AS (SELECT tree, idx, leaf AS hash FROM placed),
 {tree('low', 'base')},
 subroots AS MATERIALIZED (SELECT tree, hash AS subroot FROM low WHERE size = 1),
 tops AS (SELECT 0 AS tree, tree AS idx, subroot AS hash FROM subroots),
 {tree('high', 'tops')},
 {beside('low_sides', 'low')},
 {beside('high_sides', 'high')},
 path AS MATERIALIZED (SELECT p.tree, p.idx, 0 AS part, s.lvl, s.l, s.r FROM placed p JOIN low_sides s ON s.tree = p.tree AND s.idx = p.idx // CAST(pow({FANOUT}, s.lvl) AS BIGINT)
  UNION ALL SELECT p.tree, p.idx, 1, s.lvl, s.l, s.r FROM placed p JOIN high_sides s ON s.idx = p.tree // CAST(pow({FANOUT}, s.lvl) AS BIGINT)),
 steps AS MATERIALIZED (SELECT tree, idx, list(struct_pack(l := l, r := r) ORDER BY part, lvl) AS p, string_agg(l || r, '' ORDER BY part, lvl) AS proof FROM path GROUP BY tree, idx),
 folds(tree, idx, k, h, p) AS (SELECT p.tree, p.idx, 1, p.other, coalesce(s.p, []) FROM placed p LEFT JOIN steps s USING (tree, idx)
  UNION ALL SELECT tree, idx, k + 1, sha256(p[k].l || h || p[k].r), p FROM folds WHERE k <= len(p))
SELECT p.doc_id, p.leaf, subroots.subroot, root.hash AS root, sha256(coalesce(steps.proof, '')) AS proof_sha256, folds.h AS folded_root, folds.h = root.hash AS verified
FROM placed p JOIN subroots USING (tree) JOIN folds ON folds.tree = p.tree AND folds.idx = p.idx AND folds.k = len(folds.p) + 1
 LEFT JOIN steps ON steps.tree = p.tree AND steps.idx = p.idx CROSS JOIN (SELECT hash FROM high WHERE size = 1) AS root"""
