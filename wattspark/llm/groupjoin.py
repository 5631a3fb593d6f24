"""N-gram Jaccard join (operator 7): grouped prefix join, and the classes of linked documents.

A document's set are its distinct 5-word shingles. Two sets with a Jaccard similarity of at least
0.8 share one of their first ``n - ceil(0.8 n) + 1`` elements under any common order. The order puts
shingles that are frequent in the corpus last: a bounded counter array over all shingles gives each a
level, so prefixes hold rare shingles and common passages stay out of them. The order only moves
work; every order gives the same links.

1. Per document: set hash (copies of a set are one member), size, prefix, group = (prefix, size).
2. Groups: members with identical prefix and size. Only prefix elements that a bounded bitmap knows to be
   met twice are shuffled (collisions add rows, never lose one). Pairs of groups that share one
   are filtered by size and by the positions of the shared element.
3. Pairs are also dropped when their prefixes share too little for the rest to make up for it.
   Stars: in each element's bucket, and in each group, the most typical group (most frequent shingles) is the
   hub; its pairs with the others are expanded to members and verified on whole sets. That joins
   near copies of one text without all pairs.
4. The rest: members of one bucket that are not yet in one component; all those pairs that pass the filters
   are verified, so no link between different components is lost.
5. Components by alternating large and small stars, checkpointed in shared scratch.

Defined results: null and empty texts have no shingles and form their own class; fewer than five
words are one shingle; a class is named by its smallest ``doc_id`` (null ids count only if all are null); equal rows
give equal rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattspark.llm.bitmaps import bit, filter_of, levels, place, twice
from wattspark.llm.common import U64, Words, as_bytes, mix, pieces, release, settle, shingles, with_columns

SIZE = 5
#: size of the counter array that orders shingles, and of the bitmap of shared prefix elements
ORDER_BITS, SHARED_BITS = 23, 27


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    at, h = shingles(words, SIZE)
    edge = np.searchsorted(words.doc[at], np.arange(len(texts) + 1)).tolist()
    out = []
    n_words = np.diff(words.first).tolist()
    for i, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if 0 < n_words[i] < SIZE:
            x = words.hash[words.first[i]:words.first[i] + 1]
            for k in range(1, n_words[i]):
                x = x * U64(0xD6E8FEB86659FD93) + words.hash[words.first[i] + k]
            out.append(mix(x + U64(n_words[i])))
        elif hi - lo > 1:
            s = np.sort(h[lo:hi])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(h[lo:hi])
    return out


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1  # ceil(0.8 n) in whole numbers


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def documents_sets(docs: DataFrame) -> DataFrame:
    """Settled: ``doc_id, th`` (text hash), ``sid`` (set hash), ``n, g, p`` (group), ``score, prefix``."""
    src = with_columns(docs, doc_id=F.col("doc_id"), th=F.xxhash64("text"), text=F.col("text"))

    def all_shingles(b):
        found = [place(np.concatenate(s), ORDER_BITS) for part in pieces([b], 2 << 20) if (s := sets_of(as_bytes(part.column("text"))))]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    order = docs.sparkSession.sparkContext.broadcast(levels(src.select("text"), all_shingles, ORDER_BITS))

    def described(batches):
        for b in pieces(batches, 2 << 20):
            sid, size, group, check, score, prefix = [], [], [], [], [], []
            for s in sets_of(as_bytes(b.column("text"))):
                n = len(s)
                level = order.value[place(s, ORDER_BITS)]
                k = prefix_size(n) if n else 0
                # by level, then by value: s is sorted, so a stable sort of the levels will do
                first = s[np.argsort(level, kind="stable")[:k]]
                g = np.frombuffer(hashlib.blake2b(first.astype("<u8").tobytes() + n.to_bytes(8, "little"), digest_size=16).digest(), "<i8")
                sid.append(_name(s))
                size.append(n)
                group.append(int(g[0]))
                check.append(int(g[1]))
                score.append(int(1000 * level.astype(np.float64).mean()) if n else 0)
                prefix.append(first.view(np.int64))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            offsets = np.append(0, np.cumsum([len(x) for x in prefix])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(sid, pa.binary()), pa.array(size, pa.int32()), pa.array(group, pa.int64()), pa.array(check, pa.int64()), pa.array(score, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "th", "sid", "n", "g", "p", "score", "prefix"])

    kind = src.schema["doc_id"].dataType.simpleString()
    out = settle(src.mapInArrow(described, f"doc_id {kind}, th long, sid binary, n int, g long, p long, score int, prefix array<long>"), "sets")
    release(docs.sparkSession, order)
    return out


def groups_of(sets: DataFrame) -> DataFrame:
    """Settled: groups ``g, n, score, multi`` (several members) with their shared prefix elements ``tokens, at``."""
    def places(flat):  # two hashes, each with half of the bitmap
        return place(flat, SHARED_BITS), place(flat, SHARED_BITS, 1) + (1 << SHARED_BITS)

    tokens = lambda b: np.concatenate(places(_flat_list(b.column("prefix"))))
    shared = sets.sparkSession.sparkContext.broadcast(twice(sets.where("n > 0").select("prefix"), tokens, SHARED_BITS + 1))

    def kept(batches):
        for b in batches:
            if b.num_rows:
                lists = b.column("prefix")
                flat, n = _flat_list(lists), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                one, two = places(flat)
                keep = bit(shared.value, one) & bit(shared.value, two)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                offsets = pa.array(np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(n))].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in ("g", "p", "n", "sid", "score")], pa.ListArray.from_arrays(offsets, pa.array(flat[keep])), pa.ListArray.from_arrays(offsets, pa.array(pos[keep].astype(np.int32)))],
                    names=["g", "p", "n", "sid", "score", "tokens", "at"])

    rows = sets.where("n > 0").select("g", "p", "n", "sid", "score", "prefix").mapInArrow(kept, "g long, p long, n int, sid binary, score int, tokens array<long>, at array<int>")
    groups = rows.where(F.size("tokens") > 0).groupBy("g", "p", "n").agg(
        F.max("score").alias("score"), (F.min("sid") != F.max("sid")).alias("multi"), F.first("tokens").alias("tokens"), F.first("at").alias("at"))
    out = settle(groups.drop("p"), "groups")
    release(sets.sparkSession, shared)
    return out


def _enough_shared(pairs: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Those of the distinct group pairs whose prefixes share enough: whatever is shared and not in both
    prefixes lies behind the one that ends first, so at most max(n - prefix) more can be."""
    side = lambda g, x: groups.select(F.col("g").alias(g), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    rows = pairs.join(side(a, "1"), a).join(side(b, "2"), b)
    behind = lambda n: F.ceil(4 * n / 5) - 1
    most = F.size(F.array_intersect("t_1", "t_2")) + F.greatest(behind(F.col("n_1")), behind(F.col("n_2")))
    return rows.where(most >= F.ceil(4 * (F.col("n_1") + F.col("n_2")) / 9)).select(a, b).distinct()


def _flat_list(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _may_link(n1, p1, n2, p2):
    """Size filter, and the overlap that is possible behind the first shared element."""
    need = F.ceil(4 * (n1 + n2) / 9)
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def fetch(docs: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """Settled ``sid, items``: the whole sets of ``ids``, made again from the texts that have them."""
    wanted = settle(members.select("sid", "th").join(ids.select("sid").distinct(), "sid"), "wanted")
    bitmap, bits = filter_of(wanted, "th", wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def chosen(batches):
        for b in batches:
            if b.num_rows:
                b = b.filter(pa.array(bit(shared.value, place(b.column("th").to_numpy(zero_copy_only=False), bits))))
                for part in pieces([b], 2 << 20):
                    found = [s for s in sets_of(as_bytes(part.column("text"))) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["sid", "items"])

    rows = docs.select(F.xxhash64("text").alias("th"), F.col("text").alias("text")).mapInArrow(chosen, "sid binary, items binary")
    out = settle(rows.groupBy("sid").agg(F.first("items").alias("items")).join(wanted.select("sid"), "sid", "left_semi"), "items")
    release(docs.sparkSession, shared)
    return out


def verify(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sets have 100 * intersection >= 80 * union; settled."""
    rows = (pairs.join(store.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a")
            .join(store.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y"))

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                s = np.sort(np.concatenate((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))))
                both = int((s[1:] == s[:-1]).sum())
                keep.append(100 * both >= 80 * (len(s) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = settle(rows.mapInArrow(exact, "a binary, b binary"), "links")
    release(pairs.sparkSession)
    return out


def components(links: DataFrame) -> DataFrame:
    """Settled ``sid, comp`` for every end of a link: the smallest id reachable, by alternating stars."""
    edges = settle(links.select("a", "b").where("a < b").distinct(), "edges")
    before = None
    while True:
        # large star: each node's larger neighbours go to its smallest one
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # small star: each node and its smaller neighbours go to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x < y")
        edges = settle(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return settle(edges.select(F.col("b").alias("sid"), F.col("a").alias("comp")).union(edges.select("a", "a").distinct()), "components")


def links_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``a, b`` set ids) that connect all linked sets."""
    members = settle(sets.where("n > 0").groupBy("sid").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("g").alias("g")), "members")
    groups = groups_of(sets)
    tokens = groups.select("g", "n", "score", "multi", F.explode(F.arrays_zip("tokens", "at")).alias("x")).select(F.col("x.tokens").alias("token"), "g", "n", F.col("x.at").alias("pos"), "score", "multi")
    typical = F.col("score").cast("long") * (1 << 40) + F.pmod("g", F.lit(1 << 40))
    hubs = tokens.groupBy("token").agg(F.count("*").alias("c"), F.max("multi").alias("any"), *[F.max_by(c, typical).alias(f"hub_{c}") for c in ("g", "n", "pos")]).where("c > 1 OR any").drop("c", "any")
    rows = settle(tokens.drop("score").join(hubs, "token"), "buckets")
    release(docs.sparkSession)
    # stars between groups, then from a group's first member to all members of the other, and in the group itself
    stars = rows.where((F.col("g") != F.col("hub_g")) & _may_link(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"))).select("g", F.col("hub_g").alias("to")).distinct()
    stars = _enough_shared(stars, groups, "g", "to")
    several = rows.where("multi").select("g", F.col("g").alias("to")).distinct()
    first = members.groupBy(F.col("g").alias("to")).agg(F.min("sid").alias("hub"))
    tried = settle(_pairs(stars.union(several).join(first, "to").join(members.select("g", "sid"), "g"), "hub", "sid"), "pairs")
    store = fetch(docs, members, tried.select(F.col("a").alias("sid")).union(tried.select("b")))
    links = verify(tried, store)
    # the rest: members of one bucket in different components
    comp = components(links)
    named = members.select("g", "sid").join(comp, "sid", "left").select("g", "sid", F.coalesce("comp", "sid").alias("comp"))
    spread = settle(rows.select("token", "g", "n", "pos").join(named, "g"), "spread")
    per = spread.groupBy("token", "comp").agg(F.count("*").alias("c"))
    apart = per.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("most")).where("comps > 1").select("token", F.col("most.comp").alias("most"))
    left = spread.join(apart, "token")
    x = left.where("comp != most").select("token", F.col("g").alias("g1"), F.col("sid").alias("sid1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("comp").alias("c1"))
    y = left.select("token", F.col("g").alias("g2"), F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("comp").alias("c2"))
    rest = x.join(y, "token").where((F.col("c1") != F.col("c2")) & _may_link(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2")))
    rest = settle(rest.select("g1", "g2", "sid1", "sid2").distinct(), "near")
    release(docs.sparkSession)
    rest = rest.where("g1 = g2").unionByName(rest.join(_enough_shared(rest.where("g1 != g2").select("g1", "g2").distinct(), groups, "g1", "g2"), ["g1", "g2"]))
    rest = settle(_pairs(rest, "sid1", "sid2").join(tried, ["a", "b"], "left_anti"), "rest")
    store = fetch(docs, members, rest.select(F.col("a").alias("sid")).union(rest.select("b")))
    return links.union(verify(rest, store))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    sets = documents_sets(docs)
    comp = components(links_of(docs, sets))
    rows = sets.select("doc_id", "n", "sid").join(comp, "sid", "left").select("doc_id", "n", F.coalesce("comp", "sid").alias("comp"))
    names = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(names, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns: that with the smallest id, then text hash. Rows without
    shingles are linked with nothing and stay."""
    sets = documents_sets(docs)
    comp = components(links_of(docs, sets))
    named = sets.where("n > 0").join(comp, "sid", "left").groupBy(F.coalesce("comp", "sid").alias("comp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one"))
    firsts = settle(named.select(F.col("one.doc_id").alias("__first_id"), F.col("one.th").alias("__first_th")), "firsts")
    rows = docs.withColumn("__th", F.xxhash64("text"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = rows.where(~blank).join(firsts, F.col("doc_id").eqNullSafe(F.col("__first_id")) & (F.col("__th") == F.col("__first_th")), "left_semi").dropDuplicates(["doc_id", "__th"])
    return kept.union(rows.where(blank)).select(*docs.columns)
