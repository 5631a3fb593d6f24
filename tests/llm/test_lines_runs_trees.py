"""Line dedup, periodic runs and the Merkle manifest against plain versions and on awkward rows; hashes and hot keys."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from wattspark.llm import common as C, crf, decontaminate, groupjoin, line_dedup as L, merkle as M, mixing, periodic as P, queries as Q, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
#: names that the operators use inside
EXTRA = ["h", "r", "row", "pos", "hs", "doc", "gone", "all", "n", "tree", "idx", "size", "hash", "path", "leaf", "root", "changed", "runs", "collapsed", "n_words", "c0", "part", "low", "g", "w", "tie"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def odd(spark):
    same = " Shared LINE \t\nown %d\n\nshared line"
    rows = [(i, f"s{i % 3}", ["de", "en", None][i % 3], 5, same % i) for i in range(12)]
    rows += [(3, "s0", "en", 5, same % 3), (3, "s0", "en", 5, same % 3), (None, None, None, None, None), (None, None, None, None, "shared line\nrest"), (20, "s", "é", 0, ""),
             (21, "s", "é", 1, "\n"), (22, "s", "z", 1, "ÀÉ É\nàé é"), (23, "s", "en", 9, "w%d " * 30000 % tuple(range(30000))), (24, "s", "en", 9, "a " * 60000), (25, "s", "en", 9, "x" * 300000),
             (26, "", "", 1, " \t \n"), (27, "s", "en", 1, "a b c\r\nd" * 40), (28, "s", "en", 1, ("one long line " * 2000 + "\n") * 10)]
    return frame(spark, rows)


# ------------------------------------------------------------------ 11: line dedup
def line_rows(rows, min_docs, min_chars=1):
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[lower(x.strip(BLANK))].add(i)
    many = {k for k, v in docs.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if lower(x.strip(BLANK)) not in many]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("min_docs", [2, 5, 10, 14])
def test_lines_of_many_documents_go(odd, min_docs):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in L.dedup(odd, min_docs).collect()]
    assert sorted(got, key=repr) == sorted(line_rows(rows, min_docs), key=repr)


def test_line_dedup_passes_columns_and_null_texts(odd):
    out = L.dedup(odd, 10)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    r = out.where("doc_id IS NULL AND text IS NULL").collect()
    assert len(r) == 1 and (r[0].n_lines, r[0].n_dropped, r[0].hs) == (1, 0, "extra hs")


def test_short_keys_stay(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in L.dedup(odd, 2, min_chars=12).collect()]
    assert sorted(got, key=repr) == sorted(line_rows(rows, 2, 12), key=repr)


def test_line_dedup_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in Q.documents(spark, SF0001).select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in Q.QUERIES["op11_line_dedup"](spark, SF0001).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == {i: (i, n, d, sha(t)) for i, n, d, t in line_rows(rows, 10)}


def test_hot_and_cold_hashes_agree(odd, monkeypatch):
    want = sorted(map(repr, L.digest(L.dedup(odd, 2)).collect()))
    for hot in (1, 3):  # all but the most frequent keys go by the shuffled join
        monkeypatch.setattr(L, "HOT", hot)
        assert sorted(map(repr, L.digest(L.dedup(odd, 2)).collect())) == want


def test_line_dedup_without_python(odd):
    plan = L.digest(L.dedup(odd, 10))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(odd):
    none = odd.where("false")
    assert L.digest(L.dedup(none)).count() == 0
    assert P.digest(P.collapse(none)).count() == 0
    assert M.digest(M.verify(none, M.third(none["doc_id"]))).count() == 0


# ------------------------------------------------------------------ 12: periodic runs
def plain_runs(w, least=12):
    out = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(i, w):
    runs = plain_runs(w)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_are_all_maximal_repetitions():
    rnd = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, v = rnd.choice([0, 1, 5, 12, 13, 40, 150]), rnd.choice([1, 2, 3, 5, 50])
            w = fibonacci(n) if n and rnd.random() < 0.2 else [rnd.randrange(v) for _ in range(n)]
            for _ in range(rnd.choice([0, 1, 3]) if n > 4 else 0):  # planted periods, also over each other
                a = rnd.randrange(n)
                p, b = rnd.randint(1, max(1, (n - a) // 2)), rnd.randint(a, n)
                for i in range(a, b):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        first = np.cumsum([0, *map(len, texts)])
        least = rnd.choice([12, 12, 4, 7, 2])
        found = P.find_runs(np.array([x for t in texts for x in t], dtype=np.int64), first, least)
        for k, w in enumerate(texts):
            assert sorted(tuple(r[1:]) for r in found if r[0] == k) == plain_runs(w, least), w


def test_long_texts_of_one_period_take_few_seeds(monkeypatch):
    seeds = []
    plain = P._seeds
    monkeypatch.setattr(P, "_seeds", lambda *a: (seeds.append(len(i)) or (i, j) for i, j in plain(*a)))
    for n in (20_000, 40_000):
        seeds.append(-1)
        assert P.find_runs(np.zeros(n, dtype=np.int64), np.array([0, n])) == [(0, 0, n, 1)]
    cut = seeds.index(-1, 1)
    assert sum(seeds[cut + 1:]) < 2.3 * sum(seeds[1:cut]) and sum(seeds[1:cut]) < 3 * 20_000 * 12


def test_periodic_query_against_plain_rows(spark):
    want = []
    for i, t in Q.documents(spark, SF0001).select("doc_id", "text").collect():
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        if len(w) <= 1500:  # the plain version takes time by the square
            want.append(plain_row(i, w))
    got = {r[0]: tuple(r) for r in Q.QUERIES["op12_periodic_runs"](spark, SF0001).collect()}
    assert len(want) > 150 and [got[x[0]] for x in want] == want


def test_collapse_on_awkward_rows(odd):
    out = {(r.row.doc_id, r.row.text): r for r in P.collapse(odd).collect()}
    assert out[(24, "a " * 60000)].runs == [(0, 60000, 1)] and out[(24, "a " * 60000)].collapsed == "a"
    assert out[(None, None)].n_words == 0 and out[(None, None)].runs == [] and out[(None, None)].collapsed == ""
    assert out[(26, " \t \n")].n_words == 0
    assert out[(23, "w%d " * 30000 % tuple(range(30000)))].runs == []
    r = out[(27, "a b c\r\nd" * 40)]
    assert [tuple(x) for x in r.runs] == plain_runs(WORD.findall(r.row.text)) and r.row.runs == "extra runs"
    assert P.collapse(odd).count() == odd.count()


# ------------------------------------------------------------------ 13: Merkle manifest
def h(values):
    return sha("".join(values))


def leaf(r, text):
    v = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[g] = levels([leaf(r, r.text) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            f, proof = leaf(r, lower(r.text) if bad and r.text is not None else r.text), ""
            for tree, at in ((trees[g], k), (top, t)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8:at // 8 * 8 + 8]
                    proof += "".join(run[:at % 8] + run[at % 8 + 1:])
                    f = h([*run[:at % 8], f, *run[at % 8 + 1:]])
                    at //= 8
            out.append((r.doc_id, trees[g][0][k], trees[g][-1][0], top[-1][0], sha(proof), f, f == top[-1][0]))
    return out


def check_manifest(df):
    got = M.digest(M.verify(df, M.third(df["doc_id"]))).collect()
    want = plain_manifest(df.select(*M.FIELDS).collect())
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


def test_manifest_on_awkward_rows(odd):
    got = check_manifest(odd)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64], [65, 1, 8], [1] * 11, [513, 1, 70]])
def test_manifest_of_every_shape(spark, sizes):
    rows = [(i * 7 % 1000, "s", f"l{t}", i, f"Text {t} {i}") for t, n in enumerate(sizes) for i in range(n)]
    check_manifest(frame(spark, rows))


def test_manifest_of_documents(spark):
    df = Q.documents(spark, SF0001)
    got = Q.QUERIES["op13_merkle_manifest"](spark, SF0001).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(df.select(*M.FIELDS).collect())))


def test_a_changed_row_breaks_its_proof_only(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(100)]
    df = frame(spark, rows)
    changed = M.verify(df.withColumn("text", F.when(F.col("doc_id") == 5, "Text 5").otherwise(F.col("text"))), F.col("doc_id") == 5)
    assert {r.doc_id for r in changed.where("NOT verified").collect()} == {5}
    whole = M.verify(df)
    assert whole.where("NOT verified").count() == 0 and len({r.root for r in whole.collect()}) == 1


def test_oracles_run_on_awkward_rows(odd):
    import duckdb
    pdf = odd.select(*M.FIELDS).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", pdf)
    plain = odd.select(*M.FIELDS)
    for df, sql in ((L.digest(L.dedup(plain)), L.oracle()), (M.digest(M.verify(plain, M.third(plain["doc_id"]))), M.oracle())):
        want = con.execute(sql).fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


# ------------------------------------------------------------------ shared: hashes of words and contexts, hot keys
def alternating(order, a="a", b="b"):
    """Two words of 2 ** order letters that every polynomial modulo 2 ** 64 takes for the same."""
    one, two = a, b
    for _ in range(order):
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("order", [9, 10, 11, 12])
def test_constructed_words_have_different_hashes(order):
    one, two = alternating(order)
    w = C.Words([f"{one} {two} {one}".encode(), two.encode()], lower=True)
    assert w.hash[0] == w.hash[2] != w.hash[1] == w.hash[3]


def test_word_hashes_depend_on_the_word_only():
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 100, n))) for n in [*rng.integers(1, 40, 3000), 4096, 4097, 300_000, 4095]]
    hashes = {}
    for k in (1, 7, len(words)):  # texts of k words each, and so different blocks
        texts = [" ".join(words[i:i + k]).encode() for i in range(0, len(words), k)]
        for w, x in zip(words, C.Words(texts, lower=True).hash.tolist()):
            assert hashes.setdefault(w, x) == x
    assert len(set(hashes.values())) == len(hashes)


def test_constructed_words_do_not_link_or_repeat(spark):
    one, two = alternating(10)
    rows = [(1, " ".join([one] * 6)), (2, " ".join([two] * 6)), (3, f"{one} x1 x2 x3 x4 {two} x1 x2 x3 x4 y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    C.ship(spark)
    assert {r.doc_id: r.component_id for r in groupjoin.classes(df).collect()} == {1: 1, 2: 2, 3: 3}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_repeat_words for r in crf.judge(df, crf.fit(df, labels)).collect()}[3] == 0


def test_join_counted_takes_every_row_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k long, v long")
    counted = rows.groupBy("k").agg(F.count("*").alias("n")).where("k != 5")
    want = sorted((r.k, r.v) for r in rows.where("k != 5").collect())
    for hot in (0, 3, 20_000):
        monkeypatch.setattr(C, "HOT", hot)
        out = C.join_counted(rows, counted, ["k"], "n")
        assert sorted((r.k, r.v) for r in out.collect()) == want and set(out.columns) == {"k", "v", "n"}


def test_every_planted_passage_is_touched(spark):
    rnd = random.Random(9)
    passages = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(n)) for n in (50, 55, 60, 80, 200)]  # 399 bytes and more
    rows = []
    for i in range(60):
        own = [" ".join("".join(rnd.choice("ijklmnop") for _ in range(6)) for _ in range(rnd.randrange(1, 90))) for _ in range(2)]
        rows.append((i, f"{own[0]} {passages[i % 5]} {own[1]}" if i < 40 else own[0] * 3 if i % 2 else own[0]))
    C.ship(spark)
    got = {r.doc_id: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    data = [t.encode() for _, t in rows]
    count = Counter(t[i:i + 400] for t in data for i in range(len(t) - 399))
    for (i, _), t in zip(rows, data):
        gone = set()
        for k in range(len(t) - 399):
            if count[t[k:k + 400]] > 1:
                gone.update(range(k, k + 400))
        assert got[i].n_removed == len(gone) and got[i].n_spans == (len(gone) > 0)
        assert not (i < 40 and len(passages[i % 5]) >= 400) or gone


def test_copies_are_not_capped(spark):
    text = "word " * 50
    rows = [(i, "big" if i else "rare", "en", text) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    out = mixing.calibrate(df)
    r = out.where("source = 'rare'").collect()[0]
    assert r.weight > 20 and r.copies >= int(r.weight)  # half of the square-root shares: far above 4
    slim, weights = mixing.weigh(df)
    cells = slim.groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    assert max(x.error for x in mixing.margin_error(weights, cells, mixing.targets_of(cells, 0.5)).collect()) < 1e-9


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(10,0)", "string"])
def test_decontamination_takes_any_id_type(spark, kind):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("1", f"before it {passage} behind it"), ("2", "clean text")], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    items = spark.createDataFrame([("7", passage)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    C.ship(spark)
    out = decontaminate.find(docs, items)
    assert [(str(r.doc_id), str(r.item_id)) for r in out.collect()] == [("1", "7")] and out.schema["item_id"].dataType == items.schema["item_id"].dataType


# ------------------------------------------------------------------ 6: recall at the radius
def test_window_sums_are_those_of_each_bag():
    rng = np.random.default_rng(5)
    values = rng.integers(1, 1 << 63, 12).astype(np.uint64)
    for n, total in [(1, 7), (5, 5), (9, 60), (40, 300)]:
        h = values[rng.integers(0, len(values), total)]
        got = decontaminate._window_sums(h, n)
        for s in range(total - n + 1):
            bag = Counter(h[s:s + n].tolist())
            elements = [(x, k) for x, c in bag.items() for k in range(1, c + 1)]
            hashes = decontaminate._numbered(np.array([x for x, _ in elements], dtype=np.uint64), np.array([k for _, k in elements]))
            assert (got[s] == decontaminate._votes(hashes).sum(axis=0)).all()


def test_no_pair_at_the_threshold_is_outside_the_radius():
    """Pairs right at a similarity of 0.8: changed words spread out, in one place, and in a repeated shingle."""
    rng = random.Random(9)

    def words(n):
        return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]

    pairs = []
    for _ in range(150):
        base = words(104)
        pairs.append((base, base[:89 + 4] + words(11)))                      # 89 of 100 shingles shared at one end
        pairs.append((base[:84 + 4], base[:79 + 4] + words(5)))
        own, other = words(1)[0], words(1)[0]                                # a shingle repeated on each side
        pairs.append((base[:88] + [own] * 12, base[:88] + [other] * 12))
        short = words(9)
        pairs.append((short, short[:8]))                                     # four shingles of five
    matched = worst = 0
    for item, text in pairs:
        bags = [Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (item, text)]
        both = sum((bags[0] & bags[1]).values())
        similar = both / (sum(bags[0].values()) + sum(bags[1].values()) - both) >= 0.8
        found = list(decontaminate.Items([(1, " ".join(item))]).matches([" ".join(text).encode()], 0.8))
        assert bool(found) == similar
        matched += similar
        worst = max([worst, *(f[3] for f in found)])
    assert matched >= 400 and worst <= 28  # three bits within the radius and more


def test_items_of_one_repeated_word_and_long_texts():
    items = decontaminate.Items([(1, "again " * 400), (2, " ".join(f"w{i}" for i in range(300)))])
    text = " ".join(f"x{i}" for i in range(200_000)) + " " + "again " * 390 + " ".join(f"w{i}" for i in range(20, 300))
    assert {f[1] for f in items.matches([text.encode(), b"", b"again again again again again"], 0.8)} == {1, 2}
