"""Quality rules (operator 3): line sequence labelling with a linear-chain CRF.

Each ``\\n``-split line gets a few numbers (symbols, capitals, adjacent equal words, length, ...). A
linear-chain conditional random field with the states boilerplate (0) and content (1) is fitted
on the driver from a bounded sample of labelled documents; Viterbi decoding then labels the lines
of every document, and the share of words that stand in content lines decides retention.

The labels are per document. Lines of good documents are content. Lines of bad documents start as
boilerplate; a line classifier fitted on that moves those which look like the lines of good
documents back to content, and the CRF is fitted on the result.

Base rules: under ten words, or more than 20 % of the words in 5-word windows found twice.

Defined results: null and empty texts have no words and fail the base rules; equal rows give equal
rows; an empty table gives an empty result; without labels of both kinds every line is content;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattspark.llm.common import U64, Words, as_bytes, mix, pieces, shingles, with_columns

#: fixed values: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"

FEATURES = ["bias", "blank", "words", "word_length", "symbols", "marks", "capitals", "digits", "adjacent", "sentence_end", "pipes", "repeated", "first", "last"]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOL, _MARK, _UPPER, _DIGIT, _PIPE = (_table(x) for x in (SYMBOLS, SYMBOLS + b"!=_~^@\\/{}[]+", bytes(range(65, 91)), b"0123456789", b"|"))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(192, 256)]))  # lead bytes count for other letters


class Lines:
    """Lines of a list of texts: features, owner and word counts; and the base counts per text."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, lower=False)
        data, n = words.data, len(texts)
        newline = np.flatnonzero(data == 10)
        ends = np.sort(np.concatenate((newline, words.begin + words.sizes)))
        self.doc = np.searchsorted(words.begin, ends, side="right") - 1
        fresh = np.append(True, self.doc[1:] != self.doc[:-1]) if len(ends) else np.zeros(0, bool)
        starts = np.where(fresh, words.begin[self.doc], np.append(0, ends[:-1]) + 1) if len(ends) else ends
        first_word = np.searchsorted(words.start, starts)
        self.words = np.searchsorted(words.start, ends) - first_word

        def within(mask, lo=starts, hi=ends):
            total = np.append(0, np.cumsum(mask, dtype=np.int64))
            return total[hi] - total[lo]

        text_lo, text_hi = words.begin, words.begin + words.sizes
        char = (data & 0xC0) != 0x80
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        solid = char & ~space[data]
        chars = within(solid)
        self.n_words = np.diff(words.first)
        self.word_chars = within(solid, text_lo, text_hi)
        self.n_symbols = within(_SYMBOL[data], text_lo, text_hi)

        # 5-word windows found twice or more in one text
        at, h = shingles(words)
        own = mix(h ^ mix(words.doc[at].astype(U64) + U64(1)))
        order = np.sort(own)
        twice = order[1:][order[1:] == order[:-1]]
        depth = np.zeros(len(words.hash) + 5, dtype=np.int64)
        if len(twice):
            pos = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            hit = at[twice[pos] == own]
            depth[hit] += 1
            depth[hit + 5] -= 1
        total = np.append(0, np.cumsum(np.cumsum(depth) > 0))
        self.n_repeat_words = total[words.first[1:]] - total[words.first[:-1]]

        # lines equal to an earlier line of the same text
        repeated = np.zeros(len(ends), dtype=bool)
        has = self.words > 0
        i = 0
        for t in texts:
            seen, lines = set(), t.split(b"\n")
            if len(lines) > 1:
                for k, line in enumerate(lines, i):
                    if has[k]:
                        if line in seen:
                            repeated[k] = True
                        seen.add(line)
            i += len(lines)
        self.n_dup_lines = np.bincount(self.doc[repeated], minlength=n)

        letters, some = np.maximum(within(_LETTER[data]), 1), np.maximum(chars, 1)
        same = np.append(False, (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])) if len(words.hash) else np.zeros(0, bool)
        end_byte = words.data[np.maximum(words.end[np.minimum(first_word + np.maximum(self.words, 1) - 1, max(0, len(words.end) - 1))] - 1, 0)] if len(words.end) else np.zeros(len(ends), np.uint8)
        count = np.maximum(self.words, 1)
        pipes = within(_PIPE[data])
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(ends) else fresh
        self.x = np.stack([
            np.ones(len(ends)), ~has, np.minimum(np.log1p(self.words) / 5, 1.5), np.minimum(chars / count / 12, 2),
            np.minimum(within(_SYMBOL[data]) / count, 2), np.minimum(within(_MARK[data]) / count, 2),
            within(_UPPER[data]) / letters, within(_DIGIT[data]) / some, within(same, first_word, first_word + self.words) / count,
            has & np.isin(end_byte, list(b".!?:;")), np.minimum(pipes / count, 1), repeated, fresh, last], axis=1).astype(np.float64) if len(ends) else np.zeros((0, len(FEATURES)))


# ------------------------------------------------------------------ the model
def _sequences(doc: np.ndarray):
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return edge, np.diff(np.append(edge, len(doc)))


def fit_crf(x: np.ndarray, doc: np.ndarray, good: np.ndarray, steps: int = 200, rate: float = 0.15, decay: float = 1e-3) -> dict:
    """Fit unary weights (per feature, content minus boilerplate) and 2x2 transitions by gradient ascent."""
    y = good[doc].astype(np.float64)
    if not len(x) or y.all() or not y.any():
        return {"unary": [0.0] * x.shape[1], "step": [[0.0, 0.0], [0.0, 0.0]], "content_only": True}

    def ascend(grad, n):
        w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
        for t in range(1, steps + 1):
            g = grad(w) - decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return w

    # lines of bad documents that look like lines of good ones are content
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    line = ascend(lambda w: x.T @ (balance * (y - 1 / (1 + np.exp(-x @ w)))) / len(x), x.shape[1])
    y = np.where(good[doc] | (x @ line > 0), 1, 0)

    edge, size = _sequences(doc)
    longest, rows = int(size.max()), len(edge)
    pad = np.zeros((rows, longest), dtype=np.int64)
    on = np.arange(longest)[None, :] < size[:, None]
    pad[on] = np.arange(len(x))
    yy = np.where(on, y[pad], 0)
    seen_step = np.array([[((yy[:, :-1] == a) & (yy[:, 1:] == b) & on[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])

    def grad(w):
        """Observed minus expected feature counts, by forward-backward in log space."""
        score, step = x @ w[:-4], w[-4:].reshape(2, 2)
        u = np.stack([np.zeros((rows, longest)), np.where(on, score[pad], 0)], axis=2)
        fwd, bwd = np.zeros_like(u), np.zeros_like(u)
        fwd[:, 0] = u[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(on[:, t, None], u[:, t] + np.logaddexp(fwd[:, t - 1, 0, None] + step[0], fwd[:, t - 1, 1, None] + step[1]), fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = u[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(on[:, t + 1, None], np.logaddexp(nxt[:, 0, None] + step[:, 0], nxt[:, 1, None] + step[:, 1]), 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None])
        expected = np.zeros(len(x))
        expected[pad[on]] = p[on]
        pair = np.array([[np.exp(fwd[:, :-1, a] + step[a, b] + u[:, 1:, b] + bwd[:, 1:, b] - z[:, None])[on[:, 1:]].sum() for b in (0, 1)] for a in (0, 1)])
        return np.concatenate((x.T @ (y - expected), (seen_step - pair).ravel())) / rows

    w = ascend(grad, x.shape[1] + 4)
    return {"unary": w[:-4].tolist(), "step": w[-4:].reshape(2, 2).tolist(), "content_only": False}


def viterbi(x: np.ndarray, doc: np.ndarray, model: dict) -> np.ndarray:
    """The best state of every line (1 is content), sequence by sequence."""
    if model["content_only"]:
        return np.ones(len(x), dtype=np.int8)
    unary = (x @ np.array(model["unary"])).tolist()
    (s00, s01), (s10, s11) = model["step"]
    out = np.empty(len(x), dtype=np.int8)
    for lo, n in zip(*(a.tolist() for a in _sequences(doc))):
        a, b, back = 0.0, unary[lo], []
        for u in unary[lo + 1:lo + n]:
            from0, from1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((not from0, not from1))  # True: the best predecessor is content
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + u
        state = b > a
        out[lo + n - 1] = state
        for k in range(n - 2, -1, -1):
            state = back[k][state]
            out[lo + k] = state
    return out


# ------------------------------------------------------------------ on DataFrames
def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, lines: int = 200) -> dict:
    """Fit on at most ``sample`` labelled documents of each quality (those whose ids hash lowest) and
    ``lines`` lines of each; these bounds hold for the fit only."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)").distinct()
    spark = docs.sparkSession
    ids = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not ids:
        return fit_crf(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, bool))
    chosen = spark.createDataFrame(ids, known.schema)
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "quality", "text")

    def features(batches):
        for b in pieces(batches, 4 << 20):
            f = Lines(as_bytes(b.column("text")))
            at = np.concatenate([np.arange(lo, lo + min(n, lines)) for lo, n in zip(*_sequences(f.doc))]) if len(f.doc) else np.zeros(0, np.int64)
            doc = f.doc[at]
            edge = np.append(0, np.cumsum(np.bincount(doc, minlength=b.num_rows))).tolist()
            x = f.x[at]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x[lo:hi].tobytes() for lo, hi in zip(edge, edge[1:])], pa.binary())], names=["doc_id", "quality", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(features, f"doc_id {kind}, quality int, x binary").collect(), key=lambda r: (r.doc_id, r.quality, r.x))
    x = [np.frombuffer(r.x).reshape(-1, len(FEATURES)) for r in got]
    if not x:
        return fit_crf(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, bool))
    doc = np.repeat(np.arange(len(x)), [len(a) for a in x])
    return fit_crf(np.concatenate(x), doc, np.array([r.quality == 1 for r in got]))


def judge(docs: DataFrame, model: dict, least_share: float = 0.5) -> DataFrame:
    """Counts, the base rules, the content share and the verdict for every row of ``docs``."""
    src = with_columns(docs, doc_id=F.col("doc_id"), text=F.col("text"))

    def decided(batches):
        for b in pieces(batches, 4 << 20):
            f = Lines(as_bytes(b.column("text")))
            state = viterbi(f.x, f.doc, model)
            content = np.bincount(f.doc, weights=f.words * state, minlength=b.num_rows)
            share = content / np.maximum(f.n_words, 1)
            failed = (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)
            counts = [pa.array(a, pa.int64()) for a in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)]
            lines = np.bincount(f.doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(failed), pa.array(~failed & (share >= least_share)), pa.array(lines, pa.int64()), pa.array(np.bincount(f.doc, weights=state, minlength=b.num_rows).astype(np.int64)), pa.array(share)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(decided, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                   "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")


def keep_good(docs: DataFrame, model: dict, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    def filtered(batches):
        for b in pieces(batches, 4 << 20):
            f = Lines(as_bytes(b.column("text")))
            content = np.bincount(f.doc, weights=f.words * viterbi(f.x, f.doc, model), minlength=b.num_rows)
            failed = (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)
            yield b.filter(pa.array(~failed & (content >= least_share * f.n_words)))

    return docs.mapInArrow(filtered, docs.schema)
