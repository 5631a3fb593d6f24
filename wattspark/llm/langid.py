"""Language ID (operator 8): cross-parsing entropy against labelled text per language.

For each language, a suffix automaton of some labelled text recognises all its substrings. A
document is parsed from left to right into phrases, each the longest match that the automaton
still accepts; the fewer phrases, the more alike the texts. Phrases are normalised by the size of
the training text (``phrases * log2(train) / characters``, the cross-parsing entropy estimate), and
the language that needs fewest wins; ties go to the alphabetically first.

Every character of every text is parsed. Parsing starts anew each ``SEGMENT`` characters, so that
all segments of an Arrow batch advance together: one table lookup per character and language.
Characters are compared without case; all that is not a letter counts as a space.

The fit is bounded: ``docs_per_lang`` documents per language (those whose ids hash lowest), the first
``doc_chars`` characters of each; at most ``total_chars`` over all languages.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything when
nothing was learned; score is 1 - best / second best (1 with one language); equal rows give equal
rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wattspark.llm.common import CACHES, pieces, with_columns

SEGMENT = 256
#: character classes: padding, space, letters that were not in the training texts, then letters
PAD, SPACE, OTHER, LETTERS = 0, 1, 2, 3


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def table(symbols: list[int], classes: int) -> np.ndarray:
    """``next_state * 2 + starts_a_phrase`` for each state and class, restarts included."""
    edges = automaton(symbols)
    out = np.empty((len(edges), classes), dtype=np.uint32)
    start = np.ones(classes, dtype=np.uint32)  # an unknown symbol is a phrase of its own
    for c, to in edges[0].items():
        if c < classes:
            start[c] = 2 * to + 1
    out[:] = start
    for state, to in enumerate(edges):
        if state:
            for c, t in to.items():
                if c < classes:
                    out[state, c] = 2 * t
    out[:, PAD] = 0
    return out


def fit(docs: DataFrame, docs_per_lang: int = 24, doc_chars: int = 1000, total_chars: int = 240_000) -> dict:
    """Learn from ``doc_id, text, lang`` rows with a language: ``{"alphabet": str, "langs": {lang: [symbols]}}``."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("lang"), F.xxhash64("doc_id").alias("h"), F.lower(F.substring("text", 1, doc_chars)).alias("head"))
    rows = rows.where("lang IS NOT NULL AND rlike(head, '\\\\p{L}')")
    order = Window.partitionBy("lang").orderBy("h", "id", "head")  # Spark limits each group before the shuffle
    got = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).select("lang", "k", "head").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.k)):
        texts.setdefault(r.lang, []).append(r.head)
    share = total_chars // max(1, len(texts))
    joined = {lang: "\0".join(t)[:share] for lang, t in texts.items()}
    letters = sorted({c for t in joined.values() for c in t if c.isalpha() and ord(c) < 1 << 16})
    number = {c: LETTERS + i for i, c in enumerate(letters)}
    end = LETTERS + len(letters)  # a document's end: no text has this class
    return {"alphabet": "".join(letters), "langs": {lang: [end if c == "\0" else number.get(c, OTHER) if c.isalpha() else SPACE for c in t] for lang, t in sorted(joined.items())}}


class Parser:
    """The tables of a model, made once per worker."""

    _of: dict[int, "Parser"] = {}

    @classmethod
    def get(cls, key: int, model: dict) -> "Parser":
        if key not in cls._of:
            cls._of.clear()
            cls._of[key] = cls(model)
        CACHES["langid"] = cls._of.clear
        return cls._of[key]

    def __init__(self, model: dict):
        self.langs = list(model["langs"])
        self.classes = LETTERS + len(model["alphabet"])
        self.tables = [table(s, self.classes).reshape(-1) for s in model["langs"].values()]
        self.weight = [math.log2(max(2, len(s))) for s in model["langs"].values()]
        self.of = np.full(1 << 16, SPACE, dtype=np.uint8 if self.classes < 256 else np.uint32)
        number = {c: LETTERS + i for i, c in enumerate(model["alphabet"])}
        for code in range(1 << 16):
            c = chr(code)
            if c.isalpha():
                self.of[code] = number.get(c.lower(), OTHER)

    def symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(code) and code.max() >= 1 << 16:
            out = self.of[np.minimum(code, 0xFFFF)]
            for i in np.flatnonzero(code >= 1 << 16).tolist():
                out[i] = OTHER if chr(code[i]).isalpha() else SPACE
            return out
        return self.of[code]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per text and language, characters per text, whether a text has a letter)."""
        parts = [self.symbols(t) for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        segments = (size + SEGMENT - 1) // SEGMENT
        grid = np.zeros(segments.sum() * SEGMENT, dtype=self.of.dtype)
        begin = (np.cumsum(segments) - segments) * SEGMENT
        for p, b in zip(parts, begin.tolist()):
            grid[b:b + len(p)] = p
        owner = np.repeat(np.arange(len(parts)), segments)
        letter = np.bincount(owner, weights=(grid.reshape(-1, SEGMENT) > SPACE).any(axis=1), minlength=len(parts)) > 0
        columns = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        out = np.zeros((len(parts), len(self.tables)))
        for k, t in enumerate(self.tables):
            state = np.zeros(columns.shape[1], dtype=np.uint32)
            count = np.zeros(columns.shape[1], dtype=np.uint32)
            for c in columns:
                got = t[state * np.uint32(self.classes) + c]
                count += got & np.uint32(1)
                state = got >> np.uint32(1)
            out[:, k] = np.bincount(owner, weights=count, minlength=len(parts))
        return out, size, letter


def predict(docs: DataFrame, model: dict, keep: list[str] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``lang_pred`` and ``score`` for every row of ``docs``."""
    src = with_columns(docs, doc_id=F.col("doc_id"), text=F.col("text"), **{c: F.col(c) for c in keep})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most total_chars symbols
    key = id(shared) ^ hash(model["alphabet"])

    def predicted(batches):
        parser = Parser.get(key, shared.value)
        for b in pieces(batches, 4 << 20, cache="langid"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            if parser.langs:
                phrases, size, letter = parser.phrases(texts)
                rate = phrases * np.array(parser.weight) / np.maximum(size, 1)[:, None]
                best = rate.argmin(axis=1)  # the first of equals
                order = np.sort(rate, axis=1)
                second = order[:, 1] if order.shape[1] > 1 else np.full(len(texts), np.inf)
                score = np.where(letter, 1 - order[:, 0] / np.maximum(second, 1e-12), 0.0)
                names = [parser.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist())]
            else:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in keep], pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", *keep, "lang_pred", "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "text")
    return src.mapInArrow(predicted, f"{fields}, lang_pred string, score double")
