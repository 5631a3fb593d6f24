"""Encoding whole texts with the ``tokenizers`` library, fast on a cluster.

A byte-level BPE tokenizer never joins two pieces over a single space between two other
characters: the pattern starts a new piece at that space. So a text can be cut there, and each
unit (a space and what follows up to the next such space) has the same ids wherever it stands.
Units repeat a lot, so each worker keeps the ids of the units it has seen.
"""

from __future__ import annotations

import array
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wattspark.llm.common import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: units kept per worker (some 200 bytes each); at the limit the memory is emptied and filled anew. Rare words make most of the
#: distinct ones, so that each emptying costs about as much as it took to fill it
KEEP = 1_500_000
#: the same for pieces without a space before them
HEADS = 105_000
#: longer units and pieces are not kept
LONGEST = 64

# letters of which each is of category L, and ASCII marks without the apostrophe (it starts contractions)
_LET = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARK = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"([{_LET}]+)([{_MARK}]*)(?:\n([{_LET}]+)([{_MARK}]*))?")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    """Ids of whole texts; the same as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    _of: dict[str, "UnitEncoder"] = {}

    @classmethod
    def get(cls, path: str) -> "UnitEncoder":
        """One per worker and vocabulary file."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        CACHES["tokens"] = cls._of.clear
        return cls._of[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.model = self.tk.model
        spec = json.loads(self.tk.to_str())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.units = (spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
                      and not model.get("ignore_merges") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                      and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]))
        self.dtype = np.dtype("<u2" if self.tk.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.special = max([0, *(len(a["content"]) for a in spec["added_tokens"])])
        self.chars = _byte_chars()
        self.seen: dict[str, bytes] = {}    # unit without its space -> ids
        self.heads: dict[str, bytes] = {}   # text without a space before it -> ids
        self.odd: set[str] = set()          # units with white space at an edge: not cut there

    def _ids(self, text: str) -> bytes:
        return array.array(self.code, self.tk.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, text: str) -> bytes:
        """Ids of one piece of letters (with or without a space before it)."""
        mapped = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(self.chars)
        return array.array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _head(self, text: str) -> bytes:
        got = self.heads.get(text)
        if got is None:
            got = self._ids(text)
            if len(text) <= LONGEST:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                self.heads[text] = got
        return got

    def _unit(self, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():
            return self._letters(" " + unit)
        m = _PLAIN.fullmatch(unit)
        if not m:
            return self._ids(" " + unit)
        word, marks, next_word, next_marks = m.groups()
        got = self.seen.get(word)
        if got is None:
            got = self._letters(" " + word)
            if len(word) <= LONGEST:
                self.seen[word] = got
        if marks:
            got += self._head(marks)
        if next_word:
            got += self._head("\n") + self._head(next_word) + (self._head(next_marks) if next_marks else b"")
        return got

    def _slow(self, text: str) -> bytes:
        """A text with runs of white space: cut only at spaces between two other characters."""
        units = _CUT.split(text)
        return self._ids(units[0]) + b"".join(self._unit(u) for u in units[1:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text); null is empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if not self.units:
            ids = [np.array(e.ids, dtype=self.dtype) for t in texts.to_pylist() for e in [self.tk.encode(t, add_special_tokens=False)]]
            return np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64)
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy().astype(np.int64)
        if len(self.seen) > KEEP:
            self.seen.clear()
        # a text's first unit has no space before it
        first = offsets[:-1]
        rest = np.ones(len(index), dtype=bool)
        rest[first] = False
        used = np.zeros(len(names), dtype=bool)
        used[index[rest]] = True
        values = [self.seen.get(n) if u else b"" for n, u in zip(names, used.tolist())]
        odd = np.zeros(len(names), dtype=bool)
        for i, v in enumerate(values):
            if v is None:
                n = names[i]
                if not n or n[0].isspace() or n[-1].isspace():
                    odd[i], values[i] = True, b""
                else:
                    values[i] = self._unit(n)
                    if len(n) <= LONGEST:
                        self.seen[n] = values[i]
        texts_odd = np.zeros(len(texts), dtype=bool)
        if odd.any():
            texts_odd |= np.add.reduceat((odd[index] & rest).astype(np.int64), first) > 0
        heads = [names[i] for i in index[first].tolist()]
        alone = np.diff(offsets) == 1
        texts_odd |= ~alone & np.fromiter((not h or h[-1].isspace() for h in heads), bool, len(heads))
        index[first] = len(names) + np.arange(len(heads))
        values += [b"" if o else self._head(h) for h, o in zip(heads, texts_odd.tolist())]
        width = self.dtype.itemsize
        length = np.fromiter(map(len, values), np.int64, len(values)) // width
        flat = np.frombuffer(b"".join(values), dtype=self.dtype)
        start = np.cumsum(length) - length
        n = length[index]
        ids = flat[np.repeat(start[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        count = np.add.reduceat(n, first)
        if texts_odd.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(texts_odd).tolist():
                parts[i] = np.frombuffer(self._slow(texts[i].as_py()), dtype=self.dtype)
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count
