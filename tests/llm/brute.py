"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BARE = re.compile(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_rows(rows):
    """{doc_id: (start, n_tokens, crc32)} of rows in ascending id order."""
    tk, out, start = tokenizer(), {}, 0
    for i, t in sorted(rows):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_spans(t):
    """Base spans by kind, as strings."""
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(k, m.group())] for k, p in PII.items()]


def quality_counts(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def shingle_set(t):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def jaccard_classes(rows):
    """{doc_id: (n_shingles, smallest id of the class)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x]}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def leaks(docs, items, least=0.8):
    """{(doc_id, item_id)} with an item-sized window of at least that weighted Jaccard similarity."""
    def sh(t):
        w = BARE.findall(lower(t or ""))
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    bags = [(i, sh(t)) for i, t in items]
    by = defaultdict(set)
    for k, (_, s) in enumerate(bags):
        for x in s:
            by[x].add(k)
    out = set()
    for d, t in docs:
        s = sh(t)
        for k in set().union(*[by[x] for x in s if x in by]) if s else ():
            i, bag = bags[k]
            n, c = min(len(bag), len(s)), Counter(bag)
            for a in range(len(s) - n + 1):
                both = sum((Counter(s[a:a + n]) & c).values())
                if both / (n + len(bag) - both) >= least:
                    out.add((d, i))
                    break
    return out


def repeats(rows, span=400):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] in the order of the rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[i:i + span] for _, t in texts for i in range(len(t) - span + 1))
    out = []
    for k, t in texts:
        edge = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - span + 1):
            if count[t[i:i + span]] > 1:
                edge[i] += 1
                edge[i + span] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((k, len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
