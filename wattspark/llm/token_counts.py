"""Token counts (operator 5): overlap resynchronisation of huge documents.

A text of at most ``chunk_chars`` is encoded as a whole. A longer one is encoded in overlapping
chunks, with offsets. Two neighbouring chunks are spliced at a boundary that both have and that
is proven stable: the start of a piece. The first chunk starts at a piece of the whole text and the pattern looks at most one
character ahead, so all its pieces but those at its very end are pieces of the whole text; the pattern never looks back, so from a
common start on the second chunk has the pieces of the whole text as well; and BPE works piece by piece. The boundary keeps
``margin`` characters from the first chunk's end and the second one's start, more than any special
string is long, so no special string can be cut. Without such a boundary the overlap is doubled;
when it reaches the whole chunk, or the chunk is one piece, the chunk is doubled. So a text costs time in proportion to its length, and
memory per document is some chunks, or some times its longest piece, which BPE needs as a whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); equal rows give equal rows; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read of the input's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wattspark.llm.common import pieces, with_columns
from wattspark.llm.tokens import UnitEncoder


#: the characters that stand for white space in a byte-level vocabulary
_WHITE = "ĠĊĉčċČ"


def boundaries(enc, begin: int) -> dict[int, int]:
    """Offset in the text -> index of the token, for starts of pieces. Pieces that are or start with white space count only as
    one space before another character: offsets of the others may leave the white space out."""
    out, last = {}, None
    words, tokens, offsets = enc.word_ids, enc.tokens, enc.offsets
    for i, w in enumerate(words):
        if w is not None and w != last and i:
            t = tokens[i]
            if t[0] not in _WHITE or t[0] == "Ġ" and len(t) > 1 and t[1] not in _WHITE:
                out[begin + offsets[i][0]] = i
        last = w
    return out


def spliced_ids(encoder: UnitEncoder, text: str, chunk_chars: int, overlap: int):
    """Ids of ``text``, in runs, from overlapping chunks."""
    margin, n = encoder.special + 2, len(text)

    def encoded(lo, hi):
        e = encoder.tk.encode(text[lo:hi], add_special_tokens=False)
        return e.ids, boundaries(e, lo)

    lo, hi, taken = 0, min(n, chunk_chars), 0
    ids, edges = encoded(lo, hi)
    while hi < n:
        usable = [p for p, i in edges.items() if p < hi - margin and i >= taken]
        wide = overlap
        while usable and hi - wide > lo and hi - wide + margin >= usable[-1]:
            wide *= 2  # no boundary of the first chunk lies in the overlap
        both = []
        while usable and not both and (at := hi - wide) > lo:
            to = min(n, hi + chunk_chars)
            more, further = encoded(at, to)
            both = [p for p in usable if at + margin < p and p in further]
            wide *= 2
        if both:
            yield ids[taken:edges[both[-1]]]
            lo, hi, ids, edges, taken = at, to, more, further, further[both[-1]]
        else:  # nothing to align on in the whole chunk: one of twice the length
            hi = min(n, 2 * hi - lo)
            ids, edges = encoded(lo, hi)
    yield ids[taken:]


def count_tokens(docs: DataFrame, vocab: str, limit: int = 1024, chunk_chars: int = 32768, overlap: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs`` (columns ``doc_id``, ``text``)."""
    src = with_columns(docs, doc_id=F.col("doc_id"), text=F.col("text"))

    def library(batches):
        for b in pieces(batches, 2 << 20, cache="tokens"):
            texts = pc.fill_null(b.column("text"), "")
            if vocab.endswith(".model"):
                import sentencepiece
                sp = sentencepiece.SentencePieceProcessor(model_file=vocab)
                count = np.array([len(sp.encode(t)) for t in texts.to_pylist()], dtype=np.int64)
            else:
                encoder = UnitEncoder.get(vocab)
                huge = pc.greater(pc.utf8_length(texts), chunk_chars) if encoder.units else pa.array(np.zeros(len(texts), bool))
                _, count = encoder.encode(pc.if_else(huge, "", texts))
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist():
                    count[i] = sum(len(run) for run in spliced_ids(encoder, texts[i].as_py(), chunk_chars, overlap))
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(count, pa.int64()), pa.array(count > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(library, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
