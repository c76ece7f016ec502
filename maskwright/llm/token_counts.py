"""Token counts of a public SentencePiece BPE model without encoding whole documents.

Method: the text is cut at every place where a space follows a non-space. No piece
of the model holds such a place inside (checked on loading), so no merge can cross
it and the number of pieces of a text is the sum over its pre-tokens. For a block of
documents the distinct pre-tokens are encoded once each; their piece counts are
joined to the (document, pre-token, frequency) table of the block and summed. A
document's token ids never exist.

The join is local to an Arrow batch because (document, pre-token) pairs are about as
many bytes as the text: a shuffle of them would move the corpus to save encodings of
words that each batch meets anyway. A bounded memo keeps counts between batches.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text of spaces only
is one pre-token; U+2581 is what the model turns spaces into, so it counts as one;
texts of any length are read whole; an empty table gives an empty one; repeated rows and
doc_ids, and null doc_ids, give a result for each row; other columns, whatever they are
called, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN_LIMIT = 4096
#: Pre-tokens kept between batches in each worker; beyond, the memo starts anew.
MEMO = 200_000
#: Pre-tokens longer than this are not kept.
MEMO_CHARS = 64
#: Texts handled together have at most about so many characters.
BLOCK_CHARS = 4_000_000

_PRE_TOKEN = re.compile(r" +[^ ]*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceCounter:
    """Counts pieces of texts with one SentencePiece model."""

    def __init__(self, model: str | Path):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=str(model))
        self.memo: dict[str, int] = {}
        odd = [p for i in range(self.model.get_piece_size()) if re.search("[^▁]▁", p := self.model.id_to_piece(i))]
        if odd:
            raise ValueError(f"pieces of this model cross a space, so pre-tokens do not add up: {odd[:3]}")

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; texts are not changed and not truncated."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        index: dict[str, int] = {}
        place = index.setdefault
        which, ends = [], [0]
        for text in texts:
            if text:
                which += [place(p, len(index)) for p in _PRE_TOKEN.findall(" " + text.replace("▁", " "))]
            ends.append(len(which))
        if not which:
            return np.zeros(len(texts), np.int64)
        distinct = list(index)
        counts = np.fromiter((memo.get(p, -1) for p in distinct), np.int64, len(distinct))
        todo = np.flatnonzero(counts < 0)
        # The model puts a space of its own before what it gets, in place of the one cut off here.
        for lo in range(0, len(todo), 4096):
            part = todo[lo : lo + 4096]
            found = self.model.encode([distinct[i][1:] or "" for i in part], num_threads=1)
            counts[part] = [len(x) for x in found]
        for i in todo:
            p = distinct[i]
            if len(p) == 1:
                counts[i] = self.alone
            if len(p) <= MEMO_CHARS:
                memo[p] = int(counts[i])
        # (document, pre-token, frequency), joined to the counts and summed
        document = np.repeat(np.arange(len(texts)), np.diff(ends))
        pairs, frequency = np.unique(document * len(distinct) + np.array(which, np.int64), return_counts=True)
        return np.bincount(pairs // len(distinct), counts[pairs % len(distinct)] * frequency, len(texts)).astype(np.int64)

    @property
    def alone(self) -> int:
        """Pieces of one space that ends a text: 'x ' has one more than 'x'."""
        return len(self.model.encode("x ")) - len(self.model.encode("x"))


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = TOKEN_LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row of docs. model: file of a SentencePiece BPE model on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = PieceCounter(model)
        counter = _counters[model]
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            block = np.cumsum(sizes) // BLOCK_CHARS
            counts = [np.zeros(0, np.int64)]
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1):
                counts.append(counter.count([texts[i] for i in part]))
            tokens = np.concatenate(counts)
            n_bytes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
