"""Operator 10: token counts by whole-token shortcuts.

A piece model without merges across spaces splits a text into pre-tokens (spaces and the word after
them). Which vocabulary strings encode alone as one token is proved once, on the driver, by merging
each of them. Texts are then counted by a table look-up for each pre-token: proved strings count
one, the rest are merged exactly and kept in a bounded table.

Defined results: a null or empty text has 0 bytes and 0 tokens; a repeated row gives a row each
time; an empty table gives an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
TOKEN_LIMIT = 4096


class PieceModel:
    """Pieces and their scores: merging takes the best-scored adjacent pair, the leftmost of equals."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.cuttable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self.newline_alone = not any("\n" in p for p in scores)
        inner = " *[^ \n]+| +|\n" if self.newline_alone else " *[^ ]+| +"
        self.split = re.compile(inner if self.cuttable else r"(?s).+").findall
        self.whole: frozenset[str] = frozenset()
        self.table: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        model = cls({sp.id_to_piece(i): sp.get_score(i) for i in ids})
        model.prove()
        return model

    def prove(self) -> None:
        """Finds the vocabulary strings that merge to themselves."""
        self.whole = frozenset(p.replace(SPACE, " ") for p in self.scores if len(self.merge(p)) == 1)

    def merge(self, word: str) -> list[str]:
        """The pieces of one pre-token (spaces as SPACE), by exact merging in O(n log n)."""
        scores, sym = self.scores, list(word)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := scores.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if sym[i] else n
            if j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (s := scores.get(sym[i] + sym[k])) is not None:
                    heapq.heappush(heap, (-s, i, size + len(sym[k])))
            if (h := prv[i]) >= 0 and (s := scores.get(sym[h] + sym[i])) is not None:
                heapq.heappush(heap, (-s, h, size + len(sym[h])))
        return [x for x in sym if x]

    def count_word(self, word: str) -> int:
        """A pre-token's tokens; a character outside the vocabulary counts its bytes."""
        if word in self.whole:
            return 1
        return sum(1 if p in self.scores else len(p.encode()) for p in self.merge(word.replace(" ", SPACE)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        words, table = self.split(" " + text.replace(SPACE, " ")), self.table
        try:
            return sum(map(table.__getitem__, words))
        except KeyError:
            if len(table) > common.CACHE_TOKENS:
                table.clear()
            long = {}  # not kept: without spaces a pre-token is a paragraph
            for w in set(words).difference(table):
                (table if len(w) <= common.CACHE_LENGTH else long)[w] = self.count_word(w)
            return sum(table[w] if w in table else long[w] for w in words) if long else sum(map(table.__getitem__, words))


@functools.lru_cache(2)
def _loaded(path: str) -> PieceModel:
    return PieceModel.from_file(path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. One narrow pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(_loaded(model_path))  # a vocabulary: as large as the model file

    def run(batches):
        m = model.value
        for b in common.chunked(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([m.count(t) for t in common.texts_of(b)], pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
