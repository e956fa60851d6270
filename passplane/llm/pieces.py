"""SentencePiece encoding and decoding through a table of distinct chunks.

In the vocabulary no piece has a white space marker after another character, so merges never cross the place before a
marker that follows another character: a text is cut there, each distinct chunk (a run of markers and the characters up to
the next) is segmented once by the library, and ids and decoded text are joined back by position. Models for which this
does not hold, and those with user-defined or white space rewriting rules, are refused by ``ChunkPieces``.

The table belongs to a task's worker and starts anew beyond a limit, so memory is bounded. Null texts are empty: no ids,
empty decoded text. Other columns are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import Codes, by_size, documents, one_thread, texts_of

MARK = "▁"
#: A worker's table starts anew beyond this many chunks.
TABLE_LIMIT = 400_000


class ChunkPieces:
    """Encodes and decodes with a SentencePiece model, each distinct chunk once."""

    def __init__(self, path: str):
        one_thread()
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i).lstrip(MARK)
            if MARK in piece:
                raise ValueError(f"piece {i} crosses a white space marker")
        probe = "a  b\tc \n d"
        if self.library.decode(self.library.encode(probe)) != probe:
            raise ValueError("the model rewrites white space")
        first = self.library.encode("a a")
        if len(first) != 2 or first[0] != first[1]:
            raise ValueError("the model adds no leading marker")
        self._clear()

    def _clear(self) -> None:
        self.codes = Codes()
        self.ids: list[str] = []
        self.counts: list[int] = []
        self.decoded: list[str] = []

    def _learn(self) -> None:
        """Segments the chunks that are new. A chunk stands without its first marker, which the library adds."""
        keys = [k for k, _ in zip(reversed(self.codes), range(len(self.codes) - len(self.ids)), strict=False)][::-1]
        for key, ids in zip(keys, self.library.encode(keys, num_threads=1), strict=True):
            self.ids.append(",".join(map(str, ids)))
            self.counts.append(len(ids))
            self.decoded.append(self.library.decode(ids))
            if not key:
                # one marker alone, which the library adds only to a text with characters
                mark = self.library.piece_to_id(MARK)
                self.ids[-1], self.counts[-1], self.decoded[-1] = str(mark), 1, ""

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of ids, the ids joined by commas, the decoded text."""
        for a, b in by_size(texts):
            if len(self.codes) > TABLE_LIMIT:
                self._clear()
            chunks, counts = [], []
            for text in texts[a:b]:
                own = self.split(text)
                counts.append(len(own))
                chunks += own
            codes = self.codes.of(chunks)
            if len(self.codes) > len(self.ids):
                self._learn()
            ids, decoded = self.ids, self.decoded
            sizes = np.array(self.counts, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            totals = np.concatenate([[0], np.cumsum(sizes)])
            listed, begin = codes.tolist(), 0
            for n in counts:
                own = listed[begin : begin + n]
                yield int(totals[begin + n] - totals[begin]), ",".join([ids[c] for c in own]), " ".join([decoded[c] for c in own])
                begin += n

    @staticmethod
    def split(text: str) -> list[str]:
        """The text's chunks, each without its first marker. Runs of markers stay with the characters after them."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" not in words:
            return words
        # the first word follows the marker that the library adds; an empty word is one more marker before the next
        out: list[str] = []
        held = 0
        for word in words:
            if word:
                out.append(" " * held + word)
                held = 0
            else:
                held += 1
        if held:
            out.append(" " * (held - 1))
        return out


_PIECES: dict[str, ChunkPieces] = {}


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Adds to every row n_tokens, ids (joined by commas) and decoded, of its text."""
    schema = "doc_id long, n_tokens long, ids string, decoded string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _run(batches, model, False), schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """As round_trip(), with SHA-256 digests in place of the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _run(batches, model, True), schema)


def _run(batches: Iterator[pa.RecordBatch], model: str, digest: bool) -> Iterator[pa.RecordBatch]:
    if model not in _PIECES:
        _PIECES[model] = ChunkPieces(model)
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    for batch in batches:
        counts, ids, decoded = [], [], []
        for n, x, y in _PIECES[model].encode(texts_of(batch.column("text"))):
            counts.append(n)
            ids.append(hashlib.sha256(x.encode()).hexdigest() if digest else x)
            decoded.append(hashlib.sha256(y.encode()).hexdigest() if digest else y)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
