"""Token ids of whole texts through tables of distinct words and chunks.

Texts of common characters are split into words by array operations that follow the vocabulary's own rules; each distinct
word goes to the library's model once and its ids are joined back by position. Words are told apart by 64-bit hashes in
tables of bounded size (that any two of 800,000 words share a hash has a chance of about one in 10^8).

Other texts are cut before every single space. Neither vocabulary has a token or a splitting rule that joins characters
across such a cut, so a chunk's ids do not depend on its neighbours: each distinct chunk goes to the library once. Where
that cannot be shown (a space beside other white space or beside a control character) and where a text could hold a special
token, the library encodes the text whole. So the ids are always the library's own.
"""

from __future__ import annotations

import gc
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np

from passplane.llm.base import Codes, by_size, one_thread, ranges
from passplane.llm.words import Batch, HashTable, batch_of, hashes, splits

#: A worker's tables of distinct chunks and words start anew beyond this many entries.
TABLE_LIMIT = 800_000

def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def _cut_is_safe(chunk: str) -> bool:
    """Whether white space rules cannot reach over the chunk's two ends."""
    return bool(chunk) and all(x.isalnum() or (not x.isspace() and unicodedata.category(x)[0] not in "ZC") for x in (chunk[0], chunk[-1]))


@dataclass
class Lists:
    """Lists of ids by code, end to end in one array."""

    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    length: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds lists after those that are there."""
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the codes, end to end, and how many each has."""
        lengths = self.length[codes]
        return self.ids[ranges(self.start[codes], lengths)], lengths


class WordEncoder:
    """Encodes texts with a byte-level file of the tokenizers library, each distinct word or chunk once."""

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the two kinds of files: one lower-cases and drops spaces, the other keeps them
        self.lower = self.library.encode(" A", add_special_tokens=False).ids == self.library.encode("a", add_special_tokens=False).ids
        self.letters = _byte_letters() | {0: "\0"}
        self._clear_words()
        self._clear_chunks()

    def _clear_words(self) -> None:
        self.word_codes, self.word_ids = HashTable(), Lists()

    def _clear_chunks(self) -> None:
        self.chunk_codes, self.chunk_ids, self.whole = Codes(), Lists(), np.zeros(0, bool)

    def _learn_words(self, words: list[str]) -> None:
        tokenize = self.library.model.tokenize
        found = [[x.id for x in tokenize(w)] for w in "\0".join(words).encode().decode("latin-1").translate(self.letters).split("\0")]
        self.word_ids.append(np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def plain(self, texts: list[str]) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as a batch, the hash and the text of each word of plain ones, their ids end to end and the ids' count
        by text."""
        if self.word_codes.size > TABLE_LIMIT:
            self._clear_words()
        b = batch_of(texts)
        starts, stops, cps = splits(b, self.lower)
        text_of = np.searchsorted(b.ends, starts)
        good = b.plain[text_of]
        starts, stops, text_of = starts[good], stops[good], text_of[good]
        keys = hashes(cps, starts, stops)
        codes, new = self.word_codes.of(keys)
        if len(new):
            gc.disable()  # many small lists and no cycles
            words = [b.text[x:y] for x, y in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            self._learn_words([w.lower() for w in words] if self.lower else words)
            gc.enable()
        ids, lengths = self.word_ids.of(codes)
        return b, keys, text_of, ids, np.bincount(text_of, lengths, len(texts)).astype(np.int64)

    def _learn_chunks(self) -> None:
        """Encodes the chunks that are new since the last call. A key with a leading space is the first of a text."""
        keys = last(self.chunk_codes, len(self.chunk_codes) - len(self.whole))
        found = [x.ids for x in self.library.encode_batch([k[1:] if k[:1] == " " else " " + k for k in keys], add_special_tokens=False)]
        self.whole = np.concatenate([self.whole, [not _cut_is_safe(k.removeprefix(" ")) for k in keys]])
        self.chunk_ids.append(np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def by_chunk(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text through distinct chunks."""
        if len(self.chunk_codes) > TABLE_LIMIT // 4:
            self._clear_chunks()
        out = []
        for text in texts:
            own = text.split(" ")
            own[0] = " " + own[0]
            codes = self.chunk_codes.of(own)
            if len(self.chunk_codes) > len(self.whole):
                self._learn_chunks()
            out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32) if self.whole[codes].any() else self.chunk_ids.of(codes)[0])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens."""
        return [ids for a, b in by_size(texts) for ids in self.encode_with_words(texts[a:b])[0]]

    def encode_with_words(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The ids of each text; the hash and the text of each word (for texts encoded by chunks: of each chunk)."""
        batch, keys, text_of, ids, counts = self.plain(texts)
        found = np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []
        odd = [k for k, x in enumerate(texts) if not batch.plain[k] or "<|" in x]
        for k, x in zip(odd, self.by_chunk([texts[k] for k in odd]), strict=True):
            found[k] = x
        chunks = [(k, zlib.crc32(w.encode("utf-8", "replace"))) for k in odd if not batch.plain[k] for w in texts[k].split()]
        if chunks:
            text_of = np.concatenate([text_of, [k for k, _ in chunks]])
            keys = np.concatenate([keys, np.array([h for _, h in chunks], np.uint64)])
        return found, keys, text_of


def last(table: dict, n: int) -> list[str]:
    """The n keys that came last, in order."""
    it = reversed(table)
    return [next(it) for _ in range(n)][::-1]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
