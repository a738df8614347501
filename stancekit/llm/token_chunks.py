"""Whole texts to token ids, each distinct chunk of a batch encoded once.

Byte-pair encoders work on pre-tokens: no merge crosses a pre-token. A text
can therefore be cut wherever a pre-token is certain to end, its chunks be
encoded apart, and the ids be laid end to end. Corpora repeat their chunks, so
the tokenizer sees each distinct chunk of a batch once; numpy does the rest.

Cuts are made only where both supported pre-tokenizers end a pre-token
whatever stands around:

* before a blank or line break that follows a printable character;
* after a single line break between printable characters;
* between a letter and an ASCII sign (not the apostrophe, which begins
  contractions), in either order.

Printable means visible ASCII and the letters U+00C0 to U+00FF; next to any
other character no cut is made.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stancekit.llm.common import text_buffers

_LETTER, _SIGN, _BLANK, _OTHER = 1, 2, 3, 0
_CLASS = np.zeros(256, np.uint8)
for _c in range(0x21, 0x7F):
    _CLASS[_c] = _LETTER if chr(_c).isalpha() else _SIGN
_CLASS[[*range(0x30, 0x3A), 0x27]] = 4  # digits, apostrophe: printable, never cut off from letters
_CLASS[[0x20, 0x0A]] = _BLANK

# A chunk of these letters alone is one pre-token: the model can take it
# without normaliser and pre-tokenizer.
_PLAIN = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
# Above as many known chunks per worker process, those go that came only once.
KEEP_CHUNKS = 150_000
_LINES = 1000  # plain chunks encoded as one text


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start in ``data``; the start of every text is one."""
    if not len(data):
        return np.zeros(0, np.int64)
    k = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF in two bytes
    lead = lead[data[lead + 1] != 0x97]
    lead = lead[data[lead + 1] != 0xB7]  # the two signs among them
    k[lead] = k[lead + 1] = _LETTER
    printable = (k != _OTHER) & (k != _BLANK)
    cut = np.zeros(len(data), bool)
    prev, cur = k[:-1], k[1:]
    cut[1:] = printable[:-1] & (cur == _BLANK)
    cut[1:] |= ((prev == _LETTER) & (cur == _SIGN)) | ((prev == _SIGN) & (cur == _LETTER))
    cut[2:] |= printable[:-2] & (data[1:-1] == 0x0A) & printable[2:]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class ChunkTokenizer:
    """``ids(texts)`` for a byte-level BPE tokenizer file of the ``tokenizers``
    library, without special tokens; their strings count as ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.vocab_size = self.full.get_vocab_size()
        self.word_ends = bool(getattr(self.full.model, "end_of_word_suffix", None))
        self.plain = Tokenizer.from_file(path)  # takes one pre-token a line
        self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        # Bytes that byte-level models write as another character.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in shown]
        of = {b: chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)}
        if self.word_ends:  # in lower case, without the blank before
            of |= {b: of[b + 0x20] for b in (*range(0x41, 0x5B), *range(0x80, 0x9F))} | {0x20: ""}
        of[0x0A] = "\n"
        self.width = np.array([len(of[b].encode()) for b in range(256)])
        self.shown = np.frombuffer(b"".join(of[b].encode().ljust(2) for b in range(256)), np.uint8)
        self.known = pa.array([], pa.large_string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _as_shown(self, plain: pa.Array) -> list[str]:
        """Plain chunks as the model writes them, one a line, in texts of ``_LINES``."""
        data, offsets = text_buffers(plain)
        data = np.insert(data, offsets[1:], 0x0A)
        width = self.width[data]
        end = np.cumsum(width)
        out = self.shown[np.repeat(2 * data.astype(np.int64) - (end - width), width) + np.arange(end[-1])]
        lines = np.flatnonzero(out == 0x0A)
        cuts = [0, *(lines[_LINES - 1:-1:_LINES] + 1).tolist(), len(out)]
        return [out[a:b - 1].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, chunks: pa.Array) -> None:
        """Encode chunks not met before and keep their ids."""
        is_plain = pc.match_substring_regex(chunks, _PLAIN)
        plain, hard = chunks.filter(is_plain), chunks.filter(pc.invert(is_plain))
        sizes, flats = [self.size], [self.flat]
        for i, e in enumerate(self.plain.encode_batch(self._as_shown(plain) if len(plain) else [], add_special_tokens=False)):
            sizes.append(np.bincount(np.asarray(e.word_ids, np.int64), minlength=min(_LINES, len(plain) - i * _LINES)))
            flats.append(np.asarray(e.ids, np.uint32))
        for e in self.full.encode_batch_fast(hard.to_pylist(), add_special_tokens=False):
            sizes.append(np.asarray([len(e)], np.int64))
            flats.append(np.asarray(e.ids, np.uint32))
        self.known = pa.concat_arrays([self.known, plain, hard])
        self.size, self.flat = np.concatenate(sizes), np.concatenate(flats)

    def _of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known chunks, end to end, and where each chunk's end."""
        per = self.size[code]
        end = np.cumsum(per)
        first = np.cumsum(self.size) - self.size
        return self.flat[np.repeat(first[code] - (end - per), per) + np.arange(end[-1] if len(end) else 0)], end

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, end to end, and each text's number."""
        data, offsets = text_buffers(texts)
        starts = cut_points(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds),
                                                 pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy()
        code = pc.index_in(chunks, value_set=self.known)
        met = code.is_valid().to_numpy(zero_copy_only=False)
        if not met.all():
            self._learn(chunks.filter(pa.array(~met)))
            code = pc.index_in(chunks, value_set=self.known)
        code = code.to_numpy()
        ids, end = self._of(code[at])
        if len(self.known) > KEEP_CHUNKS:
            again = met | (np.bincount(at) > 1)
            flat, _ = self._of(code[again])
            self.known, self.size, self.flat = chunks.filter(pa.array(again)), self.size[code[again]], flat
        done = np.concatenate(([0], end))
        at = np.searchsorted(starts, offsets)  # chunks before each text
        return ids, np.diff(done[at])


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per worker process and file."""
    return ChunkTokenizer(path)
