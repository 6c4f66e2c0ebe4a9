"""Token ids of many texts with the tokenizers library, each distinct word encoded once.

Where the tokenizer lower-cases, drops white space and marks word ends, the ids of a text are the ids of its
words one after another. Arrow splits the texts of a slice and numbers their distinct words; new words go through the
library together, a word of letters with one mark at its end as its letters and its mark, and the ids of a bounded
number of words are kept between slices. Any other tokenizer, and any text that could hold a special token, is encoded
as it stands.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would keep memory of its own

KEEP_WORDS = 300_000
KEEP_BYTES = 1 << 24  # of their letters
GATHER_WORDS = 1 << 17
_TAIL = ".,;:!?"
_LETTERS = "[a-zß-öø-ÿαγ-ωа-џ]+"  # lower case, composed, and letters in every version of Unicode
_MARK = np.zeros(256, dtype=np.int64)
_MARK[list(_TAIL.encode())] = np.arange(len(_TAIL))
_encoders: dict[str, WordEncoder] = {}


def vocabulary(path: str) -> int:
    """How many ids a tokenizer has."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def id_type(vocab: int) -> np.dtype:
    return np.dtype("<u2") if vocab <= 1 << 16 else np.dtype("<u4")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: ``(codes, words, ends)``. ``words[codes]`` are the words of all texts one after
    another, those of text i from ``ends[i]`` to ``ends[i + 1]``; white space at an end of a text makes an empty word."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, ends


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = id_type(self.vocab_size)
        norm, pre = repr(self.tokenizer.normalizer), repr(self.tokenizer.pre_tokenizer)
        self.by_word = (
            getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>" and "Lowercase" in norm and "Removed" in pre and "ByteLevel" in pre
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = IdTable(self.word_ids)
        if self.by_word:
            told = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in told["merges"]]
            # the same merges, without normalisation, and without a cache as every word comes once
            self.plain = Tokenizer(models.BPE(told["vocab"], merges, cache_capacity=0, end_of_word_suffix="</w>"))
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.vocab_size, dtype=bool)
            self.ends[[i for t, i in told["vocab"].items() if t.endswith("</w>")]] = True
            # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest follow from U+0100
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in set(own)]
            self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    @staticmethod
    def of(path: str, holder: str = "wordbpe") -> WordEncoder:
        """One encoder a process and file, kept for the operator ``holder``."""
        hold(holder, _encoders.clear)
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of single words one after another, and how many each has."""
        told = pa.array(words, pa.large_string())
        two = pc.match_substring_regex(told, f"^{_LETTERS}[{_TAIL}]$").to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(two), pc.utf8_slice_codeunits(told, 0, -1), told).dictionary_encode()
        at = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start, size = self._parts(pa.concat_arrays([stems.dictionary, pa.array([*_TAIL], pa.large_string())]))
        bytes_of, last = np.frombuffer(told.buffers()[2] or b"", np.uint8), np.frombuffer(told.buffers()[1], np.int64)[1 : len(words) + 1]
        marks = len(stems.dictionary) + _MARK[bytes_of[last[two] - 1]]
        # a row of parts for every word: its stem and, for some, its mark
        parts = np.repeat(at, 1 + two)
        parts[np.cumsum(1 + two)[two] - 1] = marks
        n = size[at]
        n[two] += size[marks]
        return gather(flat, start, size, parts), n

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, with their starts and sizes. Words of plain letters go through the merges alone, many at once."""
        start, size = np.zeros((2, len(words)), dtype=np.int64)
        flat, held = [np.empty(0, self.dtype)], 0
        ascii_ = pc.match_substring_regex(words, "^[a-z]+$").to_numpy(zero_copy_only=False)
        letters = pc.match_substring_regex(words, f"^{_LETTERS}$").to_numpy(zero_copy_only=False)
        whole = [np.flatnonzero(~letters)]
        for kind in (np.flatnonzero(ascii_), np.flatnonzero(letters & ~ascii_)):
            for s in range(0, len(kind), 2000):
                rows = kind[s : s + 2000]
                some = words.take(pa.array(rows)).to_numpy(zero_copy_only=False).tolist()
                text = " ".join(some)
                if not text.isascii():
                    if not unicodedata.is_normalized("NFC", text):
                        whole.append(rows)
                        continue
                    text = " ".join([w.encode().decode("latin-1").translate(self.alphabet) for w in some])
                ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
                cuts = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
                if len(cuts) != len(some) + 1:
                    whole.append(rows)
                    continue
                start[rows], size[rows] = held + cuts[:-1], np.diff(cuts)
                flat.append(ids)
                held += len(ids)
        rest = np.concatenate(whole)
        for s in range(0, len(rest), 2000):
            rows = rest[s : s + 2000]
            ids = self.whole(words.take(pa.array(rows)).to_pylist())
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            start[rows], size[rows] = held + np.cumsum(n) - n, n
            flat += ids
            held += int(n.sum())
        return np.concatenate(flat), start, size

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """The ids of each text, with ``end_id`` after them, as little-endian integers of ``dtype`` in a binary array."""
        tail = [] if end_id is None else [end_id]
        lowered = pc.ascii_lower(texts) if self.by_word else texts
        if not self.by_word or any(pc.any(pc.match_substring(lowered, s.lower())).as_py() for s in self.special):
            return pa.array([np.concatenate((x, np.array(tail, self.dtype))).tobytes() for x in self.whole(texts.to_pylist())], pa.binary())
        codes, words, ends = split_words(lowered)
        numbers = self.kept.numbers(words.to_numpy(zero_copy_only=False).tolist())
        flat, start, size = self.kept.flat, self.kept.start, self.kept.size
        done, parts = np.zeros(len(codes) + 1, dtype=np.int64), []
        for s in range(0, len(codes), GATHER_WORDS):
            at = numbers[codes[s : s + GATHER_WORDS]]
            np.cumsum(size[at], out=done[s + 1 : s + 1 + len(at)])
            done[s + 1 : s + 1 + len(at)] += done[s]
            parts.append(gather(flat, start, size, at))
        ids = np.concatenate(parts) if parts else np.empty(0, self.dtype)
        offsets = done[ends]
        if tail:
            ids = np.insert(ids, offsets[1:], np.array(end_id, self.dtype))
            offsets = offsets + np.arange(len(offsets))
        self.kept.trim(KEEP_WORDS, KEEP_BYTES)
        offsets = (offsets * self.dtype.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, self.dtype))])


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``flat[start[r] : start[r] + size[r]]`` of all rows r, one after another."""
    n = size[rows]
    upto = np.cumsum(n)
    return flat[np.repeat(start[rows] - (upto - n), n) + np.arange(int(upto[-1]) if len(n) else 0)]


class IdTable:
    """Ids of words by number; a word gets its number when it first comes."""

    def __init__(self, encode):
        self.encode = encode
        self.index: dict[str, int] = {}
        self.flat: np.ndarray | None = None
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.letters = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            new = list(dict.fromkeys(words[i] for i in unknown.tolist()))
            flat, size = self.encode(new)
            held = 0 if self.flat is None else len(self.flat)
            first = len(self.size)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.flat = flat if self.flat is None else np.concatenate((self.flat, flat))
            self.start = np.concatenate((self.start, held + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.letters += sum(map(len, new))
            out[unknown] = [self.index[words[i]] for i in unknown.tolist()]
        return out

    def trim(self, words: int, letters: int) -> None:
        """Forget the words that came last, down to so many words and letters."""
        n = len(self.index)
        while len(self.index) > words or self.letters > letters:
            self.letters -= len(self.index.popitem()[0])
        keep = len(self.index)
        if keep < n and self.flat is not None:
            self.flat = self.flat[: self.start[keep]].copy()
            self.start, self.size = self.start[:keep].copy(), self.size[:keep].copy()
