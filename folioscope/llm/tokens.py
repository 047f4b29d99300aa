"""Token ids of whole texts, through a bounded cache of words in each worker."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in each of the two generations of the cache.
CACHE_WORDS = 256_000
#: Bytes of text that are split into words at a time.
STRETCH = 4 << 20
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TAIL = "(?P<marks>[" + re.escape(_MARKS) + r"]+)\z"
_ENDS_IN_LETTER = r"[\p{L}0-9]\z"
_SPECIAL = "<|"
_SPACE = re.compile(rb"[ \t-\r]")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = re.compile("[a-z]+").fullmatch
#: Words of letters that are encoded in one call.
TOGETHER = 2000
_LOADED: dict[str, WordIds] = {}


class WordIds:
    """Encodes texts word by word.

    For a tokenizer that lowers all text and whose pre-tokenizer never joins
    text across white space or letters to punctuation, as in BPE over words
    with word ends, the ids of a text are those of its words in turn, and
    those of a word with marks behind it are the word's and the marks'.  Texts
    are split and their distinct words found a stretch at a time, in Arrow;
    Python sees each distinct word of a stretch once, without its marks.  A
    word's ids are kept as packed bytes.  Words unused for a generation of the
    cache are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.plain = self._keeps_letters()
        self.ends = self._word_ends()
        self.fresh: dict[str, bytes] = {}
        self.stale: dict[str, bytes] = {}

    def _keeps_letters(self) -> bool:
        """Whether words of a-z reach the model as they are, so that it can be asked at once."""
        t = self.tokenizer
        text = t.normalizer.normalize_str(LETTERS) if t.normalizer else LETTERS
        parts = t.pre_tokenizer.pre_tokenize_str(text) if t.pre_tokenizer else []
        added = [str(a.content) for a in t.get_added_tokens_decoder().values()]
        return [p for p, _ in parts] == [LETTERS] and all(_SPECIAL in a for a in added)

    def _word_ends(self) -> np.ndarray | None:
        """Of each id whether it ends a piece of the pre-tokenizer, if the model marks that."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        return ends

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _encode_word(self, w: str) -> bytes:
        if self.plain and _LETTERS(w):
            return self._pack([t.id for t in self.tokenizer.model.tokenize(w)])
        return self._pack(self.tokenizer.encode(w, add_special_tokens=False).ids)

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters with one call: each has at least one end, so as many ends as words are one each."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.dtype)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids):
            return [self._encode_word(w) for w in words]
        size = np.dtype(self.dtype).itemsize
        packed, at = ids.tobytes(), [0, *(at * size).tolist()]
        return [packed[a:b] for a, b in zip(at, at[1:])]

    def _known(self, wanted: list[str]) -> list[bytes]:
        """The packed ids of these words, which the fresh generation then has."""
        if len(self.fresh) > CACHE_WORDS:
            self.fresh, self.stale = {}, self.fresh
        fresh, stale = self.fresh, self.stale
        found = list(map(fresh.get, wanted))
        together = []
        for w, ids in zip(wanted, found):
            if ids is None:
                ids = stale.get(w)
                if ids is None:
                    if self.ends is not None and w.isalpha() and not (self.plain and _LETTERS(w)):
                        together.append(w)
                        continue
                    ids = self._encode_word(w)
                fresh[w] = ids
        for i in range(0, len(together), TOGETHER):
            part = together[i : i + TOGETHER]
            fresh.update(zip(part, self._encode_letters(part)))
        return [fresh[w] if ids is None else ids for w, ids in zip(wanted, found)]

    def _looked_up(self, words: pa.Array) -> pa.Array:
        """Packed ids of each word."""
        seen = words.dictionary_encode()
        ids = self._known(seen.dictionary.to_numpy(zero_copy_only=False).tolist())
        return pa.array(ids, pa.binary()).take(seen.indices)

    def _ids(self, words: pa.Array) -> pa.Array:
        """Packed ids of each distinct word: those of the word proper, then those of the marks behind it."""
        core = pc.ascii_rtrim(words, _MARKS)
        cut = pc.and_(pc.not_equal(core, words), pc.match_substring_regex(core, _ENDS_IN_LETTER))
        cut = pc.and_not(cut, pc.match_substring(words, _SPECIAL))
        ids = self._looked_up(pc.if_else(cut, core, words))
        tails = pc.extract_regex(words.filter(cut), _TAIL).field("marks").dictionary_encode()
        marks = pa.array([b"", *self._known(tails.dictionary.to_pylist())], pa.binary())
        which = np.zeros(len(words), np.int32)
        which[cut.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy() + 1
        return pc.binary_join_element_wise(ids, marks.take(pa.array(which)), b"")

    def _stretches(self, text: bytes) -> Iterator[bytes]:
        """Cuts a very long text at white space."""
        start = 0
        while len(text) - start > 2 * STRETCH:
            found = _SPACE.search(text, start + STRETCH)
            if found is None:
                break
            yield text[start : found.start()]
            start = found.end()
        yield text[start:] if start else text

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if _SPECIAL.encode() not in text:  # names of special tokens count as they are spelled
                text = text.lower()
            if len(text) > 2 * STRETCH:
                yield from self._flush(held)
                held, size = [], 0
                yield b"".join(x for part in self._stretches(text) for x in self._flush([part]))
                continue
            held.append(text)
            size += len(text)
            if size > STRETCH:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[bytes]) -> Iterator[bytes]:
        if held:
            split = pc.ascii_split_whitespace(pa.array(held, pa.string()))
            seen = split.flatten().dictionary_encode()
            packed = self._ids(seen.dictionary).take(seen.indices)
            _, places, data = packed.buffers()
            at = np.frombuffer(places, np.int32)[split.offsets.to_numpy()].tolist()
            data = data.to_pybytes() if data else b""
            for a, b in zip(at, at[1:]):
                yield data[a:b]


def encoder(path: str) -> WordIds:
    """The worker's encoder of this file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def utf8(column) -> Iterator[bytes]:
    """Bytes of a string column of a record batch, one at a time; null is empty."""
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
