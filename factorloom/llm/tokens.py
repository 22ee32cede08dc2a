"""Token ids by a public tokenizer, with a cache of words.

The tokenizer splits at white space before anything else, so the ids of a text are those of its words
one after another. A batch of texts is split at ASCII white space by Arrow, each distinct word is
encoded once, and the ids are put together with array operations. The words that are remembered are
bounded in number and in bytes, and are forgotten soon after the last task that needed them.
"""

from __future__ import annotations

import os
import threading
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from factorloom.llm.common import give_back, row_groups

#: So many words are remembered, and no more when they have so many bytes; the first are mostly frequent ones.
MAX_CACHED_WORDS = 100_000
MAX_CACHED_BYTES = 4_000_000
#: An encoder that no task has used for so long is given up.
IDLE_SECONDS = 5.0
#: Bytes of text that are split at once.
SLICE_BYTES = 2_000_000
#: Words that are encoded as one text, and texts that are encoded in one call.
WORDS_A_CALL = 256
CALLS_AT_ONCE = 16
# Fixed value: the pattern by which the vocabulary's file splits normalised text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

MARKS = ".,;:!?*$%&#"
LETTERS_AND_MARKS = r"^[a-z]+[.,;:!?*$%&#]*$"
_PIECES = regex.compile(PIECES)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coded:
    """Words and their ids, one after another."""

    def __init__(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.ids, self.sizes = words, ids, sizes

    def first(self, n: int) -> Coded:
        return Coded(self.words.slice(0, n), self.ids[: self.sizes[:n].sum()], self.sizes[:n])

    def plus(self, other: Coded) -> Coded:
        return Coded(pa.concat_arrays([self.words, other.words]), np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))


def gather(coded: Coded, which: np.ndarray) -> np.ndarray:
    """The ids of the chosen words, one after another."""
    sizes = coded.sizes[which]
    ends = np.cumsum(sizes)
    first = (np.cumsum(coded.sizes) - coded.sizes)[which] - (ends - sizes)
    return coded.ids[np.repeat(first, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Whole texts to ids; special tokens are not added."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_piece = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends_piece[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Coded(pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _of_letters(self, words: pa.Array) -> Coded:
        """Distinct words of a to z, which are one piece each and as they are after normalisation."""
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in words.to_pylist()]
        return Coded(words, np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _of_any(self, words: pa.Array) -> Coded:
        """Many words in a call: the ids of a word are told apart by how many pieces it splits into.

        Where the pieces don't add up, as with characters that normalisation changes, the words of the
        call are encoded one by one.
        """
        plain = words.to_pylist()
        pieces = pc.count_substring_regex(pc.ascii_lower(words), PIECES).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)):  # Arrow counts these by bytes
            pieces[i] = len(_PIECES.findall(unicodedata.normalize("NFC", plain[i]).lower()))
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, found in self._together(plain):
            got, count = np.array(found.ids, np.uint32), pieces[i : i + WORDS_A_CALL]
            ends = np.flatnonzero(self.ends_piece[got]) + 1
            if len(ends) == count.sum() and count.all() and (not len(got) or ends[-1] == len(got)):
                size = np.diff(ends[np.cumsum(count) - 1], prepend=0)
            else:
                each = self.tokenizer.encode_batch_fast(plain[i : i + WORDS_A_CALL], add_special_tokens=False)
                got = np.array([x for e in each for x in e.ids], np.uint32)
                size = np.array([len(e.ids) for e in each], np.int64)
            ids.append(got)
            sizes.append(size)
        return Coded(words, np.concatenate(ids), np.concatenate(sizes))

    def _together(self, plain: list[str]) -> Iterator[tuple[int, object]]:
        """Some words at a time with the place of the first; few encodings are held at once."""
        step = WORDS_A_CALL * CALLS_AT_ONCE
        for first in range(0, len(plain), step):
            calls = range(first, min(first + step, len(plain)), WORDS_A_CALL)
            yield from zip(calls, self.tokenizer.encode_batch_fast(["\n".join(plain[i : i + WORDS_A_CALL]) for i in calls], add_special_tokens=False), strict=True)

    def _encode_words(self, words: pa.Array) -> Coded:
        """Letters with marks after them are two pieces, which many words share; others go whole."""
        low = pc.ascii_lower(words)
        marked = pc.match_substring_regex(low, LETTERS_AND_MARKS)
        whole, low = words.filter(pc.invert(marked)), low.filter(marked)
        letters = pc.ascii_rtrim(low, characters=MARKS)
        marks = pc.ascii_ltrim(low, characters="abcdefghijklmnopqrstuvwxyz")
        letters, marks = letters.dictionary_encode(), marks.dictionary_encode()
        some = pc.greater(pc.binary_length(marks.dictionary), 0)
        parts = self._of_letters(letters.dictionary).plus(self._of_any(marks.dictionary.filter(some))).plus(self._of_any(whole))
        parts = parts.plus(Coded(pa.array([""], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)))
        n, m = len(letters.dictionary), some.true_count
        mark_at = np.full(len(some), len(parts.sizes) - 1)
        mark_at[some.to_numpy(zero_copy_only=False)] = n + np.arange(m)
        which = np.full((len(words), 2), len(parts.sizes) - 1)
        is_marked = marked.to_numpy(zero_copy_only=False)
        which[is_marked, 0] = letters.indices.to_numpy(zero_copy_only=False)
        which[is_marked, 1] = mark_at[marks.indices.to_numpy(zero_copy_only=False)]
        which[~is_marked, 0] = n + m + np.arange(len(whole))
        return Coded(words, gather(parts, which.ravel()), parts.sizes[which].sum(1))

    def _with(self, words: pa.Array) -> tuple[Coded, np.ndarray]:
        """The known words and these, and where these are among them."""
        at = pc.index_in(words, value_set=self.known.words)
        if not at.null_count:
            return self.known, at.to_numpy(zero_copy_only=False)
        new = self._encode_words(words.filter(pc.is_null(at)))
        where = at.to_numpy(zero_copy_only=False).copy()
        where[np.isnan(where)] = len(self.known.words) + np.arange(len(new.words))
        coded = self.known.plus(new)
        if self.known.words.nbytes < MAX_CACHED_BYTES and len(self.known.words) < MAX_CACHED_WORDS:
            self.known = coded.first(MAX_CACHED_WORDS)
        return coded, where.astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has. Null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten()
        words = words.filter(pc.greater(pc.binary_length(words), 0)) if (blank := pc.equal(pc.binary_length(words), 0)).true_count else words
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(per_text)])
        if blank.true_count:
            seen = np.concatenate([[0], np.cumsum(~blank.to_numpy(zero_copy_only=False))])
            ends = seen[ends]
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        words = words.dictionary_encode()
        coded, at = self._with(words.dictionary)
        which = at[words.indices.to_numpy(zero_copy_only=False)]
        before = np.concatenate([[0], np.cumsum(coded.sizes[which])])
        return gather(coded, which), before[ends[1:]] - before[ends[:-1]]


_held: dict[str, WordEncoder] = {}
_idle: list[threading.Timer] = []


def _forget() -> None:
    _held.clear()
    give_back()


@contextmanager
def encoder(path: str) -> Iterator[WordEncoder]:
    """The process's encoder for a vocabulary.

    Python workers outlive tasks: the next task finds the encoder with the words it has met, and if
    none comes for some seconds, what it held goes back to the system.
    """
    while _idle:
        _idle.pop().cancel()
    coder = _held[path] = _held.get(path) or WordEncoder(path)
    try:
        yield coder
    finally:
        _idle.append(threading.Timer(IDLE_SECONDS, _forget))
        _idle[-1].daemon = True
        _idle[-1].start()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0)
    return row_groups(sizes.to_numpy(zero_copy_only=False).astype(np.int64), most)
