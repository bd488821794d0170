"""Token ids of whole texts, fast: words are encoded once and remembered."""
from __future__ import annotations

import os
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import compress, islice

import numpy as np

END_ID = 1
#: words remembered by one Python worker before it forgets all but the most frequent: bounds its memory, changes no result
REMEMBERED = 700_000
_SENTINEL = "<|endoftext|>"
#: a text with one of these is encoded whole: special tokens, and what Python but not the library takes for white space
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: marks that may end a word as a run; a run of them is one piece to the library, as no letter, digit, apostrophe or part of a special token is among them
_TAILS = ".,;:!?*#&$%()[]{}\"-+=/@^_~`\\"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _numbered() -> defaultdict[str, int]:
    """Entry number of each word met; a new word gets the next number when it is looked up."""
    index = defaultdict()
    index.default_factory = index.__len__
    return index


class WordCodec:
    """Ids of texts under the word-level BPE file at `path`, equal to encoding each whole text without special tokens.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its white-space-separated words in
    order. Each distinct word is encoded once by the tokenizers library and found again in a table. A text for which this does not
    hold is encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.sentinel = self.library.token_to_id(_SENTINEL)
        ends = np.zeros(self.library.get_vocab_size(), bool)
        ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.is_end = ends
        self.index = _numbered()
        self.forget()

    def forget(self) -> None:
        self.index.default_factory = None  # which holds the table itself
        self.index, self.known = _numbered(), 0  # words with numbers from `known` on wait to be encoded
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts = np.zeros(1 << 18, np.int32)
        self.sizes = np.zeros(1 << 18, np.int32)
        self.met = np.zeros(1 << 18, np.int64)

    def forget_rare(self) -> None:
        """Start anew with those words met most often, a third at most, that were met more than once."""
        n = len(self.index)
        often = np.sort(np.argsort(-self.met[:n], kind="stable")[:self.remembered // 3])
        often = often[self.met[often] > 1]
        words, met = np.array(list(self.index), object)[often].tolist(), self.met[often]
        ids, _ = self._gather(often)
        sizes = self.sizes[often]
        self.forget()
        self.index.update(zip(words, range(len(words))))
        self.known = len(words)
        self._store(np.arange(len(words)), ids, sizes)
        self.met[:len(words)] = met

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
        if len(self.index) > len(self.starts):
            more = max(len(self.starts), len(self.index))
            self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.sizes, self.met))
        self.flat[self.used:self.used + len(ids)] = ids
        ends = np.cumsum(sizes)
        self.starts[numbers] = self.used + ends - sizes
        self.sizes[numbers] = sizes
        self.used += len(ids)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after the other, and how many each has."""
        ids, lengths = [], []
        for k in range(0, len(words), 1_000):
            part = words[k:k + 1_000]
            got = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.is_end[got])
            if len(last) != len(part) or last[-1] != len(got) - 1:  # some word is more than one piece of text to the library
                got = np.array(self.library.encode_batch_fast([_SENTINEL.join(part) + _SENTINEL], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(got == self.sentinel)
                size = np.diff(marks, prepend=-1) - 1
                got = np.delete(got, marks)
            else:
                size = np.diff(last, prepend=-1)
            ids.append(got)
            lengths.append(size)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self) -> None:
        """Encode the words that wait."""
        index = self.index
        #: letters only and others, as the two fail the library's quick way at different rates
        simple, composed = (([], []), ([], [])), []
        while self.known < len(index):
            new = list(islice(reversed(index), len(index) - self.known))[::-1]
            first, self.known = self.known, len(index)
            letters = np.fromiter(map(str.isalpha, new), bool, len(new))
            words, numbers = simple[0]
            words += compress(new, letters)
            numbers.append(first + np.flatnonzero(letters))
            words, numbers = simple[1]
            own = []
            for place in np.flatnonzero(~letters).tolist():
                word = new[place]
                core = word.rstrip(_TAILS)
                if len(core) < len(word) and core.isalpha() and unicodedata.normalize("NFC", core).lower().isalpha():
                    composed.append((first + place, index[core], index[word[len(core):]]))  # letters and marks after them never join
                else:
                    words.append(word)
                    own.append(first + place)
            numbers.append(np.array(own, np.int64))
        for words, numbers in simple:
            if words:
                self._store(np.concatenate(numbers), *self._encode(words))
        if composed:
            number, core, tail = np.array(composed).T
            parts = np.stack([core, tail], axis=1)
            ids, _ = self._gather(parts.ravel())
            self._store(number, ids, self.sizes[parts].sum(axis=1))

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[entries]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total)
        places += np.repeat(self.starts[entries] - (ends - sizes), sizes)
        return self.flat[places], ends

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the end of each text among them."""
        if len(self.index) > self.remembered:
            self.forget_rare()
        words, counts, whole = [], [], {}
        for k, text in enumerate(texts):
            if text and any(mark in text for mark in _WHOLE):
                whole[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                counts.append(0)
            elif text:
                own = text.split()
                words += own
                counts.append(len(own))
            else:
                counts.append(0)
        entries = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._learn()
        self.met[:len(self.index)] += np.bincount(entries, minlength=len(self.index))
        flat, ends = self._gather(entries)
        bounds = np.concatenate([[0], ends])[np.cumsum(counts, dtype=np.int64)]
        if whole:
            pieces = np.split(flat, bounds[:-1])
            pieces = [whole.get(k, p) for k, p in enumerate(pieces)]
            flat, bounds = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        return flat.astype(np.uint32, copy=False), bounds

    def encode_documents(self, texts: list[str | None], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, with `end_id` after each text."""
        flat, bounds = self.encode(texts)
        return np.insert(flat, bounds, np.uint32(end_id)), bounds + np.arange(1, len(bounds) + 1)


@lru_cache(maxsize=1)
def codec(path: str, remembered: int = REMEMBERED) -> WordCodec:
    """The worker's codec for a vocabulary file."""
    return WordCodec(path, remembered)
