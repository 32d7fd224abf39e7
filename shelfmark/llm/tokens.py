"""Token ids of texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

WIDTH = 4  # bytes of an id, little-endian and unsigned
# a space before another blank: there words are not cut
_DOUBLE = re.compile(r" \s")
_STOPS = {".", ","}
_BLANK = re.compile(r"\s")
_SPACE = "\u0120"  # how the vocabulary writes a space
# words kept with their ids by each Python worker, about a quarter of a KB each
KEPT_WORDS = 500_000


class Encoder:
    """Texts to ids, each word looked up where it was seen before, and the others
    of a text encoded together.

    The vocabulary cuts a text before every space that a non-blank follows, so
    the ids of a text are those of its pieces between such places, and pieces
    repeat (tests hold the ids against those of whole texts). Strings of special
    tokens in a text are those tokens, or with ``special`` false ordinary text.
    """

    def __init__(self, path: str, special: bool = True, kept_words: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        self._known: dict[str, bytes] = {}
        self._most = kept_words
        self._stop = {s: self._ids(s) for s in _STOPS}
        words = self._tokenizer.get_vocab(with_added_tokens=True)
        self._opens = np.zeros(max(words.values()) + 1, bool)  # ids that begin with a space
        self._opens[[n for word, n in words.items() if word.startswith(_SPACE)]] = True

    def _ids(self, piece: str) -> bytes:
        ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space each. Those without blanks go to the
        vocabulary in one text; each begins where an id begins with a space."""
        if len(words) < 2 or any(map(_BLANK.search, words)):
            return [self._ids(" " + w) for w in words]
        text = " " + " ".join(words)
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, "<u4")
        at = (np.flatnonzero(self._opens[ids]) * WIDTH).tolist()
        if len(at) != len(words) or at[0]:
            return [self._ids(" " + w) for w in words]
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])]

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that follow a space and are not known, and keep them."""
        found, bare = {}, {}
        for word in words:
            ended = len(word) > 1 and word[-1] in _STOPS and word[-2].isalpha()
            bare[word] = word[:-1] if ended else word
        unknown = {w for w in bare.values() if w not in self._known}
        blank = {w for w in unknown if _BLANK.search(w)}
        for some in (list(unknown - blank), list(blank)):
            found.update(zip(some, self._new(some)))
        for word, own in bare.items():
            if own is not word:
                ids = found[own] if own in found else self._known[own]
                found[word] = ids + self._stop[word[-1]]
        for word, ids in found.items():
            if len(self._known) >= self._most:
                break
            if len(word) < 64:
                self._known[word] = ids
        return found

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        words = text.split(" ")
        if _DOUBLE.search(text):
            first, *rest = words
            words = [first]
            for word in rest:
                if word and not word[0].isspace():
                    words.append(word)
                else:
                    words[-1] += " " + word
        elif words[-1] == "" and len(words) > 1:
            words[-2:] = [words[-2] + " "]
        first, *words = words
        known = self._known.get
        found = [known(w) for w in words]
        if None in found:
            new = self._words({w for w, ids in zip(words, found) if ids is None})
            found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        return b"".join([self._ids(first), *found])  # no space before the first


@lru_cache(maxsize=2)
def encoder(
    path: str | None = None, special: bool = True, kept_words: int = KEPT_WORDS
) -> Encoder:
    """One encoder per vocabulary and Python worker; by default the 50k one of
    the public vocabularies."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), special, kept_words)
