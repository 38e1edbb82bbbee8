"""Byte-level BPE ids of whole texts, made by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from unicodedata import category

import numpy as np

#: Texts of these characters only are split here, by the vocabulary's splitting rule; any other text
#: the library splits itself, so that differences between Unicode versions can't show.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f]*")
#: Distinct words whose ids a worker remembers at once, about 200 MB of memory.
WORDS_KEPT = 900_000


def _splitter():
    """Contractions, and runs of letters, numbers or other marks with the space before them, for
    texts of PLAIN characters."""
    plain = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250))]
    letters, numbers, space = ("".join(map(re.escape, x)) for x in ([c for c in plain if category(c)[0] == "L"], [c for c in plain if category(c)[0] == "N"], [c for c in plain if c.isspace()]))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else one
    from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_by_the_known_rule(path: str) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, whose splitting rule is the one above."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, split = rules["model"], rules.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    return (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in odd)
        and not any(rules.get(k) for k in ("normalizer", "truncation", "padding"))
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
    )


class _Words(dict):
    """The ids of words as bytes, made by ``make`` when a word is first met; all are forgotten when
    there are more than ``most``."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.make(word)
        return ids


class Encoder:
    """Ids of texts as the library's ``encode(text, add_special_tokens=False)`` gives them.

    Byte-level BPE merges never cross the borders that the splitting pattern draws, so each
    distinct word goes through the library's model once and is remembered. Texts of other
    characters, texts that hold an added token's string, and all texts where the tokenizer file has
    another rule go through the library whole. ``width`` is the numpy type that holds every id.
    """

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known_rule = splits_by_the_known_rule(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.has_added = re.compile("|".join(added)).search if added else lambda text: None
        self.split, self.letters = _splitter(), _byte_letters()
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        merge, kind = self.library.model.tokenize, "H" if self.width.itemsize == 2 else "I"
        self.known = _Words(lambda word: array(kind, [t.id for t in merge(self._lettered(word))]).tobytes(), words_kept)

    def _lettered(self, word: str) -> str:
        """A word as byte-level vocabularies write its bytes."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.letters[32])
        return "".join(map(self.letters.__getitem__, word.encode()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """One little-endian id array, of type ``width``, for each text."""
        plain, added = PLAIN.fullmatch, self.has_added
        ids_of, split = self.known.__getitem__, self.split
        out = [b"".join(map(ids_of, split(t))) if self.known_rule and plain(t) and not added(t) else None for t in texts]
        if odd := [i for i, x in enumerate(out) if x is None]:
            for i, e in zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(e.ids, self.width).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, words_kept: int = WORDS_KEPT) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return Encoder(path, words_kept)


def spans_of(texts: list[str], most: int = 1_000_000):
    """Slices of a batch that hold up to ``most`` characters, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
