"""Token ids of whole texts by a public tokenizer, through a bounded cache of words.

The word tokenizer used here drops white space and never joins pieces across it, so the ids of a text are those of its
blank-separated words in a row. Arrow splits texts at ASCII blanks and numbers the distinct words; only words that the cache
lacks reach the tokenizer, and numpy puts the ids of all words together. Other blanks stay inside a word, where the tokenizer
itself drops them.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

DEFAULT = "word_bpe_49k.json"
#: Words a cache holds before it starts anew.
MOST = 250_000
_BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of text that are split at once, and from which on a single text is cut at blanks.
AT_ONCE = 1 << 20


class WordIds:
    """The tokenizer's own ids of texts (add_special_tokens=False), as little-endian unsigned 32-bit bytes.

    Only for tokenizers whose pre-tokenizer drops white space and that lower-case ASCII letters (checked on creation).
    special_as_text: the strings of special tokens, such as <|endoftext|>, are ordinary text; by default they are one id, as
    `encode` gives them.
    """

    def __init__(self, name: str = DEFAULT, most: int = MOST, special_as_text: bool = False):
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.tok.encode_special_tokens = special_as_text
        self.most = most
        if self._plain("a b  c") != [i for w in "abc" for i in self._plain(w)]:
            raise ValueError(f"{name} keeps white space; words can't be encoded one by one")
        if self._plain("Ab") != self._plain("ab"):
            raise ValueError(f"{name} tells capitals apart; words can't be looked up in lower case")
        self.clear()

    def _plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        """Forget all words. A word's number is its place in `begin` and `count`, which say where its ids are in `ids`."""
        self.cache: dict[str, int] = {"": 0}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Cache new words: some are encoded as one text, and offsets tell whose an id is."""
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4"), np.cumsum([len(x) + 1 for x in part])
            at = np.searchsorted(ends, np.fromiter((o[0] for o in e.offsets), np.int64, len(ids)), "right")
            cut = np.searchsorted(at, np.arange(len(part) + 1))
            n, m = len(self.cache), len(self.cache) + len(part)
            while m > len(self.begin):
                self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin[n:m], self.count[n:m] = self.used + cut[:-1], np.diff(cut)
            self.used += len(ids)
            self.cache.update(zip(part, range(n, m), strict=True))

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.cache]
        if new:
            if len(self.cache) + len(new) > self.most:
                self.clear()
                new = [w for w in words if w]
            self._learn(new)
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def _some(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():  # these strings are looked for before anything else is done to a text
            plain = [self._split(x, y) for x, y in zip(texts, special.to_pylist(), strict=True)]
            split = pa.array(plain, pa.list_(pa.string()))
        else:
            split = pc.ascii_split_whitespace(_parted(texts))
        flat = split.flatten().dictionary_encode()
        word = self._numbers(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        count = self.count[word]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        ids = self.ids[np.repeat(self.begin[word] - upto[:-1], count) + np.arange(upto[-1])]
        offsets = split.offsets.to_numpy()
        cut = upto[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    @staticmethod
    def _split(text: pa.StringScalar, as_it_is: bool) -> list[str]:
        x = pa.array([text.as_py()], pa.string())
        return pc.ascii_split_whitespace(x if as_it_is else _parted(x))[0].as_py()

    def many(self, texts: pa.Array | list[str | None], at_once: int = AT_ONCE) -> list[np.ndarray]:
        """The ids of each text (null: none); texts are looked up together, about `at_once` bytes at a time."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            n, j = int(size[i]), i + 1
            if n > at_once:
                out.append(np.concatenate(self._some(pa.array(_stretches(texts[i].as_py().encode(), at_once), pa.string()))))
            else:
                while j < len(texts) and n + size[j] <= at_once:
                    n, j = n + int(size[j]), j + 1
                out += self._some(texts.slice(i, j - i))
            i = j
        return out


def _parted(texts: pa.Array) -> pa.Array:
    """Texts in lower case (ASCII) with a blank between an ASCII letter and other ASCII after it, where the pre-tokenizer parts
    them anyway: so there are fewer distinct words."""
    return pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-/0-9:-@\[-`{-~])", r"\1 \2")


def _stretches(raw: bytes, at_once: int) -> list[str]:
    """A long text in parts that end at blanks."""
    parts, at = [], 0
    while at < len(raw):
        end = at + at_once
        while end < len(raw) and raw[end] not in _BLANK:
            end += 1
        parts.append(raw[at:end].decode())
        at = end
    return parts


@functools.lru_cache(maxsize=1)
def word_ids(name: str = DEFAULT) -> WordIds:
    """One tokenizer for all tasks that a Python worker runs. A task clears its words at its end, as idle workers keep memory."""
    return WordIds(name)
