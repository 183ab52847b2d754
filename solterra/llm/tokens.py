"""Public tokenizers, applied by their distinct pre-tokens."""

from __future__ import annotations

import os
import re
from array import array

from .common import kept

#: Characters on which `re`, the tokenizer's own regular expressions and Unicode versions cannot differ.
PLAIN = re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2013-\\u201e]*")
#: The word pattern of the lower-casing BPE (a fixed value of that vocabulary), and the same for PLAIN texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# its branches begin with different characters, but for the last two; the most frequent one is tried first
PLAIN_WORDS = re.compile(r"[^\W\d_]+|[0-9]|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+")

#: Pre-tokens after which a worker begins a new generation of known ids; it keeps two, about 80 MB.
CACHED = 250_000


class _Learned(dict):
    """A cache that makes what it lacks. `trim`, called between texts, leaves what was used since the last full one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        self[key] = value = self.old.get(key) or self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


class Pieces:
    """Pre-tokens of texts and the ids of a pre-token, both exactly as the tokenizers library gives them.

    Added tokens inside a text are split off first, as the library does by default. Texts of plain
    characters are cut with `re`; all others with the library's own normalizer and pre-tokenizer.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens with options are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spec = json.load(open(path, encoding="utf-8"))
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.spaced = (pre[0].get("pattern") or {}).get("Regex") == WORD_PATTERN and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.vocab_size = self.tok.get_vocab_size()
        self.tokenize = self.tok.model.tokenize
        #: Ids are little-endian unsigned numbers of 16 bits if the vocabulary allows it, else of 32.
        self.dtype = "<u2" if self.vocab_size <= 1 << 16 else "<u4"
        self.code = {"<u2": "H", "<u4": "I"}[self.dtype]
        self.words = _Learned(lambda w: array(self.code, self.ids([w])[0]).tobytes())
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.byte = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    @staticmethod
    def load(path: str) -> "Pieces":
        return kept("pieces", path, lambda: Pieces(path))

    def _cut(self, part: str) -> list[str]:
        if self.spaced and PLAIN.fullmatch(part):
            return PLAIN_WORDS.findall(part.lower())
        if self.tok.normalizer is not None:
            part = self.tok.normalizer.normalize_str(part)
        if self.tok.pre_tokenizer is None:
            return [part] if part else []
        return [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]

    def of(self, text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
        """The pre-tokens, and (place, id) of the added tokens between them."""
        if not text:
            return [], []
        if self.split is None or not any(s in text for s in self.special):
            return self._cut(text), []
        words, found = [], []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                found.append((len(words), self.special[part]))
            elif part:
                words += self._cut(part)
        return words, found

    def ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each distinct pre-token, each as if it stood alone."""
        if not self.spaced:
            return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)] if words else []
        tokenize, byte = self.tokenize, self.byte
        return [[t.id for t in tokenize(w if w.isascii() and w.isprintable() else "".join([byte[b] for b in w.encode()]))] for w in words]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as numbers of dtype."""
        self.words.trim()
        words, found = self.of(text)
        if not found:
            return b"".join(map(self.words.__getitem__, words))
        parts, at = [], 0
        for place, i in found:
            parts += map(self.words.__getitem__, words[at:place])
            parts.append(array(self.code, [i]).tobytes())
            at = place
        return b"".join([*parts, *map(self.words.__getitem__, words[at:])])
