"""Token ids and counts that equal the library's, at a cost that whole corpora can bear.

The units of byte-pair encoding are the words that a vocabulary's pre-tokeniser cuts, so ids are
found word by word: from a cache, else by a merge core given the same vocabulary. Texts that hold
anything the words' rules would have to be re-derived for (special strings, letters beyond Latin,
rare control characters) go to the vocabulary's own library whole."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache


#: First come, first kept: frequent words come early. What is not kept is encoded again.
CACHE_CHUNKS = 400_000
CACHE_WORDS = 300_000
LONGEST_WORD = 48
#: Latin letters and numbers up to U+017E, lower case.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ž", "0-9²³¹¼½¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_UNEVEN = re.compile(r"\s ")
_RARE = bytes([*range(9), 11, 12, *range(14, 32), 127, *range(0xC6, 0x100)])
_RARE_PAIRS = re.compile(b"\xc2[\x80-\xa0\xad]|\xc5\xbf|\xc4\xb0|<\\|")


def is_plain(raw: bytes) -> bool:
    """Only tabs, line ends, printable ASCII and Latin letters and signs up to U+017E, without
    special strings."""
    return len(raw.translate(None, _RARE)) == len(raw) and not _RARE_PAIRS.search(raw)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _merge_core(path: str):
    """A merge core for a vocabulary whose words end in a marked letter: the mark is a byte 1
    behind it, which the core merges before all else."""
    import tiktoken

    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    of, ranks = _byte_of(), {}
    for token, n in vocab.items():
        end = token.endswith("</w>")
        body = token[:-4] if end else token
        if body and all(c in of for c in body):
            ranks[bytes(of[c] for c in body) + b"\x01" * end] = n
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe


class WordIds(dict):
    """Ids of word_bpe texts: calls give them as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library, self.core, self.words = load_tokenizer(path), _merge_core(path), {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        ids = array("I", self.core.encode_single_piece(word.encode() + b"\x01")).tobytes()
        if len(self.words) < CACHE_WORDS and len(word) <= LONGEST_WORD:
            self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join([self.words.get(w) or self.word(w) for w in _WORDS.findall(chunk.lower())])
        if len(self) < CACHE_CHUNKS and len(chunk) <= LONGEST_WORD:
            self[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not is_plain(text.encode("utf-8", "surrogatepass")):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class TokenCounts(dict):
    """Numbers of byte_bpe tokens of texts. What a single space separates is counted word by word;
    the words that the cache lacks are counted together, in one call a text."""

    def __init__(self, path: str, ranks_path: str) -> None:
        super().__init__()
        import public_tokenizers
        import tiktoken

        self.library = load_tokenizer(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not is_plain(text.encode("utf-8", "surrogatepass")):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if _UNEVEN.search(text):
            return len(self.encode(text))
        head, *rest = text.split(" ")
        counts = list(map(self.get, rest))
        missing = [w for w, n in zip(rest, counts) if n is None] if None in counts else []
        total = len(self.encode(head)) + sum(filter(None, counts))
        if not missing:
            return total
        if len(self) < CACHE_CHUNKS:
            for w in missing:
                n = len(self.encode(" " + w))
                total += n
                if len(w) <= LONGEST_WORD:
                    self[w] = n
            return total
        return total + len(self.encode(" " + " ".join(missing)))
