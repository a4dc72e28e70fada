"""The word-end BPE of a tokenizers .json file: normalise, split, merge; for counts and for ids."""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import KEPT

#: Chunks and pre-tokens that a worker remembers; later ones are worked out each time. The common ones come early.
CHUNKS, WORDS = 400_000, 500_000
#: New pre-tokens that the library encodes as one text.
JOIN = 2000
#: A worker is one of many on its machine: no threads of the library beside it.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Symbols of a pre-token beyond which a heap finds the next pair.
HEAP = 48


def byte_chars() -> list[str]:
    """The printable character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Splits and merges as the library does for this file. Special strings inside a text are one token, the library's default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.chars = byte_chars()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.library = Tokenizer.from_file(path)

    def raw(self, symbols: str) -> bytes:
        return bytes(self.bytes[c] for c in symbols)

    def normal(self, text: str) -> str:
        """NFC, one space for white space, lower case letter by letter (no final sigma)."""
        return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[str]:
        """Symbols of one pre-token: the leftmost pair of least rank, until none is left."""
        at = [self.chars[b] for b in word.encode()]
        at[-1] += self.end
        if len(at) > HEAP:
            return self.merge_long(at)
        rank, none = self.ranks.get, 1 << 30
        ranks = [rank(p, none) for p in zip(at, at[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            at[i : i + 2] = [at[i] + at[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((at[i], at[i + 1]), none)
            if i:
                ranks[i - 1] = rank((at[i - 1], at[i]), none)
        return at

    def merge_long(self, at: list[str]) -> list[str]:
        """The same rule over a linked list with a heap of (rank, place): n log n for a pre-token of n symbols."""
        rank, n = self.ranks.get, len(at)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((at[i], at[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if at[i] else n
            # an entry is stale where its place is gone or holds another pair by now
            if j >= n or rank((at[i], at[j])) != r:
                continue
            at[i], at[j] = at[i] + at[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((at[i], at[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((at[h], at[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in at if x]

    def words(self, chunk: str):
        """Pre-tokens of a text, or the id of a special string. Beyond Latin letters the library itself splits: its Unicode tables are older."""
        for i, part in enumerate(self.cut.split(chunk)):
            if i % 2:
                yield self.special[part]
            elif part and max(part) < "\u0250":
                yield from self.word.findall(self.normal(part))
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield self.raw(piece).decode()

    def whole_tokens(self) -> set[str]:
        """Proof by merging: the vocabulary strings that come out as one token when they are a pre-token."""
        found = set()
        for token in self.vocab:
            if not token.endswith(self.end) or len(token) == len(self.end):
                continue
            try:
                word = self.raw(token[: -len(self.end)]).decode()
            except UnicodeDecodeError:
                continue
            if self.word.fullmatch(word) and self.merge(word) == [token]:
                found.add(word)
        return found


class Counter(dict):
    """Tokens of a chunk without white space, remembered."""

    def __init__(self, bpe: WordBpe, whole: set[str]):
        self.bpe, self.whole, self.rest = bpe, whole, {}

    def __missing__(self, chunk: str) -> int:
        n = 0
        for w in self.bpe.words(chunk):
            if isinstance(w, int) or w in self.whole:
                n += 1
            else:
                if (k := self.rest.get(w)) is None:
                    k = len(self.bpe.merge(w))
                    if len(self.rest) < WORDS:
                        self.rest[w] = k
                n += k
        if len(self) < CHUNKS:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, chunks(text)))


class Ids(dict):
    """Ids of a chunk without white space as little-endian unsigned 32-bit bytes, remembered; the library encodes new pre-tokens."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.rest = bpe, {}
        self.mark = os.path.commonprefix(list(bpe.special))
        #: ids of tokens that end a pre-token
        self.last = np.zeros(max([*bpe.vocab.values(), *bpe.special.values()]) + 1, bool)
        self.last[[i for t, i in bpe.vocab.items() if t.endswith(bpe.end)]] = True

    def special(self, chunk: str) -> bool:
        """Whether a special string may be inside."""
        return self.mark in chunk if self.mark else bool(self.bpe.special and self.bpe.cut.search(chunk))

    def parts(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk of Latin letters; any other chunk, or one with a special string, whole."""
        if self.special(chunk):
            return [chunk]
        if chunk.isascii():
            low = chunk.lower()
        elif max(chunk) < "\u0250":
            low = self.bpe.normal(chunk)
        else:
            return [chunk]
        return [low] if low.isalpha() else self.bpe.word.findall(low)

    def alone(self, word: str) -> bool:
        """Whether a word is sure to be one pre-token that the library's normaliser leaves as it is."""
        return not self.special(word) and (word.isascii() or (word.isalpha() and max(word) < "\u0250"))

    def by_library(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Pre-tokens go to the library as one text, JOIN at a time, and are told apart by their last tokens."""
        out, rest = {}, []
        plain = [w for w in words if self.alone(w) or rest.append(w)]
        encode = self.bpe.library.encode_batch_fast
        for own in (plain[i : i + JOIN] for i in range(0, len(plain), JOIN)):
            found = np.array(encode([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[found]) + 1)).tolist()
            if len(ends) == len(own):
                raw = found.tobytes()
                out.update(zip(own, [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                rest += own
        return out | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, encode(rest, add_special_tokens=False), strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [chunks(t) for t in texts]
        new = {c: self.parts(c) for c in set(chain.from_iterable(split)).difference(self)}
        words = list(set(chain.from_iterable(new.values())).difference(self.rest))
        found = self.by_library(words)
        known = self.rest
        more = {c: b"".join([known[w] if w in known else found[w] for w in ws]) for c, ws in new.items()}
        over = list(islice(more, max(0, CHUNKS - len(self)), None))
        self.update(more)
        out = [b"".join(map(self.__getitem__, c)) for c in split]
        for c in over:
            del self[c]
        known.update(islice(found.items(), max(0, WORDS - len(known))))
        return out


#: White space to str.split() that the file's \s does not match.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def chunks(text: str) -> list[str]:
    """Runs without white space. No pre-token, special string or composed letter crosses white space, so runs stand alone."""
    return text.split() if not _NOT_SPACE.search(text) else [x for x in _SPACE.split(text) if x]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def counter(path: str, whole: frozenset) -> Counter:
    return Counter(load(path), whole)


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(load(path))


KEPT.extend([counter, ids])
