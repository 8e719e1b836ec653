"""Token counts of a byte-level BPE vocabulary, without making a single token id.

A text is cut into pre-tokens. Each is a linked list of byte symbols with a heap of adjacent pairs:
the pair of the lowest merge rank is popped again and again and its two symbols joined, until no
pair has a rank. The count is the initial symbols minus the merges.

Defined results: a null text counts as empty (0 tokens); special-token strings inside a text are one
token each, as the tokenizer library takes them by default; texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import map_text

#: Fixed pattern of byte-level BPE pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers, at most; beyond it starts anew (a cache, results do not depend on it).
CACHE_PIECES = 500_000

_SPACE_RUN = regex.compile(r" (?=[\s\x1c-\x1f]|$)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens with the merge table of one vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) \
                or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"{vocabulary}: not a plain byte-level BPE vocabulary")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{vocabulary}: added tokens with strip, word or normalising rules are not supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) \
            if self.specials else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        symbols: dict[str, int] = {s: i for i, s in enumerate(byte_symbols())}
        self.rank: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            made = symbols.setdefault(a + b, len(symbols))
            self.rank.setdefault(symbols[a] << 32 | symbols[b], (r, made))
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merges(self, word: bytes) -> int:
        """Merges that a pre-token undergoes."""
        n = len(word)
        rank = self.rank
        symbol = list(word)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbol[i] << 32 | symbol[i + 1]
            if (found := rank.get(pair)) is not None:
                heap.append((found[0], i, pair))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            # the pair may be gone: its left symbol joined to another, or either symbol grown
            if symbol[i] < 0 or j >= n or symbol[i] << 32 | symbol[j] != pair:
                continue
            made = symbol[i] = rank[pair][1]
            symbol[j] = -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                p = made << 32 | symbol[k]
                if (found := rank.get(p)) is not None:
                    heapq.heappush(heap, (found[0], i, p))
            if (h := before[i]) >= 0:
                p = symbol[h] << 32 | made
                if (found := rank.get(p)) is not None:
                    heapq.heappush(heap, (found[0], h, p))
        return done

    def word(self, pre_token: str) -> int:
        """Tokens of one pre-token."""
        if (found := self.words.get(pre_token)) is None:
            raw = pre_token.encode("utf-8")
            found = len(raw) - self.merges(raw)
            if len(pre_token) <= 64:
                if len(self.words) >= CACHE_PIECES:
                    self.words.clear()
                self.words[pre_token] = found
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without special-token strings."""
        if _SPACE_RUN.search(text):
            return sum(map(self.word, self.pattern.findall(text)))
        # every space is followed by a word's first character, where a pre-token always begins:
        # the space-led pieces can be counted one by one, and common ones are remembered
        head, *pieces = text.split(" ")
        known = self.pieces
        try:
            total = sum(map(known.__getitem__, pieces))
        except KeyError:
            total = 0
            for p in pieces:
                n = known.get(p)
                if n is None:
                    n = sum(map(self.word, self.pattern.findall(" " + p)))
                    if len(p) <= 64:
                        if len(known) >= CACHE_PIECES:
                            known.clear()
                        known[p] = n
                total += n
        return total + sum(map(self.word, self.pattern.findall(head)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not any(s in text for s in self.specials):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> Counter:
    """One counter per worker and vocabulary; its memory of pieces outlives a batch."""
    return Counter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text", *,
                 limit: int = 1024) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    ``vocabulary``: path of the vocabulary file on every worker.
    """

    def fn(texts):
        count = counter(vocabulary).count
        n = [count(b.decode("utf-8", "replace")) if b else 0 for b in texts]
        return [[len(b or b"") for b in texts], n, [x > limit for x in n]]

    return map_text(docs, keep, text_col, "n_bytes long, n_tokens long, over_limit boolean", fn)
