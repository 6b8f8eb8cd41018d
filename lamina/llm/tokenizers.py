"""Exact byte-level BPE over a public rank file, in three forms.

* ``TokenCounter`` counts the tokens of a text without building identifiers: a matching automaton
  over the vocabulary proposes the tokens that end at each byte, and the compatibility check of
  token pairs keeps the one proposal that the merge order would have left there. Linear in the text.
* ``TokenEncoder`` gives the identifiers: whole pre-tokens of the vocabulary are resolved through a
  minimal perfect hash, the rest through merges taken from a heap over linked bytes.
* ``Vocabulary`` is the rank file both read. Its path is a parameter; it is read in the workers and
  never copied.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache
from itertools import chain

import numpy as np

#: fixed value: the pattern that splits a text before the merges of the 50k rank files
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Memoised pre-tokens of a worker; a full memo is emptied, which costs time and nothing else.
MEMO_LIMIT = 400_000


def default_vocabulary() -> str:
    """Path of ``byte_bpe_50k``; the environment variable LAMINA_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("LAMINA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


class Vocabulary:
    """Rank file: token bytes by id, and for each token the pair it was merged from."""

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.pairs: dict[tuple[int, int], int] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        ranks = self.ranks
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self.compatible(left, right):
                    self.pairs[(left, right)] = rank
                    self.split[rank] = (left, right)
                    break

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The parts of a token at its left (0) or right (1) end: part, rank that makes it, rank that takes it up.

        Bytes are there from the start (-1), the token itself stays.
        """
        held = self.spines[side].get(token)
        if held is None:
            part, ends = token, 1 << 60
            held = []
            while self.split[part] != (part, part):
                held.append((part, part, ends))
                part, ends = self.split[part][side], part
            held.append((part, -1, ends))
            self.spines[side][token] = held
        return held

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` beside each other.

        Until a merge crosses the seam both sides are built as they are alone. A merge of a part at the
        end of ``a`` with a part at the start of ``b`` crosses it if both parts are there at one time and
        it comes before the merges that take them up; among equal ranks the one further left comes first.
        """
        pairs = self.pairs
        for x, made_x, ends_x in self.spine(a, 1):
            for y, made_y, ends_y in self.spine(b, 0):
                if made_y < ends_x and made_x <= ends_y:
                    rank = pairs.get((x, y))
                    if rank is not None and rank < ends_x and rank <= ends_y:
                        return False
        return True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


class TokenCounter:
    """Number of tokens of a text, by automaton and pair check."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        self.vocabulary = v = vocabulary(path)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in v.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.fits = lru_cache(maxsize=1 << 17)(v.compatible)
        self.memo: dict[str, int] = {}
        self.split = splitter(SPLIT_PATTERN)

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token, in one pass over its bytes.

        ``last[i]`` is the last token of the encoding of the first ``i`` bytes, which is the one
        token ending there that is compatible with ``last`` at its own start.
        """
        data = piece.encode("utf-8", "replace")
        if data in self.vocabulary.ranks:
            return 1
        tokens, fits = self.vocabulary.tokens, self.fits
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            i = end + 1
            if last[i] < 0:
                start = i - len(tokens[rank])
                if start == 0 or fits(last[start], rank):
                    last[i], count[i] = rank, count[start] + 1
        return count[-1]

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; null and empty have none."""
        if not text:
            return 0
        memo, total = self.memo, 0
        pieces = self.split(text)
        try:
            return sum([memo[p] for p in pieces])
        except KeyError:
            pass
        for p in pieces:
            n = memo.get(p)
            if n is None:
                if len(memo) >= MEMO_LIMIT:
                    memo.clear()
                n = memo[p] = self.piece(p)
            total += n
        return total


class PerfectHash:
    """Minimal perfect hash of byte strings: one slot a key, a displacement for each bucket of keys."""

    def __init__(self, keys: list[bytes]) -> None:
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.size, self.buckets = len(keys), max(1, len(keys) // 2)
        hashes = np.fromiter((self.digest(k) for k in keys), np.uint64, len(keys))
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two keys share a hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(self.size, -1, np.int64)
        for size in range(int(sizes.max()), 1, -1):
            waiting, d = np.flatnonzero(sizes == size), 0
            while len(waiting):
                d += 1
                members = order[starts[waiting][:, None] + np.arange(size)]
                at = self._place(hashes[members], np.int64(d))
                free = (self.slot_of[at] < 0).all(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) != 0).all(axis=1)
                waiting_at = np.where(free[:, None], at, -1)
                first = np.zeros(at.shape, bool)  # a slot two buckets want goes to the earlier one
                slots, where = np.unique(waiting_at, return_index=True)
                first.flat[where[slots >= 0]] = True
                won = first.all(axis=1)
                self.shift[waiting[won]] = d
                self.slot_of[at[won]] = members[won]
                waiting = waiting[~won]
        free = iter(np.flatnonzero(self.slot_of < 0))
        for b in np.flatnonzero(sizes == 1):
            at = next(free)
            self.shift[b], self.slot_of[at] = -1 - at, order[starts[b]]

    def _place(self, hashes: np.ndarray, shift) -> np.ndarray:
        mixed = (hashes ^ (np.uint64(0x9E3779B97F4A7C15) * np.asarray(shift).astype(np.uint64))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(29)) % np.uint64(self.size)).astype(np.int64)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The only key each piece can be, by its place among the keys; the caller compares the bytes."""
        hashes = np.fromiter((self.digest(p) for p in pieces), np.uint64, len(pieces))
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(shift < 0, -1 - shift, self._place(hashes, np.maximum(shift, 0)))
        return self.slot_of[at]


class TokenEncoder:
    """Identifiers of texts: perfect hash for whole pre-tokens, heap of merges for the others."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.keys = list(self.vocabulary.ranks)
        self.rank_of = np.fromiter((self.vocabulary.ranks[k] for k in self.keys), np.int64, len(self.keys))
        self.table = PerfectHash(self.keys)
        self.memo: dict[str, list[int]] = {}
        self.split = splitter(SPLIT_PATTERN)

    def merge(self, data: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost among equals, over a linked list of parts."""
        ranks, n = self.vocabulary.ranks, len(data)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                later = ranks.get(data[i : end[stop]])
                if later is not None:
                    heapq.heappush(heap, (later, i, end[stop]))
            if before[i] >= 0:
                earlier = ranks.get(data[before[i] : stop])
                if earlier is not None:
                    heapq.heappush(heap, (earlier, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Put pieces unknown so far into the memo, the hash table first."""
        if len(self.memo) + len(pieces) > MEMO_LIMIT:
            self.memo.clear()
        raw = [p.encode("utf-8", "replace") for p in pieces]
        for p, data, k in zip(pieces, raw, self.table.find(raw)):
            self.memo[p] = [int(self.rank_of[k])] if self.keys[k] == data else self.merge(data)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Identifiers of each text; null and empty give none."""
        out = []
        for text in texts:
            pieces = self.split(text) if text else []
            try:
                out.append(list(chain.from_iterable([self.memo[p] for p in pieces])))
            except KeyError:
                self.learn([p for p in dict.fromkeys(pieces) if p not in self.memo])
                if any(p not in self.memo for p in pieces):  # the memo was emptied
                    self.learn(list(dict.fromkeys(pieces)))
                out.append(list(chain.from_iterable([self.memo[p] for p in pieces])))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> TokenEncoder:
    return TokenEncoder(path)
