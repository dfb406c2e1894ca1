"""Byte-level BPE with a segment tree of pair ranks.

A piece's bytes are the leaves' tokens; leaf i of the tree holds the rank of the
pair (token i, next live token), or none. The root names the leftmost pair of
the least rank. A merge gives the left token its new id, drops the right one and
updates the leaves of the live neighbours, one path each: O(log n) a merge.

Short pieces are encoded many at once, one tree per row of a matrix; long ones
one at a time. Results of pieces are kept per worker, as words repeat.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

NONE = np.int64(1) << 40  # no pair: larger than any rank
POSITION_BITS = 20
KEPT = 400_000  # pieces kept per worker; beyond it the store starts anew
SHORT = 64

# fixed value: the public pre-tokenizer pattern of this family of vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


class ByteBPE:
    """Encoder of one vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        odd = [s.get("type") for s in steps if s.get("type") != "ByteLevel" or s.get("add_prefix_space") or not s.get("use_regex", True)]
        if model.get("type", "BPE") != "BPE" or odd or not steps[0] or spec.get("normalizer") or model.get("byte_fallback"):
            raise ValueError(f"{path} is no byte-level BPE with the plain pre-tokenizer: {odd or model.get('type')}")
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.width = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank = made
        self.pairs = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self.split = regex.compile(PATTERN)
        self.kept: dict[str, list[int]] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where no merge makes one of them."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def encode_piece(self, data: bytes) -> list[int]:
        """One piece by one segment tree."""
        n = len(data)
        tokens = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        if n < 2:
            return tokens
        size = 1 << (n - 1).bit_length()
        pairs, width, by_rank = self.pairs, self.width, self.by_rank
        shift = max(POSITION_BITS, n.bit_length())
        none = int(NONE) << shift
        mask = (1 << shift) - 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pairs.get(tokens[i] * width + tokens[i + 1])
            if r is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        def pair(i: int) -> int:
            j = following[i]
            r = pairs.get(tokens[i] * width + tokens[j]) if j < n else None
            return none if r is None else r << shift | i

        while tree[1] < none:
            i = tree[1] & mask
            j = following[i]
            tokens[i] = int(by_rank[tree[1] >> shift])
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            tokens[j] = -1
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [t for t in tokens if t >= 0]

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Short pieces, one tree per row; all rows merge at once until none has a pair."""
        k, n = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, k)
        size = 1 << max(1, (n - 1).bit_length())
        inside = np.arange(size) < lengths[:, None]
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        tokens = np.full((k, size + 1), -1, np.int64)
        tokens[:, :size][inside] = self.byte_ids[flat]
        rows = np.arange(k)
        tree = np.full((k, 2 * size), NONE << POSITION_BITS, np.int64)
        has = np.arange(size) < (lengths - 1)[:, None]
        r, c = np.nonzero(has)
        tree[r, size + c] = self.rank_of(tokens[r, c], tokens[r, c + 1]) << POSITION_BITS | c
        tree[tree >= NONE << POSITION_BITS] = NONE << POSITION_BITS
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        following = np.tile(np.arange(1, size + 2), (k, 1))
        before = np.tile(np.arange(-1, size), (k, 1))
        none = NONE << POSITION_BITS

        def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = values
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            nxt = following[rows, at]
            ok = nxt < lengths[rows]
            rank = self.rank_of(tokens[rows, at], tokens[rows, np.where(ok, nxt, size)])
            return np.where(ok & (rank < NONE), rank << POSITION_BITS | at, none)

        live = rows[tree[:, 1] < none]
        while len(live):
            root = tree[live, 1]
            i = root & ((1 << POSITION_BITS) - 1)
            j = following[live, i]
            tokens[live, i] = self.by_rank[root >> POSITION_BITS]
            after = following[live, j]
            following[live, i] = after
            before[live, after] = i
            tokens[live, j] = -1
            put(live, j, np.full(len(live), none))
            put(live, i, pair(live, i))
            prev = before[live, i]
            has = prev >= 0
            if has.any():
                put(live[has], prev[has], pair(live[has], prev[has]))
            live = live[tree[live, 1] < none]
        kept = tokens[:, :size] >= 0
        return [t.tolist() for t in np.split(tokens[:, :size][kept], np.cumsum(kept.sum(axis=1))[:-1])]

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces not met yet, short ones by length class."""
        classes: dict[int, list[str]] = {}
        for p in pieces:
            n = len(p.encode("utf-8", "surrogatepass"))
            if n > SHORT:
                self.kept[p] = self.encode_piece(p.encode("utf-8", "surrogatepass"))
            else:
                classes.setdefault(max(2, (n - 1).bit_length()), []).append(p)
        for ps in classes.values():
            for lo in range(0, len(ps), 20_000):
                part = ps[lo : lo + 20_000]
                self.kept.update(zip(part, self.encode_many([p.encode("utf-8", "surrogatepass") for p in part]), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = {p for ps in cut for p in ps}.difference(self.kept)
        if new:
            self._learn(new)
        kept = self.kept
        out = []
        for ps in cut:
            ids: list[int] = []
            for p in ps:
                ids += kept[p]
            out.append(ids)
        return out

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        return list(map(len, self.encode_batch(texts)))


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, loaded once per worker."""
    return ByteBPE(path)
