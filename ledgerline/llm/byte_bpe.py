"""Byte-level BPE: encode texts to token ids and ids back to bytes.

Each match of the split pattern is merged on its own.  A segment tree over its byte positions
holds ``rank * size + position`` of the pair that starts there, so the root is the leftmost pair
of least rank; a merge updates the three leaves it touches in logarithmic time.  Short words go
through their trees in step, a numpy row each.  Results are kept in a bounded memo, as words recur.

A single space between two non-space characters always starts a new match, so the memo's keys
are the pieces between such spaces.

Defined cases: null and empty text has no tokens; null ids stay; a single match of any length
takes n log n time; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, forgets, map_rows, text_only

#: Pieces the memo holds, the longest kept there (and merged in step with others), and how many
#: characters of text are split at once.
MEMO, LONGEST, BATCH = 600_000, 64, 1_000_000


def merge(word: bytes, pairs: dict[tuple[int, int], int], single: list[int]) -> list[int]:
    """Token ids of one match.  pairs: rank of a pair of ids, which is the id it merges to; single: id of each byte."""
    n = len(word)
    ids = [single[b] for b in word]
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none = sys.maxsize
    tree = [none] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        p = get((ids[i], ids[i + 1]))
        if p is not None:
            tree[size + i] = p * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        i = tree[1] % size
        j = after[i]
        ids[i] = pairs[ids[i], ids[j]]
        ids[j] = -1
        k = after[i] = after[j]
        changed = [(j, none)]
        if k < n:
            before[k] = i
            p = get((ids[i], ids[k]))
            changed.append((i, p * size + i if p is not None else none))
        else:
            changed.append((i, none))
        h = before[i]
        if h >= 0:
            p = get((ids[h], ids[i]))
            changed.append((h, p * size + h if p is not None else none))
        for leaf, value in changed:
            leaf += size
            if tree[leaf] != value:
                tree[leaf] = value
                while leaf > 1:
                    other = tree[leaf ^ 1]
                    if other < value:
                        value = other
                    leaf >>= 1
                    if tree[leaf] == value:
                        break
                    tree[leaf] = value
    return [x for x in ids if x >= 0]


class PairTable:
    """Rank of a pair of ids, looked up for whole arrays: hash tables, each for what collides in the one before."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 16 | b for a, b in pairs], np.uint32)
        ranks = np.array(list(pairs.values()), np.int32)
        self.tables = []
        multiplier = 0x9E3779B1
        while len(keys):
            bits = max(int(len(keys) * 8).bit_length(), 4)
            slot = self._slots(keys, multiplier, bits)
            slot, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, NO_RANK, np.int32)
            held[slot], rank[slot] = keys[first], ranks[first]
            self.tables.append((multiplier, bits, held, rank))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)
            multiplier = (multiplier * 0x85EBCA6B | 1) & 0xFFFFFFFF

    @staticmethod
    def _slots(keys: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
        return (keys * np.uint32(multiplier)) >> np.uint32(32 - bits)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        out = np.full(keys.shape, NO_RANK, np.int32)
        for multiplier, bits, held, rank in self.tables:
            slot = self._slots(keys, multiplier, bits)
            out = np.where(held[slot] == keys, rank[slot], out)
        return out


#: An id that is in no pair, for places beyond a word's end; and the rank of what isn't a pair.
NO_ID, NO_RANK = 0xFFFF, 1 << 24
NONE = (1 << 31) - 1


def merge_many(words: list[bytes], table: PairTable, single: np.ndarray) -> list[bytes]:
    """``merge`` for many words in step: a segment tree for each, in one array; ids as bytes."""
    size = max(2, 1 << (max(map(len, words)) - 1).bit_length())
    count = len(words)
    raw = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(count, size)
    lengths = np.fromiter(map(len, words), np.int64, count)
    ids = np.full((count, size + 1), NO_ID, np.int32)
    ids[:, :size] = np.where(np.arange(size) < lengths[:, None], single[raw], NO_ID)
    after = np.tile(np.arange(1, size + 2, dtype=np.int16), (count, 1))
    before = np.tile(np.arange(-1, size, dtype=np.int16), (count, 1))
    tree = np.full((count, 2 * size), NONE, np.int32)

    def leaves(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < NO_RANK, rank * size + at, NONE).astype(np.int32)

    tree[:, size:] = leaves(table.get(ids[:, :size], ids[:, 1:]), np.arange(size))
    half = size >> 1
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half >>= 1
    act = np.flatnonzero(tree[:, 1] < NONE)
    while len(act):
        root = tree[act, 1]
        i = root & (size - 1)
        j = after[act, i]
        k = np.minimum(after[act, j], size)
        ids[act, i] = root // size
        ids[act, j] = NO_ID
        after[act, i] = k
        before[act, k] = i
        h = before[act, i]
        here = ids[act, i]
        places = [(j, np.full(len(act), NONE, np.int32)), (i, leaves(table.get(here, ids[act, k]), i))]
        lead = np.where(h >= 0, h, j)
        places.append((lead, np.where(h >= 0, leaves(table.get(ids[act, lead], here), lead), NONE)))
        for at, value in places:
            tree[act, size + at] = value
        nodes = [size + at.astype(np.int32) for at, _ in places]
        for _ in range(size.bit_length() - 1):
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                tree[act, x] = np.minimum(tree[act, 2 * x], tree[act, 2 * x + 1])
        act = act[tree[act, 1] < NONE]
    held = ids[:, :size] != NO_ID
    flat = ids[:, :size][held].astype("<u4").tobytes()
    ends = (np.cumsum(held.sum(axis=1)) * 4).tolist()
    return [flat[a:z] for a, z in zip([0] + ends, ends)]


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= NO_ID:
            raise ValueError("ids of 16 bits are needed")
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: Every way to cut a token in two tokens: such a pair merges with the token's rank, which is its id.
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.table, self.singles = PairTable(self.pairs), np.array(self.single, np.int32)
        self.split = regex.compile(pattern)
        self.plain = pattern == self._default_pattern()
        self.inner = regex.compile(r"(?<=\S) (?=\S)")
        #: Ids of a piece that a single space precedes; None if its ends aren't where matches end.
        self.memo: dict[str, bytes | None] = {}

    @staticmethod
    def _default_pattern() -> str:
        import public_tokenizers

        return public_tokenizers.PATTERN

    def matches(self, piece: str) -> list[str]:
        """Matches of the pattern; most pieces are a space, letters and at most one full stop or comma."""
        if self.plain and piece[:1] == " ":
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ".," and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.split.findall(piece)

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each match, as little-endian unsigned 32-bit integers."""
        out, todo = {}, {}
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                out[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONGEST:
                out[word] = np.array(merge(raw, self.pairs, self.single), "<u4").tobytes()
            else:
                todo.setdefault((len(raw) - 1).bit_length(), []).append((word, raw))
        for same in todo.values():
            for at in range(0, len(same), 4096):
                part = same[at : at + 4096]
                out.update(zip([w for w, _ in part], merge_many([r for _, r in part], self.table, self.singles)))
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes | None]:
        """What the memo lacks of these pieces; it keeps all but the long ones."""
        new = pieces.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = pieces
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        found = {p: self.matches(" " + p) for p in new - odd}
        ids = self.ids_of({w for ws in found.values() for w in ws})
        got = {p: b"".join([ids[w] for w in ws]) for p, ws in found.items()} | dict.fromkeys(odd)
        self.memo.update((p, x) for p, x in got.items() if len(p) <= LONGEST)
        return {p: x for p, x in got.items() if len(p) > LONGEST}

    def _whole(self, text: str) -> bytes:
        found = [self.matches(piece if k == 0 else " " + piece) for k, piece in enumerate(self.inner.split(text))]
        ids = self.ids_of({w for ws in found for w in ws})
        return b"".join([ids[w] for ws in found for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            part, weight = [], 0
            while at < len(texts) and (not part or weight + len(texts[at]) <= BATCH):
                part.append(texts[at])
                weight += len(texts[at])
                at += 1
            pieces = [t.split(" ") for t in part]
            long = self._learn({x for p in pieces for x in p[1:]})
            first = self.ids_of({w for p in pieces for w in self.matches(p[0])})
            memo = self.memo
            for text, p in zip(part, pieces):
                if p[0] and not p[0][-1].isspace() or len(p) == 1:
                    rest = [long[x] if x in long else memo[x] for x in p[1:]] if long else list(map(memo.__getitem__, p[1:]))
                    if None not in rest:
                        out.append(b"".join([*[first[w] for w in self.matches(p[0])], *rest]))
                        continue
                out.append(self._whole(text))
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


forgets(__name__, codec.cache_clear)


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ``ids``, an array of token ids.  path: a rank file that every executor can open."""
    path, pattern = _default(path, pattern)

    def make(batch):
        run = codec(path, pattern)
        return {"doc_id": batch.column(0), "ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in run.encode([t.decode() for t in as_bytes(batch.column(1))])], pa.list_(pa.int32()))}

    return map_rows(text_only(docs), make, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ``bytes`` of arrays of ids; null ids read as no tokens."""
    path, pattern = _default(path, pattern)

    def make(batch):
        run = codec(path, pattern)
        return {"doc_id": batch.column(0), "bytes": [run.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]}

    return map_rows(tokens.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each text, decode the ids, and describe both; with_ids: the ids too, as the last column."""
    path, pattern = _default(path, pattern)

    def make(batch):
        run, n, a, b, all_ids = codec(path, pattern), [], [], [], []
        for ids in run.encode([t.decode() for t in as_bytes(batch.column(1))]):
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(run.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
        out = {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        return out | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {})

    return map_rows(text_only(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
