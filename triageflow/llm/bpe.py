"""Byte-level BPE encoding and decoding.

A text is cut at its special tokens, then by the pre-tokenisation pattern; each
piece is merged by a segment tree over the ranks of its adjacent pairs: a leaf
holds (rank, position) of the pair that starts there, an inner node the smaller
of its children, so the root is the leftmost pair of the lowest rank. A merge
changes at most three leaves, each a point update up the tree; the piece is done
when the root holds no mergeable pair. A piece of n bytes costs O(n log n).
Pieces that a batch brings for the first time are merged together, one tree per
row of a numpy matrix, all trees a step at a time; long pieces are merged alone.

Texts are read in slices that end before a white space that follows another
character (no token spans such a place), so a very long text is never held as
one list of tokens. Null text counts as empty: no ids, empty decoding.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array

import numpy as np
import regex

from triageflow.llm.common import struct_udf

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_CHARS = 1 << 16
CACHED_PIECES = 1 << 18
LOCKSTEP = 64
ROWS = 1 << 14
GROUP_CHARS = 1 << 20
NO_RANK = 1 << 28
_FREE = 1 << 60


def byte_chars() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary file:
    printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Plain tables of a byte-level BPE file (read on the driver, shipped with
    the task): ids of the 256 bytes, merges by pair of ids, bytes by id,
    special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    of = byte_chars()
    vocab = file["model"]["vocab"]
    raw = {i: bytes(of[c] for c in t) for t, i in vocab.items()}
    merges = {}
    for rank, pair in enumerate(file["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    raw |= {i: t.encode() for t, i in special.items()}
    return {"bytes": [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])],
            "merges": merges, "raw": raw, "special": special}


def merge_piece(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent pairs, leftmost of the lowest rank first."""
    n = len(ids)
    if n < 2:
        return ids
    get = merges.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_FREE] * (2 * size)
    for i in range(n - 1):
        hit = get(ids[i] << 20 | ids[i + 1])
        if hit:
            tree[size + i] = hit[0] << 32 | i
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    if tree[1] == _FREE:
        return ids
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (top := tree[1]) != _FREE:
        i = top & 0xFFFFFFFF
        j = after[i]
        ids[i] = get(ids[i] << 20 | ids[j])[1]
        ids[j] = -1
        k = after[i] = after[j]
        changed = [(j, _FREE)] if j < n - 1 else []
        if k < n:
            before[k] = i
            hit = get(ids[i] << 20 | ids[k])
            changed.append((i, hit[0] << 32 | i if hit else _FREE))
        else:
            changed.append((i, _FREE))
        p = before[i]
        if p >= 0:
            hit = get(ids[p] << 20 | ids[i])
            changed.append((p, hit[0] << 32 | p if hit else _FREE))
        for leaf, value in changed:
            k = size + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                k >>= 1
                x, y = tree[2 * k], tree[2 * k + 1]
                low = x if x < y else y
                if tree[k] == low:
                    break
                tree[k] = low
    return [x for x in ids if x >= 0]


def slices(text: str, size: int = SLICE_CHARS):
    """Cut a text at places that no token spans: before a white space that
    follows a character of another kind."""
    cut, at, n = regex.compile(r"(?<=\S)\s"), 0, len(text)
    while n - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class PairTable:
    """Merges by pair of ids as an open-addressing table for whole arrays."""

    SIZE = 1 << 20

    def __init__(self, merges: dict[int, tuple[int, int]]):
        self.key = np.full(self.SIZE, -1, np.int64)
        self.rank = np.full(self.SIZE, NO_RANK, np.int64)
        self.made = np.zeros(self.SIZE, np.int64)
        self.probes = 1
        todo = np.fromiter(merges, np.int64, len(merges))
        value = np.array([merges[k] for k in todo.tolist()], np.int64).reshape(-1, 2)
        at = self.slot(todo)
        while len(todo):
            free = self.key[at] < 0
            self.key[at[free]] = todo[free]  # of several keys for a slot the last one stays
            won = self.key[at] == todo
            self.rank[at[won]], self.made[at[won]] = value[won].T
            todo, value, at = todo[~won], value[~won], (at[~won] + 1) & (self.SIZE - 1)
            self.probes += bool(len(todo))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair's merge, or -1."""
        key = left << 20 | right
        at = self.slot(key)
        out = np.where(self.key[at] == key, at, -1)
        for _ in range(self.probes - 1):
            at = (at + 1) & (self.SIZE - 1)
            out = np.where(self.key[at] == key, at, out)
        return out

    def leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        at = self.find(left, right)
        return np.where(at >= 0, self.rank[at] << 32 | position, _FREE)


def merge_pieces(ids: np.ndarray, length: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge one piece per row of ``ids`` (rows x a power of two of columns,
    ``length`` ids in each row, at least 2); -1 marks the places merged away."""
    rows, size = ids.shape
    ids = np.where(np.arange(size) < length[:, None], ids, -1)
    tree = np.full((rows, 2 * size), _FREE, np.int64)
    both = ids[:, 1:] >= 0
    r, c = np.nonzero(both)
    tree[r, size + c] = pairs.leaf(ids[r, c], ids[r, c + 1], c)
    half = size
    while half > 1:
        tree[:, half // 2:half] = np.minimum(tree[:, half:2 * half:2], tree[:, half + 1:2 * half:2])
        half //= 2
    after = np.tile(np.arange(1, size + 1), (rows, 1))
    before = np.tile(np.arange(-1, size - 1), (rows, 1))
    live = np.flatnonzero(tree[:, 1] < _FREE)
    while len(live):
        i = tree[live, 1] & 0xFFFFFFFF
        j = after[live, i]
        made = pairs.made[pairs.find(ids[live, i], ids[live, j])]
        ids[live, i], ids[live, j] = made, -1
        k = after[live, j]
        after[live, i] = k
        more = k < length[live]
        own = np.full(len(live), _FREE, np.int64)
        own[more] = pairs.leaf(made[more], ids[live[more], k[more]], i[more])
        before[live[more], k[more]] = i[more]
        p = before[live, i]
        prev = np.flatnonzero(p >= 0)
        for who, leaf, value in ((live, j, _FREE), (live, i, own),
                                 (live[prev], p[prev], pairs.leaf(ids[live[prev], p[prev]], made[prev], p[prev]))):
            node = size + leaf
            tree[who, node] = value
            while size > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
        live = live[tree[live, 1] < _FREE]
    return ids


class Coder:
    """Encoder and decoder of one vocabulary; ids are kept as decimal text."""

    def __init__(self, vocabulary: dict):
        self.special = {t: str(i) for t, i in vocabulary["special"].items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.raw = {str(i): b for i, b in vocabulary["raw"].items()}
        self.first = np.array(vocabulary["bytes"], np.int64)
        self.merges, self.pairs = vocabulary["merges"], PairTable(vocabulary["merges"])
        self.known: dict[str, str] = {}

    def learn(self, pieces: set[str]) -> None:
        """Merge the given pieces; those of up to LOCKSTEP bytes together."""
        of_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "replace")
            if len(b) > LOCKSTEP:
                self.known[p] = ",".join(map(str, merge_piece(self.first[list(b)].tolist(), self.merges)))
            else:
                of_size.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for size, some in of_size.items():
            for at in range(0, len(some), ROWS):
                part = some[at:at + ROWS]
                length = np.array([len(b) for _, b in part], np.int64)
                raw = np.frombuffer(b"".join(b.ljust(size, b"\0") for _, b in part), np.uint8)
                ids = merge_pieces(self.first[raw].reshape(-1, size), length, self.pairs)
                flat = ids[ids >= 0].astype("U6").tolist()
                end = np.cumsum((ids >= 0).sum(1)).tolist()
                start = 0
                for (p, _), e in zip(part, end):
                    self.known[p] = ",".join(flat[start:e])
                    start = e

    def parts(self, text: str):
        """(special token's id, None) or (None, pieces of a slice), in order."""
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield self.special[part], None
            elif part:
                for s in slices(part):
                    yield None, self.pieces(s)

    def encoded(self, texts):
        """(number of the text, comma-joined ids of a part of it), in order; the
        new pieces of about GROUP_CHARS of text are learned at once."""
        held, chars = [], 0
        for n, text in enumerate(texts):
            for token, pieces in self.parts(text or ""):
                held.append((n, token, pieces))
                chars += SLICE_CHARS if pieces and len(text) > SLICE_CHARS else 0
            chars += min(len(text or ""), SLICE_CHARS)
            if chars >= GROUP_CHARS:
                yield from self.flushed(held)
                held, chars = [], 0
        yield from self.flushed(held)

    def flushed(self, held: list):
        known = self.known
        new = set()
        for _, _, pieces in held:
            if pieces:
                new.update(pieces)
        if len(known) + len(new) > CACHED_PIECES:
            known.clear()
        self.learn(new.difference(known))
        for n, token, pieces in held:
            yield n, token if pieces is None else ",".join(map(known.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, s in self.encoded([text]) for i in s.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.raw[str(i)] for i in ids).decode("utf-8", "replace")

    def digests(self, texts: list[str | None]):
        """Per text the number of ids, SHA-256 of the comma-joined ids and of
        the text that they decode to, both fed part by part."""
        raw = self.raw.__getitem__
        state = None

        def ended():
            n, ids, back, decoder = state
            back.update(decoder.decode(b"", True).encode())
            return n, ids.hexdigest(), back.hexdigest()

        done = 0
        for n, s in self.encoded(texts):
            while done < n or state is None:
                if state is not None:
                    yield ended()
                    done += 1
                state = [0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")]
            each = s.split(",")
            if state[0]:
                state[1].update(b",")
            state[0] += len(each)
            state[1].update(s.encode())
            state[2].update(state[3].decode(b"".join(map(raw, each))).encode())
        while done < len(texts):
            state = state or [0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")]
            yield ended()
            done += 1
            state = None

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return next(self.digests([text]))


_coders: dict[str, Coder] = {}


def coder(name: str, vocabulary: dict) -> Coder:
    """One coder, and one piece cache, per Python worker."""
    if name not in _coders:
        _coders[name] = Coder(vocabulary)
    return _coders[name]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_digest(spark, path: str | None = None):
    """Column function text -> struct(n_tokens, ids_sha256, decoded_sha256)."""
    path = path or default_path()
    shared = spark.sparkContext.broadcast(load_vocabulary(path))  # bounded by the vocabulary file
    return struct_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                      lambda texts: coder(path, shared.value).digests(texts))


def bpe_encode(spark, path: str | None = None):
    """Column function text -> struct(ids array<int>, decoded string)."""
    path = path or default_path()
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(texts):
        c = coder(path, shared.value)
        ids = [array("i") for _ in texts]  # 4 bytes an id, not a list of objects
        for n, s in c.encoded(texts):
            ids[n].extend(map(int, s.split(",")))
        return ((np.frombuffer(i, np.int32) if i else [], c.decode(i)) for i in ids)

    return struct_udf("ids array<int>, decoded string", run)
