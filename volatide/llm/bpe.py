"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern; each match is encoded by itself. The matches that a worker hasn't met yet
are gathered for a batch of texts and encoded together: they are bucketed by length and laid out as rows of padded
id matrices; each round looks up every row's adjacent pairs in a hash table (open addressing, vectorised probing),
merges the leftmost pair of minimum rank of every row, closes the gap, and drops rows without a pair left
(compaction). A row of more than SINGLE bytes merges all occurrences of its minimum pair in one round, from the left
and without overlap, up to the first that makes a pair of lower rank: the same merges in the same order, in as many
rounds as it has different merges. Encoded matches are kept in a bounded cache, which only saves work.

Ids come as binary columns of little-endian unsigned 32-bit integers. Rank files are read on each worker from a
path that is a parameter (they belong to an installed package).

Defined results: null text counts as empty; empty text has no ids and decodes to no bytes; texts of any length are
encoded whole, in stretches of about a million characters that are cut at single spaces, where matches always
begin; other columns are kept, but for those with an output's name, which are replaced; repeated rows give repeated
results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volatide.llm.common import add_columns

NONE = np.int32(2**31 - 1)
#: Bytes of a match up to which its row merges one pair a round.
SINGLE = 1024
#: Cached stretches and matches a worker keeps before it starts anew, and texts it encodes at once.
CACHE_ENTRIES = 150_000
TEXTS_AT_ONCE = 256
STRETCH = 1_000_000

# White space next to a space, or a space at an end: there a plain split by spaces isn't safe.
_UNSAFE = re.compile(r"\s | \s| \Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class PairTable:
    """(left id, right id) -> id of the merged token, as an open-addressing hash table in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            at, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at], self.values[at] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair. Negative ids (padding) have none."""
        shape = left.shape
        keys = ((left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | right.astype(np.int64).astype(np.uint64)).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot = self._slot(keys[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBPE:
    """A rank file with its pattern; ranks are ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs, np.int64).T.reshape(3, -1).astype(np.int32))
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian id bytes of each match."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > SINGLE:
                out[i] = self._by_long_row(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for at in range(0, len(rows), 200_000 // width + 1):
                part = rows[at : at + 200_000 // width + 1]
                for i, ids in zip(part, self._by_matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.bytes[raw], np.int32(-1))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(row):
            at = ranks.argmin(1)  # the leftmost minimum
            best = ranks[np.arange(len(row)), at]
            ended = best == NONE
            if ended.any():
                for r, x, n in zip(row[ended].tolist(), ids[ended].astype("<u4"), (ids[ended] >= 0).sum(1).tolist(), strict=True):
                    done[r] = x[:n].tobytes()
                row, ids, ranks, at, best = (x[~ended] for x in (row, ids, ranks, at, best))
                if not len(row):
                    break
            n, last = np.arange(len(row)), ids.shape[1] - 1
            take = np.arange(last + 1) + (np.arange(last + 1) > at[:, None])
            moved = np.take_along_axis(ids, np.minimum(take, last), 1)
            moved[take > last] = -1
            moved[n, at] = best
            # Pairs after the merge move by one; the pair before it, and the one it begins, are looked up.
            span = np.arange(last)
            ranks = np.take_along_axis(ranks, np.minimum(span + (span > at[:, None]), last - 1), 1)
            ranks[:, -1] = NONE
            prior = np.maximum(at - 1, 0)
            before = self.pairs.find(np.where(at > 0, moved[n, prior], -1), moved[n, at])
            after = self.pairs.find(moved[n, at], np.where(at < last, moved[n, np.minimum(at + 1, last)], -1))
            has = at < last
            ranks[n[has], at[has]] = after[has]
            has = at > 0
            ranks[n[has], prior[has]] = before[has]
            ids = moved
        return done

    def _by_long_row(self, piece: bytes) -> bytes:
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            # Of touching occurrences every second one, from the left, is merged.
            at = np.flatnonzero(ranks == best)
            start = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            # When one is merged, those before it are, and those after it aren't yet.
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][np.diff(at) == 2] = best
            after = np.append(ids, [-1, -1])[at + 2]
            first = np.minimum(self.pairs.find(before, np.full_like(before, best)), self.pairs.find(np.full_like(after, best), after)) <= best
            if first.any():  # a pair that goes before the rest
                at = at[: int(first.argmax()) + 1]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids[at] = best
            now = ids[kept]
            place = np.cumsum(kept)[at] - 1  # of the merged tokens
            left, right = place[place > 0] - 1, place[place < len(now) - 1]
            # A pair goes with its left token; those of a merged token, and of the one before it, are new.
            ranks = np.append(ranks, NONE)[kept][:-1]
            ranks[left], ranks[right] = self.pairs.find(now[left], now[left + 1]), self.pairs.find(now[right], now[right + 1])
            ids = now
        return ids.astype("<u4").tobytes()

    def _learn(self, wanted: set[str]) -> None:
        """Put the ids of these stretches without inner spaces into the cache."""
        cuts = {w: self.pattern.findall(w) for w in wanted}
        new = list({p for ps in cuts.values() for p in ps if p not in self.pieces})
        self.pieces.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        get = self.pieces.__getitem__
        self.chunks.update((w, b"".join(map(get, ps))) for w, ps in cuts.items())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian id bytes of each whole text."""
        for cache in (self.chunks, self.pieces):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        parts: list[tuple[str, list[str]]] = []
        for text in texts:
            if _UNSAFE.search(text):
                parts.append(("", self.pattern.findall(text)))
            else:
                parts.append((" ", text.split(" ")))
        # Stretches after a space carry it; the first one of a text doesn't, so it has a key of its own.
        spaced = {w for sep, ws in parts if sep for w in ws[1:]}
        wanted = {" " + w for w in spaced if " " + w not in self.chunks}
        wanted.update(w for sep, ws in parts for w in (ws[:1] if sep else set(ws)) if w not in self.chunks)
        self._learn(wanted)
        local = {w: self.chunks[" " + w] for w in spaced}
        get, own = local.__getitem__, self.chunks.__getitem__
        return [own(ws[0]) + b"".join(map(get, ws[1:])) if sep else b"".join(map(own, ws)) for sep, ws in parts]

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        short: list[str] = []
        for text in texts:
            if text is None or len(text) <= STRETCH:
                short.append(text or "")
            else:
                out += self.encode_batch(short)
                short = []
                out.append(b"".join(self.encode_batch([s])[0] for s in stretches(text)))
        return out + self.encode_batch(short)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def stretches(text: str, length: int = STRETCH):
    """Cut a long text before single spaces between other characters: a match always begins there."""
    at = 0
    while len(text) - at > length:
        found = _CUT.search(text, at + length)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One a worker process."""
    return ByteBPE(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (binary); with `decoded`, also the bytes that these ids decode to."""

    def make(batch):
        bpe = tokenizer(path, pattern)
        found = bpe.encode_texts(batch.column(text).to_pylist())
        back = [] if decoded is None else [pa.array([bpe.decode(x) for x in found], pa.binary())]
        return [pa.array(found, pa.binary()), *back]

    return add_columns(df, [T.StructField(name, T.BinaryType()) for name in (ids, decoded) if name is not None], make, TEXTS_AT_ONCE)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add `out`: the bytes of the ids in a binary column (null: none)."""

    def make(batch):
        bpe = tokenizer(path, pattern)
        return [pa.array([bpe.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())]

    return add_columns(df, [T.StructField(out, T.BinaryType())], make, TEXTS_AT_ONCE)
