"""Minimal perfect hashing of 128-bit names in numpy, kept as files that many tasks read.

A shard holds, for its names: bit arrays of several levels (a name's place in a level is a hash of it and the level; places
that one name alone takes are set, the others' names go on to the next level), the number of set bits before each word, and
arrays in the order of those bits: a fingerprint and a count of each name."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs

from .kernels import mix

U64 = np.uint64
#: Places for each name of a level; two make about 60 % of the names settle in each.
ROOM = 2
#: What a worker holds of shards that aren't mapped from a mounted folder.
CACHE_BYTES = 64 << 20
_GOLDEN = 0x9E3779B97F4A7C15


def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hi ^ mix(lo + U64((level + 1) * _GOLDEN & (1 << 64) - 1))) % U64(size)).astype(np.int64)


@dataclass
class Shard:
    sizes: np.ndarray  # places of each level, whole words
    bits: np.ndarray  # uint64, the levels back to back
    ranks: np.ndarray  # uint32, bits set before each word
    prints: np.ndarray  # uint64, by index
    counts: np.ndarray  # uint32, by index

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """0 .. n - 1, each once, for the names of the shard; anything from -1 to n - 1 for other names."""
        out, live, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(live):
                break
            at = base + _places(hi[live], lo[live], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = word[hit] & ((U64(1) << bit[hit]) - U64(1))
            out[live[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + np.bitwise_count(below)
            live, base = live[~hit], base + size
        return out

    def lookup(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The counts of names, 0 for those that aren't here: their fingerprint differs but once in 2**64."""
        at = self.index(hi, lo)
        found = at >= 0
        found[found] = self.prints[at[found]] == lo[found]
        out = np.zeros(len(hi), np.int64)
        out[found] = self.counts[at[found]]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.prints), len(self.sizes), len(self.bits), *self.sizes], np.int64)
        pad = np.zeros(len(self.bits) % 2, np.uint32)
        return b"".join(x.tobytes() for x in (head, self.bits, self.prints, self.ranks, pad, self.counts))


def build(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> Shard:
    """Distinct names with counts (up to 2**32 - 1)."""
    sizes, words, live, level = [], [], np.arange(len(hi)), 0
    where, base = np.zeros(len(hi), np.int64), 0
    while len(live):
        size = -(-ROOM * len(live) // 64) * 64
        at = _places(hi[live], lo[live], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bit = np.zeros(size, np.uint8)
        bit[at[alone]] = 1
        words.append(np.packbits(bit, bitorder="little").view("<u8"))
        where[live[alone]] = base + at[alone]
        sizes.append(size)
        live, base, level = live[~alone], base + size, level + 1
    bits = np.concatenate(words) if words else np.zeros(0, U64)
    set_ = np.bitwise_count(bits).astype(np.int64)
    order = np.argsort(where)
    return Shard(np.array(sizes, np.int64), bits, (np.cumsum(set_) - set_).astype(np.uint32), lo[order], np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32))


def load(content: pa.Buffer | bytes) -> Shard:
    """What dump() wrote; arrays are views."""
    n, levels, words = np.frombuffer(content, np.int64, 3).tolist()
    at = 24 + 8 * levels
    sizes, bits = np.frombuffer(content, np.int64, levels, 24), np.frombuffer(content, U64, words, at)
    prints, ranks = np.frombuffer(content, U64, n, at + 8 * words), np.frombuffer(content, np.uint32, words, at + 8 * (words + n))
    return Shard(sizes, bits, ranks, prints, np.frombuffer(content, np.uint32, n, at + 8 * (words + n) + 4 * (words + words % 2)))


def path(folder: str, shard: int) -> str:
    return f"{folder}/{shard:08d}.mph"


def save(folder: str, shard: int, made: Shard, attempt: str) -> int:
    """Writes a shard; its name appears when it is complete, and a task that runs again writes the same bytes."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    content, part = made.dump(), f"{path(root, shard)}.{attempt}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(content)
    if store.get_file_info(path(root, shard)).type == fs.FileType.NotFound:
        store.move(part, path(root, shard))
    else:
        store.delete_file(part)
    return len(content)


_held: OrderedDict[str, tuple[Shard, int]] = OrderedDict()


def fetch(folder: str, shard: int) -> Shard:
    """A shard by its folder: mapped where the folder is mounted (so the workers of a host share its pages), else read and
    kept while no more than CACHE_BYTES are."""
    name = path(folder, shard)
    if name in _held:
        _held.move_to_end(name)
        return _held[name][0]
    store, root = fs.FileSystem.from_uri(folder)
    mapped = isinstance(store, fs.LocalFileSystem)
    with (fs.LocalFileSystem(use_mmap=True) if mapped else store).open_input_file(path(root, shard)) as source:
        content = source.read_buffer()
    _held[name] = load(content), 1024 if mapped else content.size
    while len(_held) > 1 and sum(size for _, size in _held.values()) > CACHE_BYTES:
        _held.popitem(last=False)
    return _held[name][0]


def counts_of(folder: str, bits: int, present: frozenset[int], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Counts of names, shard after shard; the upper `bits` bits of a name say which shard."""
    out = np.zeros(len(hi), np.int64)
    shard = (hi >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)
    order = np.argsort(shard, kind="stable")
    ids, begin = np.unique(shard[order], return_index=True)
    for s, at in zip(ids.tolist(), np.split(order, begin[1:]), strict=True):
        if s in present:
            out[at] = fetch(folder, s).lookup(hi[at], lo[at])
    return out
