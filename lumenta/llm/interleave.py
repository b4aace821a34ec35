"""Merging the Burrows-Wheeler transforms of shards by interleave refinement, to be measured.

This is the method named for op10, in memory: every shard sorts its own suffixes; the order of
all suffixes starts as one shard after the other and is refined by one character a round,
with one stable counting sort of the characters before them, until it is right to the length
that matters.  Positions that no round has told apart share that many bytes.  No suffix is
sorted again.  suffix_dedup finds the same bytes within the budget; `python -m
lumenta.llm.interleave FILE MEGABYTES SHARDS` prints what this costs.
"""

from __future__ import annotations

import sys
import time

import numpy as np


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, documents): bytes from 1 up, and a 0 behind each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.uint16) + 1
    data[np.cumsum(sizes) - 1] = 0
    return data, np.repeat(np.arange(len(texts)), sizes)


def suffixes(data: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling; ends of texts differ, in their order, so that no suffix
    goes on in the next text."""
    n = len(data)
    ends = np.flatnonzero(data == 0)
    rank = data.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width = 1
    while True:
        after = np.full(n, -1)
        after[: n - width] = rank[width:]
        order = np.lexsort((after, rank))
        new = np.r_[0, np.cumsum((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def refined(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, interval) of each place in the merged order, right to `rounds` characters; places
    of one interval share as many."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    interval = np.zeros(len(shard), np.int64)
    before = np.empty(len(shard), np.uint16)
    for _ in range(rounds):
        for k, t in enumerate(transforms):
            before[shard == k] = t
        order = np.argsort(before, kind="stable")
        shard, kind, interval = shard[order], before[order], interval[order]
        new = (kind[1:] != kind[:-1]) | (interval[1:] != interval[:-1]) | (kind[1:] == 0)
        interval = np.r_[0, np.cumsum(new)]
    return shard, interval


def covered(shards: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """Which bytes of each text a string covers that also starts earlier."""
    parts = [joined(texts) for texts in shards]
    orders = [suffixes(data) for data, _ in parts]
    shard, interval = refined([data[order - 1] for (data, _), order in zip(parts, orders, strict=True)], length)
    place = np.empty(len(shard), np.int64)
    base = np.cumsum([0, *(len(data) for data, _ in parts)])
    for k, order in enumerate(orders):
        place[shard == k] = order + base[k]
    order = np.lexsort((place, interval))
    again = np.r_[False, interval[order][1:] == interval[order][:-1]]
    edge = np.zeros(base[-1] + length + 1, np.int64)
    edge[place[order][again]] += 1
    edge[place[order][again] + length] -= 1
    cover = np.cumsum(edge)[: base[-1]] > 0
    out = []
    for k, (_, docs) in enumerate(parts):
        own = cover[base[k] : base[k + 1]]
        cuts = np.flatnonzero(np.diff(docs)) + 1
        out.append([c[:-1] for c in np.split(own, cuts)])
    return out


def main(path: str, megabytes: str, shards: str) -> None:
    import pyarrow.parquet as pq

    texts, size = [], 0
    for t in pq.read_table(path, columns=["text"]).column("text").to_pylist():
        texts.append((t or "").encode())
        size += len(texts[-1])
        if size >= float(megabytes) * 1e6:
            break
    count = int(shards)
    parts = [joined(texts[k::count])[0] for k in range(count)]
    began = time.process_time()
    orders = [suffixes(data) for data in parts]
    sorted_s = time.process_time() - began
    began = time.process_time()
    refined([data[order - 1] for data, order in zip(parts, orders, strict=True)], 100)
    merged_s = time.process_time() - began
    print(f"{size / 1e6:.1f} MB in {count} shards: suffixes {sorted_s / size * 1e9:.0f} ns a byte, 100 rounds {merged_s / size * 1e9:.0f} ns a byte")


if __name__ == "__main__":
    main(*sys.argv[1:])
