"""Circulant MinHash signatures and band keys, as numpy kernels over Arrow lists.

Two permutations do the work of all: sigma scatters the elements once, and coordinate k is the minimum of
one permutation pi, shifted circularly by k places, over the scattered set. Both run over the 2^32
hash values and are given by invertible mixing functions instead of tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements hashed at once; keeps the working arrays in the processor's cache.
_STRIDE = 1 << 15


@dataclass(frozen=True)
class BandConfig:
    """bands keys of `rows` coordinates each; 64 further coordinates give one bit each to a sketch.

    Two sets of similarity s meet in some band with probability 1 - (1 - s^rows)^bands.
    """

    rows: int
    bands: int

    def recall(self, s: float) -> float:
        return 1 - (1 - s**self.rows) ** self.bands


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray, work: np.ndarray) -> None:
    """The second permutation, in place."""
    np.right_shift(x, 15, out=work)
    np.bitwise_xor(x, work, out=x)
    np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
    np.right_shift(x, 12, out=work)
    np.bitwise_xor(x, work, out=x)
    np.multiply(x, np.uint32(0x297A2D39), out=x)
    np.right_shift(x, 15, out=work)
    np.bitwise_xor(x, work, out=x)


def signatures(flat: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """(sets, coordinates) minima; `starts` are the first elements of the non-empty sets in `flat`."""
    out = np.empty((len(starts), coordinates), np.uint32)
    ends = np.append(starts[1:], len(flat))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _STRIDE, side="right")))
        part = _sigma(flat[starts[first] : ends[last - 1]].astype(np.uint32))
        at = starts[first:last] - starts[first]
        x, work = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.subtract(part, np.uint32(k), out=x)
            _pi(x, work)
            out[first:last, k] = np.minimum.reduceat(x, at)
        first = last
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(signature: np.ndarray, config: BandConfig) -> np.ndarray:
    """(sets, bands) 64-bit keys; the number of the band is part of the key."""
    keys = np.empty((len(signature), config.bands), np.uint64)
    for band in range(config.bands):
        key = np.full(len(signature), band + 1, np.uint64)
        for r in range(config.rows):
            key = _mix64(key ^ signature[:, band * config.rows + r].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        keys[:, band] = key
    return keys.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of each of 64 coordinates; equal bits estimate (1 + s) / 2."""
    bits = (signature & np.uint32(1)).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A bit for each of 64 classes of elements: whether a set holds an odd number of them. Two sets differ in at least as many elements as bits."""
    x = _mix64(flat.astype(np.uint32).astype(np.uint64)) & np.uint64(63)
    return np.bitwise_xor.reduceat(np.uint64(1) << x, starts).view(np.int64)


def banding(config: BandConfig, small: int, large: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (tid long, grams array<int>): (tid, size, sketch, parity, keys); empty sets give no row.

    Sets of up to `small` elements have a parity, sets of at least `large` a sketch; else these are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = config.rows * config.bands
        for batch in batches:
            grams = batch.column(1)
            offsets = grams.offsets.to_numpy().astype(np.int64)
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            if not len(full):
                continue
            base = offsets[0]
            flat = grams.values.to_numpy()[base : offsets[-1]]
            starts, size = offsets[:-1][full] - base, np.diff(offsets)[full]
            signature = signatures(flat, starts, n + 64)
            keys = band_keys(signature[:, :n], config)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, config.bands, dtype=np.int32)), pa.array(keys.ravel()))
            sketch = np.where(size >= large, sketches(signature[:, n:]), 0)
            parity = np.where(size <= small, parities(flat, starts), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array(size.astype(np.int32)), pa.array(sketch), pa.array(parity), lists], ["tid", "size", "sketch", "parity", "keys"])

    return run


BANDED = "tid long, size int, sketch long, parity long, keys array<long>"


def lead_banding(config: BandConfig, least: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (tid long, grams array<int>): (tid, size, key), one row a band of a leading part.

    The parts of a set, in the order of its text, are its first least, 2 least, 4 least ... elements and the
    whole; every part is the one before and what follows, so all signatures cost one pass. With `every`
    all parts are given, else the longest full lead and the whole: a text cut short meets the whole text
    there, however much was lost. Sets of fewer than `least` elements give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = config.rows * config.bands
        for batch in batches:
            grams = batch.column(1)
            offsets = grams.offsets.to_numpy().astype(np.int64)
            full = np.flatnonzero(np.diff(offsets) >= least)
            if not len(full):
                continue
            begin, size = offsets[full], np.diff(offsets)[full]
            leads = np.floor(np.log2(size / least)).astype(np.int64) + 1  # full leads
            parts = leads + (size > least << (leads - 1))  # the rest behind the last lead is a part too
            first = np.cumsum(parts) - parts
            of = np.repeat(np.arange(len(full)), parts)
            k = np.arange(len(of)) - first[of]
            starts = begin[of] + np.where(k > 0, least << np.maximum(k - 1, 0), 0)
            # sets lie one after another but for short ones, which are passed over
            flat = grams.values.to_numpy()
            taken = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            shift = begin - (np.cumsum(size) - size)
            signature = signatures(flat[taken], starts - shift[of], n)
            for j in range(1, int(parts.max())):
                at = first[parts > j] + j
                signature[at] = np.minimum(signature[at], signature[at - 1])
            last = first + parts - 1
            lead = np.flatnonzero(k < leads[of]) if every else first + leads - 1
            rows = np.concatenate((lead, last))
            tag = np.concatenate((k[lead] + 1, np.zeros(len(last), np.int64))).astype(np.uint64)
            keys = _mix64(band_keys(signature[rows], config).view(np.uint64) ^ _mix64(tag)[:, None]).view(np.int64)
            who = np.repeat(of[rows], config.bands)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full[who])), pa.array(size[who].astype(np.int32)), pa.array(keys.ravel())], ["tid", "size", "key"])

    return run


LEADS = "tid long, size int, key long"


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.hash(w))


def shingling(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (tid long, w array<int>), w being word hashes: (tid, grams), the distinct hashes of `width` adjacent words in order.

    Texts of fewer words get an empty list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint32)
            size = np.diff(offsets)
            n = max(len(flat) - width + 1, 0)
            x = np.zeros(n, np.uint64)
            for k in range(width):
                x = _mix64(x ^ flat[k : k + n].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            row = np.repeat(np.arange(len(size)), np.maximum(size - width + 1, 0))
            start = offsets[:-1] - offsets[0]
            first = np.cumsum(np.maximum(size - width + 1, 0)) - np.maximum(size - width + 1, 0)
            at = start[row] + np.arange(len(row)) - first[row]
            gram = (x[at] >> np.uint64(32)).astype(np.uint64)
            # the first of each hash in its row
            _, kept = np.unique((row.astype(np.uint64) << np.uint64(32)) | gram, return_index=True)
            kept.sort()
            counts = np.bincount(row[kept], minlength=len(size))
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            values = pa.array(gram[kept].astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["tid", "grams"])

    return run


SHINGLED = "tid long, grams array<int>"
