"""Shingle sets of whole texts in numpy, over Arrow columns: what a task does with its documents.

Words are the runs of bytes other than the six ASCII white-space bytes (safe in UTF-8), A-Z lower-cased, each hashed to 64 bits.
A shingle's hash is made of its words' hashes. Long texts are hashed in parts cut at white space, so the working memory is a
few dozen MB and 8 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once.
PART = 1 << 20
_R, _M, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of ``raw`` (bytes); a word also ends before each of the places ``firsts``."""
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inside = firsts[firsts < len(raw)]
    begins[inside] = solid[inside]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    letters = raw[at]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint64)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _R))
    sums = np.add.reduceat((letters + np.uint64(1)) * powers[np.arange(len(at)) - np.repeat(first, lengths)], first)
    return _mixed(sums + lengths.astype(np.uint64)), starts


def _parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about ``PART`` that end where a text ends or at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = int(offsets[max(np.searchsorted(offsets, at + PART, "right") - 1, 0)])
        if to <= at:  # one long text
            to = min(at + PART, int(offsets[np.searchsorted(offsets, at, "right")]))
            stop = int(offsets[np.searchsorted(offsets, at, "right")])
            while to < stop and raw[to] not in (9, 10, 11, 12, 13, 32):
                to += 1
        yield at, to
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all ``texts`` one after another, and where each text's begin (and the last one's end)."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _parts(raw, offsets):
        h, at = _words(raw[a:b], offsets[(offsets >= a) & (offsets < b)] - a)
        hashes.append(h)
        places.append(at + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of one to four words is one shingle, one without words has none."""
    words, ends = word_hashes(texts)
    grams = words[: max(len(words) - SHINGLE + 1, 0)]
    for k in range(1, SHINGLE):
        grams = (grams ^ (grams >> np.uint64(29))) * _M + words[k : len(grams) + k]
    grams = _mixed(grams)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            raw = hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest()
            yield np.frombuffer(raw, np.uint64)
        else:
            yield grams[:0]


def digest(shingles: np.ndarray, doc_id: int) -> bytes:
    """128 bits of a set; an empty one, which is like no other, gets those of its id."""
    raw = shingles.tobytes() if len(shingles) else b"id" + str(doc_id).encode()
    return hashlib.blake2b(raw, digest_size=16).digest()


def short_key(d: bytes) -> int:
    """The first 64 bits of a digest."""
    return int.from_bytes(d[:8], "little", signed=True)
