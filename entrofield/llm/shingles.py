"""Word shingles as 64-bit hashes, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
LONG = 64
_powers = {"n": 0, "p": np.zeros(0, np.uint64), "inv": np.zeros(0, np.uint64)}


def _geometric(first: int, ratio: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(ratio), np.uint64)
    out[:1] = first
    return np.cumprod(out, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if _powers["n"] < n:
        size = max(1 << 14, 1 << n.bit_length())
        _powers.update(n=size, p=_geometric(1, _BASE, size), inv=_geometric(1, pow(_BASE, -1, 2**64), size))
    return _powers["p"], _powers["inv"]


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, A-Z lower-cased; of the whole sequence if it has fewer words; none without words.

    A rolling hash over the bytes: prefix sums of byte values times powers, so that each run costs one subtraction. Words of more than LONG bytes are first replaced by a
    cryptographic digest: modulo a power of two, such hashes have known collisions between structured strings, but only between longer ones than five words now have.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if max(map(len, words)) > LONG:
        words = [w if len(w) <= LONG else b"\x00" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words]
    b = np.frombuffer(b" ".join(words), np.uint8)
    p, inv = _tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * p[: len(b)], out=sums[1:])
    gaps = np.flatnonzero(b == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    start, end = (start[: len(words) - k + 1], end[k - 1 :]) if len(words) > k else (start[:1], end[-1:])
    return np.unique(mix((sums[end] - sums[start]) * inv[start]))


def digest(*parts: bytes) -> int:
    """Signed 64-bit hash of byte strings."""
    h = hashlib.blake2b(digest_size=8)
    for x in parts:
        h.update(x)
    return int.from_bytes(h.digest(), "little", signed=True)
