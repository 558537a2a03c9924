"""Hashes of stretches of bytes and of windows of words.

Words and windows of words, for whole arrays at once: the bytes of a word go through a
chain of mixing steps, eight at a time, and windows are trees of mixed pairs.  No step
is linear.  Lanes with seeds of their own give 64 bits each; they propose.

Stretches whose equality decides what is removed have 128 bits of BLAKE2b under a key
that is drawn for the run: no text can be made to collide with another.
"""

import hashlib
import os

import numpy as np
import xxhash

#: Seeds of mixing, and the odd number that pairs are told apart by.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
PAIRING = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretch_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """Two 64-bit numbers for each stretch data[start:end], whatever their lengths."""
    view, empty = memoryview(np.ascontiguousarray(data)), hashlib.blake2b(digest_size=16, key=key)
    out = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        h = empty.copy()
        h.update(view[a:b])
        out.append(h.digest())
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


#: Longer words are hashed one by one.
LONG_WORD = 128
#: Masks of the first 0 to 8 bytes of a little-endian number.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def fresh_seeds(n: int) -> tuple[int, ...]:
    """``n`` seeds that no text can have been made for."""
    return tuple(int.from_bytes(os.urandom(8), "little") for _ in range(n))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """The hash of each word data[start:end]."""
    size, wide = end - start, eights(data)
    out = mix(size.astype(np.uint64) + np.uint64(seed))
    at = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        at = at[size[at] > k] if k else at
        if not len(at):
            break
        out[at] = mix(out[at] ^ (wide[start[at] + k] & HEAD[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed))
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes, in that order."""
    return mix(a * np.uint64(PAIRING) + b)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` words: halves of two to the power k are paired, the largest first."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found, at, level, width = None, size, words, 1
    while True:
        if size & width:  # the windows' parts of this width, from the back
            at -= width
            part = level[at : at + n]
            found = part if found is None else paired(part, found)
        width *= 2
        if width > size:
            return paired(found, np.full(n, size, np.uint64))
        level = paired(level[: -width // 2], level[width // 2 :])


def words_in(word_byte: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of word bytes; ``offsets`` bound the rows, runs never cross them.

    ``word_byte``: for each byte value whether words have it.
    """
    inside = word_byte[data]
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first = np.zeros(len(data), bool)
    first[cuts] = True
    final = np.zeros(len(data), bool)
    final[cuts[cuts > 0] - 1] = True
    start = np.flatnonzero(inside & (~before | first))
    end = np.flatnonzero(inside & (~after | final)) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
