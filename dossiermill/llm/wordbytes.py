"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes handled at a time; arrays of eight bytes for each of them live together.
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
U64 = 1 << 64

_BYTES = np.arange(256, dtype=np.uint8)
#: Bytes of words between white space (and NUL, which stands between texts here), and
#: the table that lowers A-Z.
SPACED = (_BYTES > 0x20) | ((_BYTES > 0) & (_BYTES < 9)) | ((_BYTES > 13) & (_BYTES < 0x20))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + (1 << 16))
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, U64))):
                out = np.full(size, base, dtype=np.uint64)
                out[0] = 1
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads hash values over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: A random value for each byte value, so that sums of powers do not line up.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Hasher:
    """Hashes of any byte ranges of one array of at most a few PIECEs."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def batches(texts: Iterable[bytes], size: int = PIECE, count: int = 1 << 15) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of up to ``count`` neighbouring texts of about ``size`` bytes: (number
    of the first, texts)."""
    first, run, total = 0, [], 0
    for n, t in enumerate(texts):
        if run and (total + len(t) > size or len(run) == count):
            yield first, run
            first, run, total = n, [], 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


class Words:
    """The words of some texts: for each word its text's number, its byte range in
    ``data`` (all texts, mapped through ``table``, zero bytes between them) and a
    64-bit hash. ``is_word`` and ``table`` have 256 entries; byte 0 is no word.
    With ``longest``, words of more bytes are cut into pieces of as many. Long data
    goes through the hasher in pieces cut between words."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, table: np.ndarray, longest: int = 0):
        self.data = table[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
        self.text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
        inside = is_word[self.data]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        if longest:
            parts = -(-(self.ends - self.starts) // longest)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            self.starts, ends = np.repeat(self.starts, parts) + nth * longest, np.repeat(self.ends, parts)
            self.ends = np.minimum(self.starts + longest, ends)
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        #: number of the first word of each text, and one past the last
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = np.zeros(len(self.starts), dtype=np.uint64)
        lo = 0
        while lo < len(self.starts):
            at = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + PIECE, side="right")))
            piece = Hasher(self.data[at : self.ends[hi - 1]])
            self.hash[lo:hi] = mix(piece.of(self.starts[lo:hi] - at, self.ends[lo:hi] - at))
            lo = hi

    def prefixes(self, lengths: tuple[int, ...]) -> list[np.ndarray]:
        """For each length the hash of each word's first so many bytes (of the whole
        word if it is shorter)."""
        out = [np.zeros(len(self.starts), dtype=np.uint64) for _ in lengths]
        lo = 0
        while lo < len(self.starts):
            at = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + PIECE, side="right")))
            piece = Hasher(self.data[at : self.ends[hi - 1]])
            starts, ends = self.starts[lo:hi] - at, self.ends[lo:hi] - at
            for n, of in zip(lengths, out, strict=True):
                of[lo:hi] = mix(piece.of(starts, np.minimum(starts + n, ends)) + np.uint64(n))
            lo = hi
        return out

    def word(self, n: int) -> bytes:
        return self.data[self.starts[n] : self.ends[n]].tobytes()

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; positions whose k words are not in
        one text are in ``whole`` as False."""
        n = max(0, len(self.hash) - k + 1)
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(BASE) + self.hash[i : n + i]) if i == k - 1 else out * np.uint64(BASE) + self.hash[i : n + i]
        return out

    def whole(self, k: int) -> np.ndarray:
        n = max(0, len(self.hash) - k + 1)
        return self.text[:n] == self.text[k - 1 : n + k - 1]
