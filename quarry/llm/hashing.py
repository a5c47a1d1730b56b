"""Word and shingle hashes of UTF-8 text by whole-array arithmetic (64-bit, the same on every machine)."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        back = pow(int(_STEP), -1, 1 << 64)
        for name, base in (("up", int(_STEP)), ("down", back)):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-cased bytes: a hash for each word between ASCII white space, and where each begins."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = _IS_SPACE[raw]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def encoded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word between ASCII white space, A-Z lower-cased."""
    return _words(np.frombuffer(encoded(text), np.uint8))[0]


def shingle_sets(texts: list[str | None], size: int, chunk: int = 1 << 18) -> list[np.ndarray]:
    """For each text the sorted set of hashes of its ``size``-word shingles; fewer words count as one shingle, none as
    no shingle. Texts are hashed in runs of about ``chunk`` bytes; a long text is a run of its own."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    length = 0
    for text in texts:
        raw = encoded(text)
        if run and length + len(raw) > chunk:
            out += _run_sets(run, size)
            run, length = [], 0
        run.append(raw)
        length += len(raw) + 1
    return out + _run_sets(run, size)


def _run_sets(run: list[bytes], size: int) -> list[np.ndarray]:
    words, starts = _words(np.frombuffer(b" ".join(run), np.uint8))
    ends = np.cumsum([len(r) + 1 for r in run])
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    if len(words) >= size:
        rolled = np.full(len(words) - size + 1, np.uint64(size))
        for j in range(size):
            rolled += words[j : len(words) - size + 1 + j] * _PLACE[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            n = b - a
            out.append(mix(np.array([np.uint64(n) + (words[a:b] * _PLACE[:n]).sum(dtype=np.uint64)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingles(text: str | None, size: int) -> np.ndarray:
    return shingle_sets([text], size)[0]
