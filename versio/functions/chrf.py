"""chrF maths: per-segment character n-gram statistics and the corpus score.

Definition (chrF, Popovic 2015; the common implementation's defaults):
character order 6, word order 0, beta 2, case kept, whitespace removed before
n-grams, no epsilon smoothing.

* Per segment and order n: ``n_hyp`` hypothesis n-grams, ``n_ref`` reference
  n-grams, ``n_match`` = sum over distinct grams of min(hyp count, ref count).
  ``n_hyp`` is 0 when the reference has no n-gram of that order.
* Corpus: the three integers per order are summed over segments;
  ``P_n = match/hyp``, ``R_n = match/ref`` are averaged over the orders where
  both sums are > 0; ``score = 100 (1+b^2) P R / (b^2 P + R)``; 0 if undefined.

``segment_stats`` counts n-grams exactly with numpy: code points are mapped to
a dense alphabet of the segment pair; every position's 6-gram is packed into
one int64 and the two sides are sorted together once -- shorter orders are
prefixes, contiguous in that order. Alphabets too large to pack fall back to
one sort per order (raw-byte comparison when even one gram cannot be packed).
``batch_stats`` does the same for many segments with a single sort.
"""

from __future__ import annotations

import numpy as np

CHAR_ORDER = 6
BETA = 2.0


def _codepoints(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _gram_keys(idx: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    m = len(idx) - n + 1
    if alphabet ** n < (1 << 62):
        key = idx[:m].astype(np.int64)
        for j in range(1, n):
            key = key * alphabet + idx[j:j + m]
        return key
    win = np.lib.stride_tricks.sliding_window_view(idx.astype(np.int32), n)
    return np.ascontiguousarray(win).view(np.dtype((np.void, 4 * n))).ravel()


def _packed_keys(digits: np.ndarray, bits: int, order: int) -> np.ndarray:
    """Per position, the next ``order`` digits packed ``bits`` bits each (0-padded at the end)."""
    n = len(digits)
    padded = np.concatenate([digits, np.zeros(order - 1, dtype=np.int64)])
    key = padded[:n].copy()
    for j in range(1, order):
        key = (key << bits) | padded[j:j + n]
    return key


def segment_stats(hyp: str | None, ref: str | None, order: int = CHAR_ORDER) -> list[int]:
    """``[n_hyp, n_ref, n_match] * order`` for one segment; inputs have no whitespace."""
    h = _codepoints(hyp or "")
    r = _codepoints(ref or "")
    if not (len(h) and len(r)):
        out: list[int] = []
        for n in range(1, order + 1):
            nr = max(len(r) - n + 1, 0)
            out += [0, nr, 0]
        return out
    both = np.concatenate([h, r])
    uniq = np.unique(both)
    inv = np.searchsorted(uniq, both).astype(np.int64)
    bits = len(uniq).bit_length()          # digits 1..V fit in ``bits`` bits
    if bits * order <= 62:
        return _stats_one_sort(inv[:len(h)] + 1, inv[len(h):] + 1, bits, order)
    return _stats_per_order(inv[:len(h)], inv[len(h):], len(uniq), order)


def _stats_one_sort(hd: np.ndarray, rd: np.ndarray, bits: int, order: int) -> list[int]:
    """One sort of every position's ``order``-gram (side in the low bit).

    Lexicographic order keeps every shorter prefix contiguous, so each order's
    gram counts are a linear pass over the same sorted keys. Digits are 1..V;
    the 0 padding marks grams that run past the end of their side.
    """
    keys = np.concatenate([_packed_keys(hd, bits, order) << 1, (_packed_keys(rd, bits, order) << 1) | 1])
    keys.sort()
    side = keys & 1
    full = keys >> 1
    mask = (1 << bits) - 1
    out: list[int] = []
    for n in range(1, order + 1):
        nh = max(len(hd) - n + 1, 0)
        nr = max(len(rd) - n + 1, 0)
        if nr == 0:
            out += [0, 0, 0]
            continue
        if nh == 0:
            out += [0, nr, 0]
            continue
        prefix = full >> (bits * (order - n))
        valid = (prefix & mask) != 0
        p = prefix[valid]
        sv = side[valid]
        change = np.empty(len(p), dtype=bool)
        change[0] = True
        np.not_equal(p[1:], p[:-1], out=change[1:])
        starts = np.flatnonzero(change)
        ref_cnt = np.add.reduceat(sv, starts)
        tot = np.diff(np.append(starts, len(p)))
        out += [nh, nr, int(np.minimum(tot - ref_cnt, ref_cnt).sum())]
    return out


def _stats_per_order(hi: np.ndarray, ri: np.ndarray, alphabet: int, order: int) -> list[int]:
    """Large alphabets: one sort per order over packed or byte-compared grams."""
    out: list[int] = []
    for n in range(1, order + 1):
        nh = max(len(hi) - n + 1, 0)
        nr = max(len(ri) - n + 1, 0)
        if nr == 0:
            out += [0, 0, 0]
            continue
        if nh == 0:
            out += [0, nr, 0]
            continue
        uniq, inv = np.unique(np.concatenate([_gram_keys(hi, n, alphabet), _gram_keys(ri, n, alphabet)]),
                              return_inverse=True)
        inv = inv.ravel()
        hc = np.bincount(inv[:nh], minlength=len(uniq))
        rc = np.bincount(inv[nh:], minlength=len(uniq))
        out += [nh, nr, int(np.minimum(hc, rc).sum())]
    return out


#: Whether a code point is whitespace (the last place: all code points from there on).
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end without whitespace, a gap after each, and the places of the gaps."""
    gaps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = _SPACE.take(points, mode="clip")
    return points[~space], gaps - np.searchsorted(np.flatnonzero(space), gaps)


def _digits(points: np.ndarray, gaps: np.ndarray, room: int) -> tuple[np.ndarray, int] | None:
    """Every character as a digit of ``bits`` bits, and ``bits``: from one alphabet for all segments if ``CHAR_ORDER``
    such digits fit in ``room`` bits, else from one per segment; None if those do not fit either. The gaps behind
    hypotheses are 0, those behind references the largest digit, and no character is either."""
    top = int(points.max())
    if top < 4 * len(points):
        present = np.zeros(top + 1, bool)
        present[points] = True
        code = np.cumsum(present, dtype=np.int32)
        most, digit = int(code[-1]), code[points]
    else:
        ranked = np.unique(points)
        most, digit = len(ranked), np.searchsorted(ranked, points) + 1
    if (most + 1).bit_length() * CHAR_ORDER > room:
        segment = np.repeat(np.arange(len(gaps) // 2), np.diff(gaps[1::2], prepend=-1))
        own = segment << 21 | points
        ranked = np.unique(own)
        first = np.searchsorted(ranked, np.arange(len(gaps) // 2) << 21)
        most, digit = int(np.diff(np.append(first, len(ranked))).max()), np.searchsorted(ranked, own) - first[segment] + 1
    bits = (most + 1).bit_length()
    if bits * CHAR_ORDER > room:
        return None
    digit[gaps[::2]], digit[gaps[1::2]] = 0, (1 << bits) - 1
    return digit, bits


def _grams(padded: np.ndarray, bits: int, order: int) -> np.ndarray:
    """Every ``order`` neighbouring digits in one integer."""
    if order == 1:
        return padded
    short = order // 2
    left = _grams(padded, bits, order - short)
    right = left if order == 2 * short else _grams(padded, bits, short)
    kind = np.int32 if bits * order < 32 else np.int64
    out = left[: len(padded) - order + 1].astype(kind)
    out <<= bits * short
    out |= right[order - short :][: len(out)]
    return out


def batch_stats(hyps: list[str], refs: list[str], order: int = CHAR_ORDER) -> np.ndarray:
    """``segment_stats`` of many segments at once, less whitespace: a row of ``3 * order`` integers for each (hypothesis,
    reference).

    All sides of all segments are laid end to end; every position's ``order``-gram is packed into one int64 with its
    side in the lowest bit, and each segment's are sorted. What two neighbours differ in says from which order on they
    are different grams, so the grams of every order are runs between such places, and a running count of the
    references' keys says how many of a run are theirs; each order looks only at the places of the next longer one.
    Grams over a side's end hold a gap that the other side has not, so they match nothing. Segments whose alphabets
    are too large to pack are counted one by one.
    """
    n = len(hyps)
    out = np.zeros((n, order, 3), np.int64)
    if not n:
        return out.reshape(0, 3 * order)
    points, gaps = _points([x for pair in zip(hyps, refs, strict=True) for x in pair])
    made = _digits(points, gaps, 62)
    if made is None:
        one = ["".join(x.split()) for x in hyps], ["".join(x.split()) for x in refs]
        return np.array([segment_stats(h, r, order) for h, r in zip(*one, strict=True)])
    sides = np.concatenate([[-1], gaps])
    lengths = (sides[1:] - sides[:-1] - 1).reshape(n, 2)
    grams = np.maximum(lengths[:, :, None] - np.arange(order)[None, None, :], 0)
    out[:, :, 1] = grams[:, 1]
    out[:, :, 0] = np.where(grams[:, 1] > 0, grams[:, 0], 0)
    digit, bits = made
    key = _grams(np.concatenate([digit, np.zeros(order - 1, digit.dtype)]).astype(np.int32), bits, order).astype(np.int64)
    key <<= 1
    ends = gaps.tolist()
    a = 0
    for middle, end in zip(ends[::2], ends[1::2], strict=True):
        key[middle + 1 : end + 1] |= 1
        key[a : end + 1].sort()
        a = end + 1
    sizes = lengths.sum(1) + 2
    segment = sides[:-1:2] + 1
    surplus = np.zeros(len(key) + 1, np.int32)  # of the references' keys over the hypotheses' before each place
    np.cumsum((key & 1).astype(np.int8) * 2 - 1, dtype=np.int32, out=surplus[1:])
    differ = key[1:] ^ key[:-1]
    level = np.full(len(key) + 1, order, np.uint8)  # how many orders see a new gram at a place; all do where a segment begins
    level[1:-1] = differ >= 2
    for k in range(1, order):
        level[1:-1] += differ >= 2 << bits * k
    level[segment] = order
    for k in range(order - 1, -1, -1):
        new = np.flatnonzero(level >= order - k)
        surplus, level, segment = surplus.take(new), level.take(new), np.searchsorted(new, segment)
        out[:, k, 2] = sizes - np.add.reduceat(np.abs(surplus[1:] - surplus[:-1]), segment) >> 1
    return out.reshape(n, 3 * order)


def corpus_score(stats: list[int], order: int = CHAR_ORDER, beta: float = BETA) -> float:
    """Score from summed statistics (Python reference for the Column form)."""
    sp = sr = 0.0
    eff = 0
    for n in range(order):
        nh, nr, nm = stats[3 * n: 3 * n + 3]
        if nh > 0 and nr > 0:
            sp += nm / nh
            sr += nm / nr
            eff += 1
    if eff == 0:
        return 0.0
    p, r = sp / eff, sr / eff
    f = beta * beta
    if p + r == 0:
        return 0.0
    return 100.0 * (1 + f) * p * r / (f * p + r)


def stat_names(order: int = CHAR_ORDER) -> list[str]:
    names = []
    for n in range(1, order + 1):
        names += [f"hyp{n}", f"ref{n}", f"match{n}"]
    return names
