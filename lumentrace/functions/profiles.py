"""Small kernels on one trace's profile (a numpy array of intensities, 0 in gaps)."""

from __future__ import annotations

import numpy as np


def last_peak(p: np.ndarray) -> int:
    return len(p) - 1 - int(np.argmax(p[::-1]))


def fill_gaps(p: np.ndarray) -> np.ndarray:
    """Zeros between values become the line between them."""
    real = np.flatnonzero(p > 0)
    return p if len(real) < 2 else np.where((np.arange(len(p)) > real[0]) & (np.arange(len(p)) < real[-1]) & (p == 0), np.interp(np.arange(len(p)), real, p[real]), p)


def box_mean(p: np.ndarray, half: int) -> np.ndarray:
    """Running mean, cut off at the ends."""
    sums = np.concatenate(([0.0], np.cumsum(p, dtype=float)))
    at = np.arange(len(p))
    low, high = np.maximum(0, at - half), np.minimum(len(p), at + half + 1)
    return (sums[high] - sums[low]) / (high - low)


def median_of_three(p: np.ndarray) -> np.ndarray:
    out = p.astype(float).copy()
    if len(p) >= 3:
        out[1:-1] = np.median(np.stack([p[:-2], p[1:-1], p[2:]]), axis=0)
    return out


def covered(p: np.ndarray, share: float) -> tuple[int, int]:
    """First and last index of the stretch around the apex that holds ``share`` of the sum, growing to its greater neighbour."""
    left = right = last_peak(p)
    if share >= 1 or not len(p) or p.sum() == 0:
        return 0, len(p) - 1
    wanted, held = p.sum() * max(0.0, share), p[left]
    while held < wanted and (left > 0 or right + 1 < len(p)):
        before = p[left - 1] if left > 0 else -1.0
        after = p[right + 1] if right + 1 < len(p) else -1.0
        if before >= after:
            left, held = left - 1, held + before
        else:
            right, held = right + 1, held + after
    real = np.flatnonzero(p[left : right + 1] > 0)
    return left + int(real[0]), left + int(real[-1])


def shape_score(p: np.ndarray) -> float:
    if len(p) < 2:
        return 1.0
    rises = np.arange(len(p) - 1) < last_peak(p)
    return float(np.mean(np.where(rises, p[:-1] <= p[1:], p[:-1] >= p[1:])))


def noise_sigma(p: np.ndarray) -> float:
    """Upper median of the absolute steps, as the spread of one value."""
    steps = np.sort(np.abs(np.diff(p)))
    return float(steps[len(steps) // 2]) * 1.4826 / 2**0.5 if len(p) >= 3 else 0.0


def nearest_rank(p: np.ndarray, q: float) -> float:
    return float(np.sort(p)[int(np.floor((len(p) - 1) * q + 0.5))])


def split_points(p: np.ndarray, height_share: float = 0.1, valley_ratio: float = 0.8, sigmas: float = 3.0, min_scans: int = 3) -> list[int]:
    """Where a profile of several peaks is cut: the first lowest scan between peaks that stay apart.

    Peaks are maxima of the despiked, smoothed profile (plateaus keep all their
    scans).  The peak beside the worst notch goes, the lower of the two, until
    every notch is deep enough against its lower peak and against the noise;
    peaks of fewer than four scans at half their height within eight go too.
    """
    if len(p) < 2 * min_scans:
        return []
    calm = median_of_three(p)
    s = box_mean(calm, 2)
    least = sigmas * max(noise_sigma(calm), 1e-6)
    height = max(height_share * max(nearest_rank(s, 0.95), 1e-6), least)
    up = np.concatenate(([True], s[1:] >= s[:-1])) & np.concatenate((s[:-1] >= s[1:], [True])) & (s >= height)
    peaks = np.flatnonzero(up).tolist()
    while len(peaks) > 1:
        notches = [(s[a : b + 1].min(), max(min(s[a], s[b]), 1e-6)) for a, b in zip(peaks, peaks[1:])]
        bad = [max(v / low - valley_ratio, 0.0) + max(least - (low - v), 0.0) / least if v / low > valley_ratio or low - v < least else -1.0 for v, low in notches]
        worst = int(np.argmax(bad))
        if bad[worst] < 0:
            break
        del peaks[worst if s[peaks[worst]] <= s[peaks[worst + 1]] else worst + 1]
    peaks = [k for k in peaks if (s[max(0, k - 8) : k + 9] >= 0.5 * s[k]).sum() >= 4]
    cuts = [a + int(np.argmin(s[a : b + 1])) for a, b in zip(peaks, peaks[1:])]
    return [c for c in cuts if c >= min_scans and len(p) - c >= min_scans]


def segments(p: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of a profile's peaks: cut behind the lowest scan between two peaks at least twice as high.

    Peaks are those of the profile weighed 1, 2, 1 with its neighbours; of two
    that no cut parts the higher goes on to the next.
    """
    v = np.where(np.isfinite(p), np.maximum(p, 0.0), 0.0)
    if not len(v):
        return []
    s = (np.r_[v[:1], v[:-1]] + 2 * v + np.r_[v[1:], v[-1:]]) / 4
    top = (s > 0) & np.r_[True, s[1:] >= s[:-1]] & np.r_[s[:-1] > s[1:], True]
    cuts, held = [0], None
    for peak in np.flatnonzero(top).tolist():
        if held is None:
            held = peak
            continue
        low = held + int(np.argmin(s[held : peak + 1]))
        if 2 * s[low] <= min(s[held], s[peak]):
            cuts.append(low + 1)
            held = peak
        elif s[peak] > s[held]:
            held = peak
    return list(zip(cuts, [*cuts[1:], len(v)]))


def is_baseline(p: np.ndarray, min_scans: int = 40, factor: float = 2.0, half: int = 5) -> bool:
    """Whether a long profile does not stand out ``factor`` times above both its smoothed ends.

    The smoothing runs in place: a value is replaced before the next one reads it.
    """
    if len(p) < min_scans:
        return False
    s = p.astype(float).copy()
    for smooth in (np.median, np.mean):
        for i in range(len(s)):
            s[i] = smooth(s[max(0, i - half) : i + half + 1])
    top = float(p.max(initial=0.0))
    if top <= 0 or s[0] <= 0 or s[-1] <= 0:
        return False
    return not (top / s[0] > factor and top / s[-1] > factor)
