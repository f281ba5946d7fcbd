"""Order-dependent kernels on one series or one raster panel, in numpy. Nothing here knows Spark."""

from __future__ import annotations

from fractions import Fraction
from functools import cache

import numpy as np

from lacuna.plans import policy


def best_path(cost: np.ndarray, linear: float, square: float, most: int | None = None) -> np.ndarray:
    """Row of each column on the cheapest left-to-right path; a move of d rows costs linear * d + square * d**2.

    cost is rows x columns; infinite cells are forbidden. Ties go to the upper row. Columns without a finite cell split
    the path: they get -1 and the search starts anew behind them.
    """
    rows, columns = cost.shape
    step = np.abs(np.arange(rows)[:, None] - np.arange(rows)[None, :]).astype(float)
    move = linear * step + square * step**2
    if most is not None:
        move[step > most] = np.inf
    out = np.full(columns, -1)
    total, back, start = None, [], 0

    def trace(end: int) -> None:
        at = int(np.argmin(total))
        for x in range(end - 1, start - 1, -1):
            out[x] = at
            at = int(back[x - start][at])

    for x in range(columns):
        if not np.isfinite(cost[:, x]).any():
            if total is not None:
                trace(x)
            total = None
            continue
        if total is None:
            total, back, start = cost[:, x].astype(float), [np.arange(rows)], x
            continue
        reach = total[None, :] + move
        came = reach.argmin(axis=1)
        best = reach[np.arange(rows), came] + cost[:, x]
        if not np.isfinite(best).any():  # no move is allowed: a new path begins
            trace(x)
            total, back, start = cost[:, x].astype(float), [np.arange(rows)], x
            continue
        total = best
        back.append(came)
    if total is not None:
        trace(columns)
    return out


def candidate_rows(column: np.ndarray, home: int, most: int = policy.CROSSING["states"]) -> np.ndarray:
    """Rows worth tracing through in one column: home, the strongest cell, and of each run of ink its ends, its strongest cell
    and, if it is long, its thirds. Of more than `most` the strongest stay, with the outermost ones and those nearest to home.
    """
    home = min(max(home, 0), len(column) - 1)
    inked = np.concatenate([[0], (column >= policy.CROSSING["candidate"]).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inked))
    found = {home, int(column.argmax())}
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        size = end - first
        found |= {first, end - 1, first + int(column[first:end].argmax())}
        if size >= policy.CROSSING["thirds"]:
            found |= {first + size // 3, first + size * 2 // 3}
    rows = np.array(sorted(found))
    if len(rows) <= most:
        return rows
    strong = rows[np.argsort(column[rows], kind="stable")[4 - most :]]
    return np.unique(np.concatenate([strong, [rows[0], rows[-1], rows[np.abs(rows - home).argmin()], column.argmax()]]))


def connected_to(ink: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Cells of ink that 8-neighbouring cells of ink join to a seed of ink."""
    reached = ink & seeds
    while True:
        wide = np.pad(reached, 1)
        wide = wide[:-2] | wide[1:-1] | wide[2:]
        grown = ink & (wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:])
        if (grown == reached).all():
            return reached
        reached = grown


def event_support(evidence: np.ndarray, start: int, reference: np.ndarray, anchors: np.ndarray, radius: int) -> np.ndarray:
    """Cells around the events that ink joins, within the event's window, to the reference path at the window's two outer
    columns on each side; reference holds a row (as an absolute place) for each column, anchors are column numbers.
    """
    out = np.zeros(evidence.shape, bool)
    for anchor in anchors.tolist():
        left, right = max(0, anchor - radius), min(evidence.shape[1], anchor + radius + 1)
        if right - left < 3:
            continue
        ink, seeds = evidence[:, left:right] >= policy.CROSSING["connected"], np.zeros((evidence.shape[0], right - left), bool)
        for x in {left, left + 1, right - 2, right - 1}:
            y = int(reference[x]) - start
            if 0 <= y < len(seeds):
                seeds[y, x - left] = True
        out[:, left:right] |= connected_to(ink, seeds)
    return out


def crossing_path(evidence: np.ndarray, start: int, center: float, spacing: float, scale: float = 1.0, reward: float = 0.0, anchors: np.ndarray | None = None, radius: int = 0, excursion: float = 0.0, support: np.ndarray | None = None) -> np.ndarray:
    """Row (from `start` on) of each column on the cheapest path through the candidate rows, which may leave its band.

    Missing ink and the squared distance from home (in row spacings) cost; near an event distance from home earns, by its
    nearness, where `support` (all cells if none is given) allows. A move costs little, and earns `reward` for each row if the
    column's ink joins both rows with hardly a gap. Ties go to the upper row.
    """
    if min(evidence.shape) < 3:
        raise ValueError("a band needs three rows and three columns")
    if not (np.isfinite(scale) and scale > 0 and np.isfinite(reward) and reward >= 0 and radius >= 0 and excursion >= 0):
        raise ValueError("a scale must be positive, rewards and radius must not be negative")
    rule, (height, width) = policy.CROSSING, evidence.shape
    home = int(np.rint(center)) - start
    near = np.zeros(width)
    if anchors is not None and len(anchors) and radius and excursion:
        gap = np.abs(np.arange(width)[:, None] - anchors[None, :]).min(axis=1)
        near = np.where(gap <= radius, 1 - gap / (radius + 1), 0.0)
    states, back, total = [], [], None
    for x in range(width):
        rows = candidate_rows(evidence[:, x], home)
        away = np.abs((rows + start - center) / spacing)
        cost = rule["ink"] * (1 - evidence[rows, x]) + rule["home"] * away**2
        if near[x]:
            cost = cost - excursion * near[x] * away * (support[rows, x] if support is not None else 1)
        if total is None:
            total = cost
        else:
            before = states[-1]
            step = np.abs(before[:, None] - rows[None, :]).astype(float)
            move = scale * (rule["linear"] * step + rule["square"] * step**2)
            if reward:
                empty = np.concatenate([[0], np.cumsum(evidence[:, x] < rule["connected"])])
                low, high = np.minimum(before[:, None], rows[None, :]), np.maximum(before[:, None], rows[None, :])
                joined = empty[high + 1] - empty[low] <= np.maximum(rule["gap"], np.floor((high - low + 1) * rule["gap_share"]))
                move = move - reward * step * joined
            reach = total[:, None] + move
            came = reach.argmin(axis=0)
            back.append(came)
            total = reach[came, np.arange(len(rows))] + cost
        states.append(rows)
    out, at = np.empty(width, np.int64), int(total.argmin())
    for x in range(width - 1, -1, -1):
        out[x] = states[x][at]
        at = int(back[x - 1][at]) if x else at
    return out + start


def probability_path(p: np.ndarray, mask: np.ndarray, most: int = 48, around: int = 2) -> np.ndarray:
    """Path of the largest product of probabilities inside a mask, refined to the local centroid; NaN where there is none."""
    cost = np.where(mask & (p > 0), -np.log(np.maximum(p, 1e-12)), np.inf)
    rows = best_path(cost, 0.0, 0.0, most)
    out = np.full(p.shape[1], np.nan)
    for x in np.flatnonzero(rows >= 0):
        lo, hi = max(0, rows[x] - around), min(p.shape[0], rows[x] + around + 1)
        w = p[lo:hi, x] * mask[lo:hi, x]
        out[x] = (np.arange(lo, hi) * w).sum() / w.sum()
    return out


def residual_evidence(image: np.ndarray) -> np.ndarray:
    """Darkness beyond the row and column medians, smoothed over 3 x 3 and scaled to 0..1."""
    dark = image.max() - image.astype(float)
    rest = np.maximum(dark - np.maximum(np.median(dark, axis=0)[None, :], np.median(dark, axis=1)[:, None]), 0)
    padded = np.pad(rest, 1, mode="edge")
    smooth = sum(padded[i : i + rest.shape[0], j : j + rest.shape[1]] for i in range(3) for j in range(3)) / 9
    return smooth / smooth.max() if smooth.max() > 0 else smooth


def adaptive_mask(p: np.ndarray, absolute: float, share: float = 0.65) -> np.ndarray:
    """Cells that reach the smaller of an absolute level and a share of their column's maximum."""
    return p >= np.minimum(absolute, share * p.max(axis=0, keepdims=True))


def peaks(v: np.ndarray, distance: int, height: float, prominence: float) -> list[int]:
    """Local maxima by height and prominence; of two closer than `distance` the higher one stays."""
    found = []
    for i in range(1, len(v) - 1):
        if not (v[i] > v[i - 1] and v[i] >= v[i + 1] and v[i] >= height):
            continue
        sides = []
        for piece in (v[:i][::-1], v[i + 1 :]):
            over = np.flatnonzero(piece > v[i])
            sides.append(piece[: over[0]].min() if len(over) and over[0] > 0 else piece.min() if not len(over) else v[i])
        if v[i] - max(sides) >= prominence:
            found.append(i)
    kept: list[int] = []
    for i in sorted(found, key=lambda k: (-v[k], k)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def event_clusters(events: list[tuple[float, int]], tolerance: float, least: int) -> list[tuple[float, int]]:
    """(median time, distinct series) of clusters of (time, series): an event joins while it is within the tolerance of
    the running median of the cluster; clusters of fewer than `least` series are dropped.
    """
    out, held = [], []
    for t, s in sorted(events):
        if held and t - float(np.median([x for x, _ in held])) > tolerance:
            out.append(held)
            held = []
        held.append((t, s))
    if held:
        out.append(held)
    return [(float(np.median([t for t, _ in c])), len({s for _, s in c})) for c in out if len({s for _, s in c}) >= least]


def refractory(events: list[tuple[float, int]], gap: float) -> list[tuple[float, int]]:
    """Greedy choice of (time, weight) by weight, none within `gap` of a chosen one."""
    kept: list[tuple[float, int]] = []
    for t, w in sorted(events, key=lambda e: (-e[1], e[0])):
        if all(abs(t - k) > gap for k, _ in kept):
            kept.append((t, w))
    return sorted(kept)


def _affine(v: np.ndarray, scale: float, shift: int) -> np.ndarray:
    center = (len(v) - 1) / 2
    at = center + (np.arange(len(v)) - center) * scale + shift
    lo = np.floor(at).astype(int)
    ok = (at >= 0) & (at <= len(v) - 1)
    lo = np.clip(lo, 0, len(v) - 1)
    hi = np.minimum(lo + 1, len(v) - 1)
    part = at - lo
    out = np.where(part == 0, v[lo], v[lo] + (v[hi] - v[lo]) * part)
    return np.where(ok, out, np.nan)


def _error(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    d = (b - a)[~np.isnan(a) & ~np.isnan(b)]
    if len(d) < min(len(a), max(policy.MIN_SAMPLES, int(np.ceil(policy.MIN_OVERLAP * len(a))))):
        return None
    offset = float(np.median(d))
    rest = np.sort(np.abs(d - offset))[: int(np.ceil(len(d) * policy.TRIM_KEEP))]
    return offset, float(np.sqrt((rest**2).mean()))


def align(reference: np.ndarray, other: np.ndarray, radius: int = policy.ALIGN_RADIUS) -> tuple[float, int, float, float] | None:
    """(scale, shift, offset, rmse) of the first hypothesis with the smallest error; a coarse stride comes first."""
    stride = max(1, -(-len(reference) // policy.SEARCH_SAMPLES))
    best = None
    for scale in policy.ALIGN_SCALES:
        for shift in range(-radius, radius + 1):
            got = _error(reference[::stride], _affine(other, scale, shift)[::stride])
            if got and (best is None or got[1] < best[3]):
                best = (scale, shift, *got)
    if best and stride > 1:
        full = _error(reference, _affine(other, best[0], best[1]))
        best = (best[0], best[1], *full) if full else best
    return best


@cache
def _hypotheses(n: int, m: int, stride: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right neighbour, weight of the right one and validity of every inspected sample under every hypothesis."""
    center, i = (n - 1) / 2, np.arange(0, n, stride)
    scale = np.repeat(policy.ALIGN_SCALES, 2 * radius + 1)[:, None]
    shift = np.tile(np.arange(-radius, radius + 1), len(policy.ALIGN_SCALES))[:, None]
    at = center + (i[None, :] - center) * scale + shift
    lo, hi = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    ok = (lo >= 0) & (hi < m)
    return np.where(ok, lo, 0), np.where(ok, hi, 0), at - np.floor(at), ok


def _errors(reference: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median offset and trimmed error over the last axis; an infinite error where too few samples meet."""
    d = np.sort(moved - reference, axis=-1)  # missing ones come last
    n, total = np.count_nonzero(~np.isnan(d), axis=-1), d.shape[-1]
    at = lambda x, k: np.take_along_axis(x, np.maximum(k, 0)[..., None], axis=-1)[..., 0]
    offset = (at(d, (n - 1) // 2) + at(d, np.minimum(n // 2, total - 1))) / 2
    rest = np.sort(np.abs(d - offset[..., None]), axis=-1)
    keep = np.maximum(1, np.ceil(n * policy.TRIM_KEEP).astype(np.int64))
    error = np.sqrt(at(np.cumsum(rest**2, axis=-1), keep - 1) / keep)
    enough = n >= min(total, max(policy.MIN_SAMPLES, int(np.ceil(policy.MIN_OVERLAP * total))))
    return offset, np.where(enough & ~np.isnan(error), error, np.inf)


def align_many(references: np.ndarray, others: np.ndarray, radius: int = policy.ALIGN_RADIUS, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scale, shift, offset and error of each row's pair, over all hypotheses and a block of pairs at once; no match is infinite.

    `cells` bounds the samples that are compared at once.
    """
    (pairs, n), m = references.shape, others.shape[1]
    stride = max(1, -(-n // policy.SEARCH_SAMPLES))
    best, offset, error = np.zeros(pairs, np.int64), np.full(pairs, np.nan), np.full(pairs, np.inf)
    left, right, weight, ok = _hypotheses(n, m, stride, radius)
    step = max(1, cells // left.size)
    for a in range(0, pairs, step):
        v = others[a : a + step]
        moved = np.where(ok, np.where(weight == 0, v[:, left], v[:, left] * (1 - weight) + v[:, right] * weight), np.nan)
        off, err = _errors(references[a : a + step, None, ::stride], moved)
        at = err.argmin(axis=1)
        rows = np.arange(len(at))
        best[a : a + step], offset[a : a + step], error[a : a + step] = at, off[rows, at], err[rows, at]
    scale, shift = np.repeat(policy.ALIGN_SCALES, 2 * radius + 1)[best], np.tile(np.arange(-radius, radius + 1), len(policy.ALIGN_SCALES))[best]
    if stride > 1:  # the chosen hypothesis on all samples
        left, right, weight, ok = _hypotheses(n, m, 1, radius)
        for a in range(0, pairs, max(1, cells // n)):
            part = slice(a, a + max(1, cells // n))
            k, v = best[part], others[part]
            pick = lambda x: np.take_along_axis(v, x, axis=1)  # noqa: E731, B023
            moved = np.where(ok[k], np.where(weight[k] == 0, pick(left[k]), pick(left[k]) * (1 - weight[k]) + pick(right[k]) * weight[k]), np.nan)
            off, err = _errors(references[part], moved)
            better = np.isfinite(err) & np.isfinite(error[part])
            offset[part], error[part] = np.where(better, off, offset[part]), np.where(better, err, error[part])
    return scale, shift, offset, error


def exact_resample(positions: list[float], values: list[float], step: Fraction) -> list[tuple[int, float, float]]:
    """(target, value, weight of the right neighbour) at multiples of step inside monotone positions, with exact weights."""
    exact = [Fraction(p) for p in positions]
    out, k = [], 0
    if not exact:
        return out
    target = -(-exact[0] // step)
    while target * step <= exact[-1]:
        at = target * step
        while k + 1 < len(exact) and exact[k + 1] < at:
            k += 1
        right = Fraction(0) if k + 1 == len(exact) or exact[k] == at else (at - exact[k]) / (exact[k + 1] - exact[k])
        out.append((int(target), float(Fraction(values[k]) * (1 - right) + (Fraction(values[k + 1]) * right if right else 0)), float(right)))
        target += 1
    return out


def median_bounds(values: list[float | None]) -> tuple[float, float]:
    """Smallest and largest median that the missing values allow."""
    sides = [sorted(x if x is not None else fill for x in values) for fill in (-np.inf, np.inf)]
    mid = lambda s: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else float("nan")
    return mid(sides[0]), mid(sides[1])


def autocorrelation_period(v: np.ndarray, least: float = 0.18) -> float | None:
    """Lag of the first credible peak of the normalised autocorrelation, with a parabola through its neighbours."""
    z = v - v.mean()
    e = float((z * z).sum())
    top = min(48, len(v) // 8)
    if e == 0 or top < 3:
        return None
    r = np.array([(z[: len(z) - k] * z[k:]).sum() / e for k in range(1, top + 2)])
    for k in range(2, top + 1):
        a, b, c = r[k - 2], r[k - 1], r[k]
        if b >= least and b > a and b > c:
            return k + 0.5 * (a - c) / (a - 2 * b + c)
    return None


def vanishing_point(lines: np.ndarray) -> np.ndarray:
    """Smallest right singular vector of three or more lines of unit length."""
    return np.linalg.svd(lines / np.linalg.norm(lines[:, :2], axis=1, keepdims=True))[2][-1]


def seven_rows(profile: np.ndarray, peaks: np.ndarray, height: int, strongest: int = 12) -> tuple[tuple[int, ...] | None, float]:
    """Places of the seven rows among the strongest peaks of a profile, and their score.

    The score is the mean profile of the rows (as a share of its largest value), less 1.8 times the spread of the spacing by
    its median, less 4 times what the first row lies below 0.15 and the last above 0.84 of the height. At most 792 choices.
    """
    from itertools import combinations

    if len(peaks) < 7:
        return None, 0.0
    top = np.sort(peaks[np.argsort(profile[peaks], kind="stable")[-strongest:]])
    chosen = np.array(list(combinations(top.tolist(), 7)), np.int64)
    gaps = np.diff(chosen, axis=1).astype(float)
    middle = np.median(gaps, axis=1)
    edge = np.maximum(0, chosen[:, 0] / height - 0.15) + np.maximum(0, 0.84 - chosen[:, -1] / height)
    score = profile[chosen].mean(axis=1) / max(float(profile.max()), 1e-9) - 1.8 * gaps.std(axis=1) / np.where(middle > 0, middle, np.inf) - 4 * edge
    score[middle <= 0] = -np.inf
    best = int(score.argmax())
    return (tuple(chosen[best].tolist()), float(score[best])) if np.isfinite(score[best]) else (None, float("-inf"))
