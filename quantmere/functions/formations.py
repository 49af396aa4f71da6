"""Chart formations in one asset's bars, on numpy arrays.

A bottom is a top of the mirrored market: every detector is written once for
tops on prices times a sign.  Lines are fitted from prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Tolerances and least sizes of the formations.
DOUBLE = {"tolerance": 0.015, "depth": 0.03, "bars": 5}
TRIPLE = {"tolerance": 0.02, "depth": 0.02, "bars": 10, "boundary": 0.005}
SHOULDERS = {"tolerance": 0.10, "prominence": 0.03, "bars": 8, "prior": 20}
TRIANGLE = {"flat": 0.005, "wrong_way": 0.7, "touches": 2, "bars": 8, "channel": 0.02}
SYMMETRICAL = {"slope": 0.0005, "touches": 2, "bars": 10, "channel": 0.05, "prior": 20}
ADAM = {"half_window": 5, "near": 0.015, "most": 3}
BOUNDARY = 0.005
#: formation -> (family, sign: +1 top or upper, -1 bottom or lower, least quality)
FORMATIONS = {
    "double_top": ("double", 1, 75.0),
    "double_bottom": ("double", -1, 75.0),
    "triple_top": ("triple", 1, 71.0),
    "triple_bottom": ("triple", -1, 71.0),
    "head_and_shoulders": ("shoulders", 1, 67.0),
    "inverse_head_and_shoulders": ("shoulders", -1, 68.0),
    "ascending_triangle": ("triangle", 1, 74.0),
    "descending_triangle": ("triangle", -1, 74.0),
    "symmetrical_triangle": ("symmetrical", 0, 73.0),
}
TIERS = ((3, 5, 8), (13, 21), (34, 55))


@dataclass
class Pivots:
    """Alternating swing points: bar, price and kind (+1 high, -1 low)."""

    at: np.ndarray
    price: np.ndarray
    kind: np.ndarray


@dataclass
class Line:
    first: int
    last: int
    slope: float
    intercept: float
    r2: float
    touches: int
    upper: bool

    def __call__(self, x):
        return self.slope * x + self.intercept


@dataclass
class Formation:
    name: str
    direction: str
    at: np.ndarray
    price: np.ndarray
    kind: np.ndarray
    start: int
    end: int
    entry: float
    lines: list[Line] = field(default_factory=list)
    variant: str | None = None
    quality: float = 0.0
    features: dict[str, float] = field(default_factory=dict)


def gap(a, b):
    """Relative difference of two prices against their mean size."""
    mean = (np.abs(a) + np.abs(b)) / 2
    return np.where(mean == 0, 0.0, np.abs(a - b) / np.where(mean == 0, 1, mean))


def extrema(x: np.ndarray, order: int) -> np.ndarray:
    """Bars that are at least as high as all within ``order`` bars; frames are cut at the edges."""
    n = len(x)
    if n < 2 * order + 1:
        return np.zeros(0, np.int64)
    padded = np.pad(x, order, constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(padded, 2 * order + 1).max(1)
    return np.flatnonzero(x >= top)


def swing_points(high: np.ndarray, low: np.ndarray, orders: tuple[int, ...]) -> Pivots:
    """Swing points of several orders, near repeats merged, highs and lows alternating."""
    found = [(int(i), kind, order) for order in sorted(set(orders)) for kind, x in ((1, high), (-1, -low)) for i in extrema(x, order)]
    found.sort(key=lambda p: (p[0], -p[1]))  # stable: smaller orders first
    reach = {1: high, -1: -low}  # the larger, the more extreme
    near: dict[int, list[list[int]]] = {1: [], -1: []}
    merged: list[list[int]] = []
    for i, kind, order in found:
        # the earliest kept point of this kind within two bars takes it in
        twin = next((p for p in near[kind] if abs(p[0] - i) <= 2), None)
        if twin is None:
            point = [i, kind, order]
            near[kind].append(point)
            merged.append(point)
        elif (reach[kind][i], order) > (reach[kind][twin[0]], twin[2]):
            twin[0], twin[2] = i, order
        if len(near[kind]) > 64:
            near[kind] = [p for p in near[kind] if i - p[0] <= 4]
    merged.sort(key=lambda p: p[0])
    out: list[tuple[int, int]] = []
    for i, kind, _ in merged:
        if out and out[-1][1] == kind:
            if reach[kind][i] >= reach[kind][out[-1][0]]:
                out[-1] = (i, kind)
        else:
            out.append((i, kind))
    at = np.array([i for i, _ in out], np.int64)
    kind = np.array([k for _, k in out], np.int64)
    return Pivots(at, np.where(kind > 0, high[at], low[at]) if len(at) else np.zeros(0), kind)


def fit(at: np.ndarray, price: np.ndarray, upper: bool) -> Line:
    """Least squares through swing points."""
    x, y = at.astype(float), price.astype(float)
    dx, dy = x - x.mean(), y - y.mean()
    sxx, syy, sxy = dx @ dx, dy @ dy, dx @ dy
    slope = sxy / sxx if sxx else 0.0
    r2 = 1.0 if syy == 0 else (0.0 if sxx == 0 else slope * sxy / syy)
    return Line(int(at[0]), int(at[-1]), slope, y.mean() - slope * x.mean(), min(max(r2, 0.0), 1.0), min(len(at), 255), upper)


def prior_slope(close: np.ndarray, start: int, window: int) -> float:
    y = close[max(0, start - window) : start]
    if len(y) < 3 or y.mean() == 0:
        return 0.0
    dx = np.arange(len(y)) - (len(y) - 1) / 2
    return float(dx @ (y - y.mean()) / (dx @ dx))


def _windows(p: Pivots, size: int, sign: int):
    """Indices of runs of ``size`` swing points that begin with a high (of the signed market)."""
    if len(p.at) < size:
        return np.zeros((0, size), np.int64)
    first = np.flatnonzero(p.kind[: len(p.at) - size + 1] == sign)
    return first[:, None] + np.arange(size)


def _adam_or_eve(values: np.ndarray, at: int, price: float) -> str:
    lo = max(0, at - ADAM["half_window"])
    some = values[lo : at + ADAM["half_window"] + 1]
    if price == 0 or not len(some):
        return "EVE"
    return "ADAM" if (np.abs(some - price) / abs(price) <= ADAM["near"]).sum() <= ADAM["most"] else "EVE"


def find_double(name: str, sign: int, p: Pivots, high, low, close) -> list[Formation]:
    w = _windows(p, 3, sign)
    a, b, c = (p.price[w[:, k]] for k in range(3))
    level = (a + c) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = sign * (level - b) / level
    ok = (gap(a, c) <= DOUBLE["tolerance"]) & (level != 0) & (depth >= DOUBLE["depth"]) & (p.at[w[:, 2]] - p.at[w[:, 0]] >= DOUBLE["bars"])
    out = []
    edge = high if sign > 0 else low
    for row in w[ok]:
        i, j, k = row
        strict = sign * p.price[k] <= sign * p.price[i]
        tags = [_adam_or_eve(edge, int(p.at[x]), float(p.price[x])) for x in (i, k)]
        variant = "_".join(["STRICT" if strict else "WEAK", *tags])
        line = fit(p.at[[i, k]], p.price[[i, k]], sign > 0)
        out.append(Formation(name, "bearish" if sign > 0 else "bullish", p.at[row], p.price[row], p.kind[row], int(p.at[i]), int(p.at[k]), float(p.price[j]), [line], variant))
    return out


def find_triple(name: str, sign: int, p: Pivots, high, low, close) -> list[Formation]:
    w = _windows(p, 5, sign)
    peaks = p.price[w[:, [0, 2, 4]]]
    level = peaks.mean(1) if len(w) else np.zeros(0)
    inner = sign * np.minimum(sign * p.price[w[:, 1]], sign * p.price[w[:, 3]])
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = sign * (level - inner) / level
    ok = (gap(peaks, level[:, None]) <= TRIPLE["tolerance"]).all(1) & (level != 0) & (depth >= TRIPLE["depth"]) & (p.at[w[:, 4]] - p.at[w[:, 0]] >= TRIPLE["bars"])
    edge = sign * (high if sign > 0 else low)
    out = []
    for k in np.flatnonzero(ok):
        row = w[k]
        three = row[[0, 2, 4]]
        line = fit(p.at[three], p.price[three], sign > 0)
        x = np.arange(int(p.at[row[0]]) + 1, int(p.at[row[4]]))
        if (edge[x] > sign * line(x) + TRIPLE["boundary"] * abs(level[k])).any():
            continue
        out.append(Formation(name, "bearish" if sign > 0 else "bullish", p.at[row], p.price[row], p.kind[row], int(p.at[row[0]]), int(p.at[row[4]]), float(inner[k]), [line]))
    return out


def find_shoulders(name: str, sign: int, p: Pivots, high, low, close) -> list[Formation]:
    w = _windows(p, 5, sign)
    s1, head, s2 = (p.price[w[:, k]] for k in (0, 2, 4))
    level = (s1 + s2) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = sign * (head - level) / level
    ok = (sign * head > sign * s1) & (sign * head > sign * s2) & (gap(s1, s2) <= SHOULDERS["tolerance"]) & (level != 0) & (rise >= SHOULDERS["prominence"])
    ok &= p.at[w[:, 4]] - p.at[w[:, 0]] >= SHOULDERS["bars"]
    out = []
    for row in w[ok]:
        start, end = int(p.at[row[0]]), int(p.at[row[4]])
        if sign * prior_slope(close, start, SHOULDERS["prior"]) <= 0:
            continue
        neck = fit(p.at[row[[1, 3]]], p.price[row[[1, 3]]], sign < 0)
        brow = fit(p.at[row[[0, 4]]], p.price[row[[0, 4]]], sign > 0)
        out.append(Formation(name, "bearish" if sign > 0 else "bullish", p.at[row], p.price[row], p.kind[row], start, end, float(neck(end)), [neck, brow]))
    return out


def _channel(high, low, upper: Line, lower: Line, start: int, end: int, relative: float | None, fixed: float = 0.0) -> bool:
    x = np.arange(start, end + 1)
    up, lo = upper(x), lower(x)
    width = up - lo
    slack = width * relative if relative is not None else fixed
    return bool((width > 0).all() and (high[x] <= up + slack).all() and (low[x] >= lo - slack).all())


def _apart(found: list[Formation]) -> list[Formation]:
    """Those with most points first; one that overlaps a kept one by over half of the shorter goes."""
    kept: list[Formation] = []
    for f in sorted(found, key=lambda f: -len(f.at)):
        for k in kept:
            shared, shorter = min(f.end, k.end) - max(f.start, k.start), min(f.end - f.start, k.end - k.start)
            if shared > 0 and shorter > 0 and shared / shorter > 0.5:
                break
        else:
            kept.append(f)
    return kept


@dataclass
class Spans:
    """Runs of two or more points of one kind and the others inside them, with both lines of all runs at once.

    Entry (i, j) of each array belongs to the run from the i-th to the j-th point;
    the lines come from prefix sums.
    """

    main: np.ndarray
    other: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    able: np.ndarray  # whether the run has enough points
    bars: np.ndarray
    tilt: tuple[np.ndarray, np.ndarray]  # of the main and of the other line
    at_start: tuple[np.ndarray, np.ndarray]
    at_end: tuple[np.ndarray, np.ndarray]

    def runs(self, mask: np.ndarray):
        """The points of the runs that are able and in the mask, in order."""
        for i, j in np.argwhere(self.able & mask).tolist():
            yield self.main[i : j + 1], self.other[self.lo[i] : self.hi[j]]


#: What rounding may change in sums of prices; runs within it are looked at in full.
SLACK = 1e-7


def spans(p: Pivots, main: int, least: int) -> Spans:
    m, o = np.flatnonzero(p.kind == main), np.flatnonzero(p.kind == -main)
    lo, hi = np.searchsorted(p.at[o], p.at[m], side="left"), np.searchsorted(p.at[o], p.at[m], side="right")
    k = np.arange(len(m))
    origin = p.at.mean() if len(p.at) else 0.0

    def lines(at: np.ndarray, price: np.ndarray, a: np.ndarray, b: np.ndarray):
        x = at - origin
        sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (x, price, x * x, x * price)]
        n = np.maximum(b[None, :] - a[:, None], 1)
        sx, sy, sxx, sxy = (v[b][None, :] - v[a][:, None] for v in sums)
        spread = n * sxx - sx * sx
        slope = np.where(spread > 0, (n * sxy - sx * sy) / np.where(spread > 0, spread, 1), 0.0)
        mean = sy / n
        tilt = np.where(mean != 0, slope / np.where(mean != 0, mean, 1), 0.0)
        y = lambda t: mean + slope * (t - origin - sx / n)
        return tilt, y(p.at[m][:, None]), y(p.at[m][None, :])

    own = lines(p.at[m].astype(float), p.price[m], k, k + 1)
    others = lines(p.at[o].astype(float), p.price[o], lo, hi)
    able = (k[None, :] > k[:, None]) & (hi[None, :] - lo[:, None] >= least)
    bars = p.at[m][None, :] - p.at[m][:, None] + 1
    return Spans(m, o, lo, hi, able, bars, (own[0], others[0]), (own[1], others[1]), (own[2], others[2]))


def _may_close(s: Spans, sign: int) -> np.ndarray:
    """Runs whose lines, the main one above for sign +1, may come closer without crossing."""
    a, b = (sign * (x - y) for x, y in (s.at_start, s.at_end))
    slack = SLACK * (np.abs(s.at_start[0]) + np.abs(s.at_end[0]))
    return (a > -slack) & (b > -slack) & (b < a + slack)


def _tilt(line: Line, price: np.ndarray) -> float:
    mean = price.mean()
    return line.slope / mean if mean else 0.0


def find_triangle(name: str, sign: int, p: Pivots, high, low, close) -> list[Formation]:
    """A flat side (above for sign +1) and a rising (falling) side that closes in on it."""
    out = []
    s = spans(p, sign, TRIANGLE["touches"])
    level = sign * s.tilt[0]
    may = (level >= -TRIANGLE["flat"] * TRIANGLE["wrong_way"] - SLACK) & (level <= TRIANGLE["flat"] + SLACK) & (sign * s.tilt[1] > -SLACK) & (s.bars >= TRIANGLE["bars"])
    for flat, other in s.runs(may & _may_close(s, sign)):
        side = fit(p.at[flat], p.price[flat], sign > 0)
        if not -TRIANGLE["flat"] * TRIANGLE["wrong_way"] <= sign * _tilt(side, p.price[flat]) <= TRIANGLE["flat"]:
            continue
        slope = fit(p.at[other], p.price[other], sign < 0)
        start, end = int(p.at[flat[0]]), int(p.at[flat[-1]])
        if sign * _tilt(slope, p.price[other]) <= 0 or end - start + 1 < TRIANGLE["bars"]:
            continue
        upper, lower = (side, slope) if sign > 0 else (slope, side)
        if not _closing(upper, lower, start, end) or not _channel(high, low, upper, lower, start, end, TRIANGLE["channel"]):
            continue
        both = np.sort(np.concatenate([flat, other]))
        out.append(Formation(name, "bullish" if sign > 0 else "bearish", p.at[both], p.price[both], p.kind[both], start, end, float(side(end)), [upper, lower]))
    return _apart(out)


def _closing(upper: Line, lower: Line, start: int, end: int) -> bool:
    a, b = upper(start) - lower(start), upper(end) - lower(end)
    return a > 0 and 0 < b < a


def find_symmetrical(name: str, sign: int, p: Pivots, high, low, close) -> list[Formation]:
    out = []
    s = spans(p, 1, SYMMETRICAL["touches"])
    may = (s.tilt[0] < -SYMMETRICAL["slope"] + SLACK) & (s.tilt[1] > SYMMETRICAL["slope"] - SLACK) & (s.bars >= SYMMETRICAL["bars"])
    for tops, lows in s.runs(may & _may_close(s, 1)):
        upper = fit(p.at[tops], p.price[tops], True)
        lower = fit(p.at[lows], p.price[lows], False)
        start, end = int(p.at[tops[0]]), int(p.at[tops[-1]])
        if _tilt(upper, p.price[tops]) >= -SYMMETRICAL["slope"] or _tilt(lower, p.price[lows]) <= SYMMETRICAL["slope"]:
            continue
        if end - start + 1 < SYMMETRICAL["bars"] or not _closing(upper, lower, start, end):
            continue
        slack = max(upper(start) - lower(start), 1e-6) * SYMMETRICAL["channel"]
        if not _channel(high, low, upper, lower, start, end, None, slack):
            continue
        falling = prior_slope(close, start, SYMMETRICAL["prior"]) < 0
        both = np.sort(np.concatenate([tops, lows]))
        entry = float((lower if falling else upper)(end))
        out.append(Formation(name, "bearish" if falling else "bullish", p.at[both], p.price[both], p.kind[both], start, end, entry, [upper, lower]))
    return _apart(out)


FINDERS = {"double": find_double, "triple": find_triple, "shoulders": find_shoulders, "triangle": find_triangle, "symmetrical": find_symmetrical}


def _symmetry(f: Formation) -> float:
    family, sign, _ = FORMATIONS[f.name]
    x = f.price
    if family == "double":
        return max(0.0, 100 * (1 - float(gap(x[0], x[2])) / DOUBLE["tolerance"]))
    if family == "triple":
        three = x[[0, 2, 4]]
        return max(0.0, 100 * (1 - float(gap(three, three.mean()).max()) / TRIPLE["tolerance"]))
    if family == "shoulders":
        parts = [max(0.0, 100 * (1 - float(gap(x[a], x[b])) / SHOULDERS["tolerance"])) for a, b in ((0, 4), (1, 3))]
        level = (x[0] + x[4]) / 2
        rise = sign * (x[2] - level) / abs(level) if abs(level) > np.finfo(float).eps else 0.0
        return sum(parts) / 2 * min(max((rise - 0.02) / 0.03, 0.0), 1.0)
    steps = np.diff(f.at)
    if len(f.at) < 4 or len(steps) < 2 or steps.mean() == 0:
        return 50.0
    return max(0.0, 100 * (1 - float(steps.std() / steps.mean())))


def _volume(f: Formation, volume: np.ndarray) -> float:
    v = volume[f.start : f.end + 1]
    if f.end <= f.start or f.end >= len(volume) or len(v) < 4:
        return 50.0
    a, b = v[: len(v) // 2].mean(), v[len(v) // 2 :].mean()
    return 50.0 if a == 0 else 100 * min(max(1.5 - b / a, 0.0), 1.0)


def _line_score(f: Formation, high: np.ndarray, low: np.ndarray) -> float:
    def one(line: Line) -> float:
        if line.touches >= 3:
            return line.r2
        if line.touches < 2:
            return 0.5
        last = min(line.last, len(high) - 1)
        if last <= line.first:
            return 0.0
        x = np.arange(line.first, last + 1)
        y = line(x)
        slack = BOUNDARY * np.abs(y)
        return float((high[x] <= y + slack).mean() if line.upper else (low[x] >= y - slack).mean())

    return min(max(100 * sum(map(one, f.lines)) / len(f.lines), 0.0), 100.0) if f.lines else 50.0


def _completeness(f: Formation) -> float:
    bars = f.end - f.start + 1
    length = 100.0 if bars >= 10 else max(0.0, (bars - 5) * 10.0)
    touches = sum(line.touches for line in f.lines)
    touch = 30.0 if touches <= 2 else 60.0 if touches <= 4 else min(100.0, 60.0 + 10 * (touches - 4))
    return (length + touch) / 2


def rate(f: Formation, high: np.ndarray, low: np.ndarray, volume: np.ndarray) -> Formation:
    """Quality 0-100: weighted parts, damped for poor symmetry and short formations."""
    parts = {"symmetry": _symmetry(f), "volume": _volume(f, volume), "trendline_r2": _line_score(f, high, low), "completeness": _completeness(f)}
    whole = sum(w * parts[k] for k, w in (("symmetry", 0.30), ("volume", 0.25), ("trendline_r2", 0.25), ("completeness", 0.20)))
    bars = f.end - f.start + 1
    whole *= min(max(parts["symmetry"] / 10, 0.1), 1.0) * (min(max((bars - 4) / 6, 0.0), 1.0) if bars < 10 else 1.0)
    f.quality = min(max(float(np.floor(whole + 0.5)), 0.0), 100.0)
    f.features = {k: v / 100 for k, v in parts.items()}
    return f


def scan(name: str, high, low, close, volume, *, tiers: tuple[tuple[int, ...], ...] = TIERS, min_quality: float | None = None) -> list[Formation]:
    """Formations of one name over all tiers of swing orders; the best for each (start, end)."""
    if name not in FORMATIONS:
        raise ValueError(f"unknown formation {name!r}; known are {', '.join(FORMATIONS)}")
    family, sign, least = FORMATIONS[name]
    least = least if min_quality is None else min_quality
    best: dict[tuple[int, int], Formation] = {}
    for orders in tiers:
        for f in FINDERS[family](name, sign, swing_points(high, low, orders), high, low, close):
            rate(f, high, low, volume)
            at = (f.start, f.end)
            if f.quality >= least and (at not in best or f.quality > best[at].quality):
                best[at] = f
    return [best[k] for k in sorted(best)]
