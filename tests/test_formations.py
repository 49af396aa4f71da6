"""Swing points and formations on drawn prices."""

from __future__ import annotations

import numpy as np
import pytest

from quantmere.functions import formations as L
from quantmere.operators import patterns as P


def draw(points, volume=None):
    """Bars along straight lines through (bar, price) points."""
    x, y = zip(*points, strict=True)
    close = np.interp(np.arange(x[-1] + 1), x, y)
    v = np.ones(len(close)) if volume is None else np.asarray(volume, float)
    return close + 0.1, close - 0.1, close, v


def test_extrema_at_cut_edges():
    assert L.extrema(np.array([3.0, 1, 2]), 1).tolist() == [0, 2]
    assert L.extrema(np.array([1.0, 2]), 1).tolist() == []


def test_swings_alternate():
    h, lo, _, _ = draw([(0, 100), (10, 120), (20, 100), (30, 120), (40, 100)])
    p = L.swing_points(h, lo, (3, 5))
    assert p.at.tolist() == [0, 10, 20, 30, 40] and (np.diff(p.kind) != 0).all()


@pytest.mark.parametrize(("name", "flip"), [("double_top", 1), ("double_bottom", -1)])
def test_double(name, flip):
    pts = [(0, 100), (10, 120), (20, 108), (30, 120), (40, 100)]
    h, lo, c, v = draw([(x, 220 - y if flip < 0 else y) for x, y in pts])
    found = L.scan(name, h, lo, c, v, tiers=((3, 5),), min_quality=0)
    assert [(f.start, f.end) for f in found] == [(10, 30)]
    assert found[0].direction == ("bearish" if flip > 0 else "bullish") and found[0].quality > 50


def test_peaks_apart_are_no_double_top():
    h, lo, c, v = draw([(0, 100), (10, 120), (20, 108), (30, 125), (40, 100)])
    assert not L.scan("double_top", h, lo, c, v, tiers=((3, 5),), min_quality=0)


def test_head_and_shoulders_needs_a_rise_before():
    pts = [(0, 80), (20, 110), (28, 104), (36, 120), (44, 104), (52, 110), (60, 90)]
    h, lo, c, v = draw(pts)
    found = L.scan("head_and_shoulders", h, lo, c, v, tiers=((3, 5),), min_quality=0)
    assert [(f.start, f.end) for f in found] == [(20, 52)]
    down = [(0, 140), *pts[1:]]
    assert not L.scan("head_and_shoulders", *draw(down), tiers=((3, 5),), min_quality=0)


def test_triangles():
    up = [(0, 100), (8, 120), (16, 106), (24, 120), (32, 112), (40, 120), (46, 116)]
    found = L.scan("ascending_triangle", *draw(up), tiers=((3, 5),), min_quality=0)
    assert found and found[0].direction == "bullish"
    both = [(0, 100), (8, 130), (18, 104), (28, 124), (38, 110), (48, 118), (54, 114)]
    assert L.scan("symmetrical_triangle", *draw(both), tiers=((3, 5),), min_quality=0)


def test_quality_falls_with_rising_volume():
    pts = [(0, 100), (10, 120), (20, 108), (30, 120), (40, 100)]
    falling = L.scan("double_top", *draw(pts, np.linspace(3, 1, 41)), tiers=((3, 5),), min_quality=0)[0]
    rising = L.scan("double_top", *draw(pts, np.linspace(1, 3, 41)), tiers=((3, 5),), min_quality=0)[0]
    assert falling.quality > rising.quality


def test_events_and_unknown_names(spark, bars):
    assert P.pattern_events(bars, ["double_top", "triple_bottom"], min_quality=0.0).schema.names == list(P.EVENT_COLUMNS)
    with pytest.raises(ValueError):
        P.pattern_events(bars, "cup")
    assert P.pattern_events(bars.limit(0), "double_top").count() == 0


def test_condition_is_checked():
    with pytest.raises(ValueError):
        P.Condition(direction="up")
    assert P.Condition().override(direction="bullish").direction == "bullish"
