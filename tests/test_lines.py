"""Cutting of lines into pieces."""

import math

import pytest

from streamwatch.operators import linear

BOX = (-1.0, -1.0, 650.0, 650.0)


def cut(spark, lines, box=BOX, rules=linear.PieceRules()):  # noqa: B008
    rows = [(k, i, None if p is None else float(p[0]), None if p is None else float(p[1])) for k, ps in lines.items() for i, p in enumerate(ps)]
    points = spark.createDataFrame(rows, "way_id string, pos int, x double, y double")
    return {(r.way_id, r.piece): r for r in linear.cut_lines(points, ["way_id"], box, rules).collect()}


def test_pieces_of_a_corner(spark):
    got = cut(spark, {"corner": [(0, 0), (300, 0), (300, 0), None, (300, 450)]})
    assert sorted(got) == [("corner", 0), ("corner", 1)]
    a, b = got["corner", 0], got["corner", 1]
    assert a.length == b.length == 375 and (a.n_pieces, a.flag) == (2, None)
    assert [tuple(p) for p in a.line] == [(0, 0), (300, 0), (300, 75)] and [tuple(p) for p in b.line] == [(300, 75), (300, 450)]
    assert (a.mid_x, a.mid_y, b.mid_x, b.mid_y) == (187.5, 0, 300, 262.5) and a.inside and b.inside


def test_ends_meet_and_lengths_sum(spark):
    line = [(40 * i, 90 * math.sin(i)) for i in range(60)]
    total = sum(math.dist(p, q) for p, q in zip(line, line[1:], strict=False))
    got = cut(spark, {"long": line})
    n = len(got)
    assert n == round(total / 350) and {r.n_pieces for r in got.values()} == {n}
    assert sum(r.length for r in got.values()) == pytest.approx(total)
    for k in range(n):
        r = got["long", k]
        assert r.length == pytest.approx(total / n) and sum(math.dist(p, q) for p, q in zip(r.line, r.line[1:], strict=False)) == pytest.approx(total / n)
        if k:
            assert tuple(r.line[0]) == pytest.approx(tuple(got["long", k - 1].line[-1]))
        assert r.inside == (-1 < r.mid_x < 650 and -1 < r.mid_y < 650)
    assert {r.inside for r in got.values()} == {True, False}


def test_short_lines_single_points_and_counts(spark):
    got = cut(spark, {"short": [(0, 0), (150, 0)], "dot": [(1, 1), (1, 1)], "one": [(5, 5)], "edge": [(0, 0), (500, 0)], "over": [(0, 0), (510, 0)]})
    assert {k: r.flag for k, r in got.items()} == {("short", 0): "SHORT_LINK", ("edge", 0): None, ("over", 0): None, ("over", 1): None}
    narrow = cut(spark, {"a": [(0, 0), (510, 0)]}, rules=linear.PieceRules(260, 256, 500))
    assert len(narrow) == 1  # two pieces would be under the least length
    with pytest.raises(ValueError):
        linear.PieceRules(100, 200, 500)


def test_line_across_a_square_has_its_length(spark):
    from pyspark.sql import functions as F

    from streamwatch.operators import spatial

    segments = spark.createDataFrame([(-500.0, 50.0, 500.0, 50.0), (20.0, -80.0, 20.0, 50.0), (7.0, 7.0, 7.0, 7.0)], "x1 double, y1 double, x2 double, y2 double")
    square = lambda x, y: [(x, y), (x + 100.0, y), (x + 100.0, y + 100.0), (x, y + 100.0)]
    zones = spark.createDataFrame([("both", square(0.0, 0.0), 0.01), ("none", square(0.0, 300.0), 0.01), ("no area", square(200.0, 0.0), None), ("zero", square(-300.0, 0.0), 0.0)], "zone_id string, ring array<struct<x:double,y:double>>, area_km2 double")
    got = {r.zone_id: r for r in spatial.line_density(segments, zones, 64.0, 5.0).collect()}
    assert got["both"].length_m == pytest.approx(150) and got["both"].density == pytest.approx(15) and got["both"].flag is None
    assert (got["none"].length_m, got["none"].density, got["none"].flag) == (0.0, 0.0, None)
    assert got["no area"].length_m == pytest.approx(100) and got["no area"].density is None and got["no area"].flag == got["zero"].flag == "NO_AREA"
    assert spatial.line_density(segments.filter(F.lit(False)), zones, 64.0, 5.0).agg(F.sum("length_m")).first()[0] == 0
