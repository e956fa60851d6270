"""Edges, regions, lines, contrast and sizes of pictures against plain loops."""

import math
import random

import numpy as np
import pytest

from passplane.operators import contrast, edges, measures, regions


def picture(seed, height=23, width=31, grey=60):
    """Flat parts with sharp borders and some grain."""
    rng = np.random.default_rng(seed)
    g = np.full((height, width), grey)
    for _ in range(4):
        y, x = rng.integers(0, height - 4), rng.integers(0, width - 4)
        g[y : y + rng.integers(3, 14), x : x + rng.integers(3, 14)] = rng.integers(0, 256)
    return np.clip(g + rng.integers(-12, 13, g.shape), 0, 255)


def frame(spark, pictures, channel="g"):
    rows = [(i, y, x, int(v)) for i, g in pictures.items() for y, line in enumerate(g) for x, v in enumerate(line)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {channel} int").repartition(3)


def edges_by_hand(g, low, high):
    h, w = g.shape
    p = np.pad(g.astype(int), 1, mode="edge")
    gx, gy, m = np.zeros((h, w), int), np.zeros((h, w), int), np.zeros((h + 2, w + 2), int)
    for y in range(h):
        for x in range(w):
            n = p[y : y + 3, x : x + 3]
            gx[y, x] = n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0]
            gy[y, x] = n[2, 0] + 2 * n[2, 1] + n[2, 2] - n[0, 0] - 2 * n[0, 1] - n[0, 2]
            m[y + 1, x + 1] = abs(gx[y, x]) + abs(gy[y, x])
    weak = set()
    for y in range(h):
        for x in range(w):
            v, a, b = m[y + 1, x + 1], abs(gx[y, x]), abs(gy[y, x])
            if v <= low:
                continue
            slope = b / a if a else math.inf
            if slope < math.tan(math.pi / 8):
                ok = v > m[y + 1, x] and v >= m[y + 1, x + 2]
            elif slope > math.tan(3 * math.pi / 8):
                ok = v > m[y, x + 1] and v >= m[y + 2, x + 1]
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                ok = v > m[y, x + 1 - s] and v > m[y + 2, x + 1 + s]
            if ok:
                weak.add((y, x))
    kept = {p for p in weak if m[p[0] + 1, p[1] + 1] > high}
    todo = list(kept)
    while todo:
        y, x = todo.pop()
        for n in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
            if n in weak and n not in kept:
                kept.add(n)
                todo.append(n)
    return kept


def test_edges_by_hand(spark):
    pictures = {k: picture(k) for k in range(8)} | {90: np.zeros((1, 5), int), 91: np.full((4, 1), 9), 92: np.full((6, 6), 128)}
    found = edges.edges(frame(spark, pictures), 60, 160)
    got = {}
    for r in found.collect():
        got.setdefault(r.image_id, set()).update((r.y, x) for x in range(r.a, r.b + 1))
    want = {k: edges_by_hand(g, 60, 160) for k, g in pictures.items()}
    assert got == {k: v for k, v in want.items() if v} and len(got) == 8
    assert edges.edges(frame(spark, {}), 60, 160).count() == 0


@pytest.mark.parametrize("reach", [0, 1])
def test_labels_by_flooding(spark, reach):
    rng = np.random.default_rng(reach)
    for share in (0.2, 0.5, 0.6, 0.9):
        flags = rng.random((40, 37)) < share
        table = frame(spark, {7: flags.astype(int)}, "v").where("v = 1")
        got = {}
        for r in regions.labelled(regions.runs(table), reach).collect():
            got.setdefault(r.label, set()).update((r.y, x) for x in range(r.a, r.b + 1))
        left, want = {tuple(p) for p in np.argwhere(flags).tolist()}, []
        while left:
            todo = [left.pop()]
            own = set(todo)
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        n = (y + dy, x + dx)
                        if n in left and (reach or not (dy and dx)):
                            left.discard(n)
                            own.add(n)
                            todo.append(n)
            want.append(own)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_labels_of_a_spiral():
    """A region that winds: labels meet after many turns."""
    n = 41
    flags = np.zeros((n, n), bool)
    y = x = 0
    dy, dx, seen = 0, 1, 0
    while seen < 2:
        flags[y, x] = True
        a, b = y + 2 * dy, x + 2 * dx
        if not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= a < n and 0 <= b < n and flags[a, b]):
            dy, dx, seen = dx, -dy, seen + 1
        else:
            y, x, seen = y + dy, x + dx, 0
    edge = np.flatnonzero(np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(int).ravel()))
    runs = np.array([(k // (n + 2), a % (n + 2), b % (n + 2) - 1) for k, a, b in zip(edge[::2], edge[::2], edge[1::2], strict=True)])
    assert len(runs) > 100 and set(regions.labels_of(*runs.T, 0).tolist()) == {0}


def test_closing_by_hand(spark):
    flags = (np.random.default_rng(3).random((30, 26)) < 0.05).astype(int)
    flags[5:9, 3:20] = 1
    size = regions.sides(frame(spark, {1: flags}, "v"))
    for n in (3, 7, 25):
        found = regions.closed(frame(spark, {1: flags}, "v").join(size, "image_id"), n)
        got = np.zeros_like(flags)
        for r in found.collect():
            got[r.y, r.x] = r.v
        k = n // 2
        slide = lambda m, f: np.array([[f(m[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]) for x in range(m.shape[1])] for y in range(m.shape[0])])  # noqa: E731, B023
        assert (got == slide(slide(flags, np.max), np.min)).all()


def outline_area(flags):
    """The area of cells between four, or three, set pixels."""
    n = flags[:-1, :-1].astype(int) + flags[1:, :-1] + flags[:-1, 1:] + flags[1:, 1:]
    return (n == 4).sum() + (n == 3).sum() / 2


def test_shapes_with_holes(spark):
    ring = np.zeros((20, 24), int)
    ring[2:15, 3:20] = 1
    ring[5:9, 6:12] = 0  # a hole: belongs to the shape
    ring[12:15, 8:11] = 0  # a bay: does not
    ring[17:19, 1:3] = 1
    table = frame(spark, {4: ring}, "v").join(regions.sides(frame(spark, {4: ring}, "v")), "image_id")
    found = {(r.x, r.y, r.w, r.h): r.area for r in regions.shapes(regions.filled(table)).collect()}
    solid = ring.copy()
    solid[5:9, 6:12] = 1
    assert found == {(3, 2, 17, 13): outline_area(solid[:16]), (1, 17, 2, 2): 1.0}


def test_document_or_nothing(spark):
    plain = np.full((90, 140), 40)
    good, small, odd, near = plain.copy(), plain.copy(), plain.copy(), plain.copy()
    good[20:70, 20:120] = 200
    good[40:50, 60:70] = 40  # narrower than the closing
    small[20:30, 20:50] = 200
    odd[15:75, 15:30] = odd[15:30, 15:125] = 200
    near[5:70, 20:110] = 200  # closed up to the upper side
    got = {r.image_id: (r.x, r.y, r.w, r.h) for r in regions.document(frame(spark, {1: good, 2: small, 3: odd, 4: plain, 5: np.array([[9]]), 6: near})).collect()}
    none = (None,) * 4
    assert got == {1: (20, 20, 100, 50), 2: none, 3: none, 4: none, 5: none, 6: (20, 0, 90, 70)}


def test_lines(spark):
    g = np.full((220, 230), 20)
    g[40:44, 5:225] = 200
    g[100:104, 5:100] = g[100:104, 112:225] = 200  # a gap of 12 places
    g[150:154, 5:100] = g[150:154, 140:225] = 200  # one of 40
    r = edges.perspective(frame(spark, {1: g, 2: np.full((30, 30), 7)})).orderBy("image_id").collect()
    assert r[0].level >= 4 and r[0].upright == r[0].diagonal == 0 and r[0].score == 1 and (r[1].level, r[1].score) == (0, 0.85)
    found = edges.line_segments(edges.edges(frame(spark, {1: g}), 60, 160)).where("angle = 90")
    rows = {x.distance for x in found.collect()}
    assert rows & {39, 40} and rows & {99, 100} and not rows & set(range(146, 158))


def equalised_by_hand(g, tiles, clip):
    h, w = g.shape
    th, tw = (h // tiles, w // tiles) if h % tiles == 0 and w % tiles == 0 else ((h + tiles - h % tiles) // tiles, (w + tiles - w % tiles) // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    tables = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            limit = max(1, int(clip * th * tw / 256))
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            for k in range(rest):
                n[k * max(256 // rest, 1)] += 1
            tables[i, j] = np.minimum(255, np.floor(np.cumsum(n) * (255.0 / (th * tw)) + 0.5))
    out = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            py, px = y / th - 0.5, x / tw - 0.5
            a, b, fy, fx = math.floor(py), math.floor(px), py - math.floor(py), px - math.floor(px)
            at = lambda i, j: tables[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1), g[y, x]]  # noqa: E731, B023
            out[y, x] = math.floor((at(a, b) * (1 - fx) + at(a, b + 1) * fx) * (1 - fy) + (at(a + 1, b) * (1 - fx) + at(a + 1, b + 1) * fx) * fy + 0.5)
    return out


def test_local_contrast_by_hand(spark):
    for shape in ((32, 40), (37, 40), (45, 51)):
        g = picture(5, *shape)
        got = np.zeros_like(g)
        for r in contrast.equalised(frame(spark, {3: g})).collect():
            got[r.y, r.x] = r.g
        assert (got == equalised_by_hand(g, 8, 2.0)).all()


def test_sizes_by_overlap(spark):
    for (h, w), (nh, nw) in (((10, 12), (5, 6)), ((11, 13), (4, 5)), ((5, 4), (7, 9)), ((6, 6), (6, 6)), ((9, 3), (2, 8))):
        g = picture(2, max(h, 5), max(w, 5))[:h, :w]
        fine = np.kron(g, np.ones((nh, nw), int))
        want = np.floor(fine.reshape(nh, h, nw, w).mean((1, 3)) + 0.5).astype(int)
        got = np.full((nh, nw), -1)
        for r in contrast.resized(frame(spark, {3: g}), nw, nh, ["g"]).collect():
            got[r.y, r.x] = r.g
        assert (got == want).all()


def test_densities_of_one_border(spark):
    g = np.zeros((160, 128), int)
    g[:, 64:] = 255
    found = {r.i: r.value for r in edges.densities(frame(spark, {1: g}), 128, 160).collect()}
    assert found == {75: 160 / (128 * 160), 77: 80 / (42 * 80)}


def test_edges_and_lines_of_a_picture_are_one_task_each(spark):
    """Pixels meet once, by picture; neither they nor their votes are sorted or counted along lines by Spark."""
    rng = np.random.default_rng(5)
    pictures = {k: rng.integers(0, 256, (h, w)) for k, (h, w) in enumerate([(40, 60), (1, 30), (30, 1), (2, 2), (1, 1)])}
    found = edges.perspective(frame(spark, pictures))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert found.count() == 5
    soft = {(r.image_id, r.y, r.x): r.soft for r in measures.blurred(frame(spark, pictures), ["image_id"], 3).collect()}
    assert soft == {(k, y, x): int(v) for k, g in pictures.items() for (y, x), v in np.ndenumerate(edges.softened(g))}


def test_a_document_is_found_in_one_task_a_picture(spark):
    """No window over pixels; the whole picture's steps equal those over rows of pixels, also in pictures of a few places."""
    rng = np.random.default_rng(6)
    pictures = {k: rng.integers(0, 4, (h, w)) * 60 for k, (h, w) in enumerate([(30, 41), (9, 50), (1, 30), (30, 1), (2, 2), (1, 1)])}
    pixels = frame(spark, pictures)
    plan = regions.document(pixels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    soft = measures.blurred(pixels, ["image_id"])
    part = {r.image_id: r.threshold for r in regions.otsu(soft, "soft").collect()}
    by_row = {(r.image_id, r.y, r.x): r.soft for r in soft.collect()}
    flags = {}
    for k, g in pictures.items():
        whole = regions.softened(g, (1, 4, 6, 4, 1))
        assert regions.best_part(whole) == part[k]
        assert all(by_row[k, y, x] == v for (y, x), v in np.ndenumerate(whole))
        flags[k] = rng.integers(0, 5, g.shape) > 3
    rows = measures.sized(frame(spark, flags, "v"))
    closed = {(r.image_id, r.y, r.x): r.v for r in regions.closed(rows, 5).collect()}
    full = {(r.image_id, r.y, r.a, r.b) for r in regions.filled(rows).collect()}
    assert full == {(k, int(y), int(a), int(b)) for k, v in flags.items() for y, a, b in zip(*regions.spans(regions.without_holes(v)), strict=True)}
    assert closed == {(k, y, x): int(c) for k, v in flags.items() for (y, x), c in np.ndenumerate(regions.closed_whole(v, 5))}


def test_contrast_of_a_picture_is_one_task(spark):
    """No pixel is joined or exploded: pictures meet once, by their id."""
    plan = contrast.equalised(frame(spark, {1: picture(3)}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Aggregate" not in plan
