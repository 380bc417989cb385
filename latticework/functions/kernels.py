"""Small numpy kernels: no Spark, arrays in and out. They run inside mapInPandas and pandas UDFs."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

H, W = 512, 1024
#: Sentinel cost of a pair that may not match, and the cost from which a pair is not a match.
NO_MATCH, MATCH_LIMIT = 1e7, 10.0


# ---- selection ----------------------------------------------------------------------------------------------------


def decimate(hashes: np.ndarray, threshold: int, last: int | None = None) -> tuple[np.ndarray, int | None]:
    """Keep a frame if its Hamming distance to the last kept one is above the threshold; also the new last kept."""
    keep = np.zeros(len(hashes), bool)
    for k, h in enumerate(hashes.tolist()):
        if last is None or ((h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > threshold:
            keep[k], last = True, h
    return keep, last


# ---- boxes (x1, y1, x2, y2) ---------------------------------------------------------------------------------------


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs."""
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(hi - lo, 0, None).prod(2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def nms(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the boxes that stay; boxes come by falling score. A box goes if it overlaps a kept one by more than the threshold."""
    n = len(boxes)
    over = iou(boxes, boxes) > threshold
    keep = np.ones(n, bool)
    for k in range(n):
        if keep[k]:
            keep[k + 1 :] &= ~over[k, k + 1 :]
    return keep


#: Boxes of a group up to which many groups are suppressed together.
TOGETHER = 64


def nms_groups(boxes: np.ndarray, begins: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """`nms` of many groups: begins, the first box of each group; thresholds, groups x passes. Returns a mask per pass, boxes x passes.

    Step d compares each box of all groups with the one d places on; then the places take their turn, so the Python steps are those of one group.
    """
    n, passes = len(boxes), thresholds.shape[1]
    sizes = np.diff(np.append(begins, n))
    keep = np.ones((n, passes), bool)
    for g in np.flatnonzero(sizes > TOGETHER):
        own = slice(begins[g], begins[g] + sizes[g])
        for t in range(passes):
            keep[own, t] = nms(boxes[own], thresholds[g, t])
    group = np.repeat(np.arange(len(begins)), sizes)
    place = np.arange(n) - begins[group]
    left = np.where(sizes[group] <= TOGETHER, sizes[group] - 1 - place, 0)  # boxes after it
    lo, hi, area = boxes[:, :2], boxes[:, 2:], (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    one, two, over = [], [], []
    for d in range(1, int(left.max(initial=0)) + 1):
        a = np.flatnonzero(left >= d)
        both = np.clip(np.minimum(hi[a], hi[a + d]) - np.maximum(lo[a], lo[a + d]), 0, None).prod(1)
        union = area[a] + area[a + d] - both
        hit = np.divide(both, union, out=np.zeros_like(both), where=union > 0)[:, None] > thresholds[group[a]]
        some = hit.any(1)
        one.append(a[some])
        two.append(a[some] + d)
        over.append(hit[some])
    if not one:
        return keep
    one, two, over = np.concatenate(one), np.concatenate(two), np.concatenate(over)
    order = np.argsort(place[one], kind="stable")
    ends = np.cumsum(np.bincount(place[one]))
    for x, y in zip(np.append(0, ends[:-1]), ends):
        e = order[x:y]
        for t in range(passes):
            gone = two[e[over[e, t] & keep[one[e], t]]]
            keep[gone, t] = False
    return keep


#: Pairs of boxes that `overlapping` looks at in one step.
PAIRS = 2_000_000


def overlapping(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, cell: float, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that share a group (numbered from 0) and overlap.

    A group of at most `few` rows of a makes all its pairs; in others the boxes are dealt to the grid cells that they touch, and a pair counts in the
    cell of its common part's first corner.
    """
    many = np.bincount(group_a, minlength=int(group_b.max(initial=-1)) + 1) > few

    def dealt(boxes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on_grid = many[group][:, None]
        lo = np.where(on_grid, np.floor(boxes[:, :2] / cell), 0).astype(np.int64)
        size = np.maximum(np.where(on_grid, np.floor(boxes[:, 2:] / cell), 0).astype(np.int64) - lo, 0) + 1
        n = size.prod(1)
        row = np.repeat(np.arange(len(boxes)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, np.stack([group[row], lo[row, 0] + k % size[row, 0], lo[row, 1] + k // size[row, 0]], 1)

    if many.any():
        (row_a, cells), (row_b, cells_b) = dealt(a, group_a), dealt(b, group_b)
        key = np.unique(np.concatenate([cells, cells_b]), axis=0, return_inverse=True)[1].ravel()
        key_a, key_b = key[: len(cells)], key[len(cells) :]
    else:
        row_a, key_a, row_b, key_b = np.arange(len(a)), group_a, np.arange(len(b)), group_b
    per = np.bincount(key_b, minlength=int(key_a.max(initial=-1)) + 1)
    first, by_key = np.cumsum(per) - per, row_b[np.argsort(key_b, kind="stable")]
    n = per[key_a]
    done = np.cumsum(n)
    cuts = np.unique(np.searchsorted(done, np.arange(0, int(n.sum()) + PAIRS, PAIRS), side="right"))
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in zip(np.append(0, cuts), np.append(cuts, len(n))):
        at = np.repeat(np.arange(x, y), n[x:y])
        i, j = row_a[at], by_key[first[key_a[at]] + np.arange(len(at)) - np.repeat(done[x:y] - n[x:y] - (done[x] - n[x] if y > x else 0), n[x:y])]
        lo, hi = np.maximum(a[i, :2], b[j, :2]), np.minimum(a[i, 2:], b[j, 2:])
        good = (lo < hi).all(1)
        if many.any():
            good[good] = ~many[group_a[i[good]]] | (np.floor(lo[good] / cell) == cells[at[good], 1:]).all(1)
        one.append(i[good])
        two.append(j[good])
    return np.concatenate(one), np.concatenate(two)


def running(hit: np.ndarray, tp: int, fp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of detections by falling score, tp found and fp false ones before them: found ones so far, ranks, and the highest precision from each on."""
    found, rank = tp + np.cumsum(hit), tp + fp + np.arange(1, len(hit) + 1)
    return found, rank, np.maximum.accumulate((found / rank)[::-1])[::-1]


def fuse(boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, model: np.ndarray, models: int, threshold: float = 0.55) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted box fusion; boxes come by falling score, `model` tells where each is from. Returns fused boxes, scores, labels.

    A cluster's score is its mean score times the share of the models that are in it.
    """
    sums, weights, counts, kinds, seen, fused = [], [], [], [], [], np.zeros((0, 4))
    for b, s, c, m in zip(boxes, scores, labels, model):
        at = -1
        if len(fused):
            o = np.where(np.array(kinds) == c, iou(b[None], fused)[0], -1.0)
            k = int(o.argmax())
            at = k if o[k] > threshold else -1
        if at < 0:
            sums.append(b * s)
            weights.append(s)
            counts.append(1)
            kinds.append(c)
            seen.append({m})
            fused = np.vstack([fused, b])
        else:
            sums[at] = sums[at] + b * s
            weights[at] += s
            counts[at] += 1
            seen[at].add(m)
            fused[at] = sums[at] / weights[at]
    n = np.array(counts)
    return fused, np.array(weights) / np.maximum(n, 1) * np.minimum(models, np.array([len(x) for x in seen], int)) / models, np.array(kinds)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cheapest one-to-one assignment of a rectangular matrix (shortest augmenting paths). Costs may be whole numbers
    of any size (objects)."""
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    if 1 in cost.shape:
        k = int(cost.argmin())
        return np.array([k // cost.shape[1]]), np.array([k % cost.shape[1]])
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    first = c.argmin(1)
    if len(set(first.tolist())) == n:  # every row gets its cheapest column
        rows = np.argsort(first) if turned else np.arange(n)
        return (first[rows], rows) if turned else (rows, first)
    u, v, owner = np.zeros(n, c.dtype), np.zeros(m + 1, c.dtype), np.full(m + 1, -1)
    endless = np.inf if c.dtype != object else 2 * (n + m + 1) * int(np.abs(c).max()) + 1
    for i in range(n):
        owner[m] = i  # a column of its own starts the path
        j, best, way, done = m, np.full(m, endless, c.dtype), np.full(m, -1), np.zeros(m, bool)
        while owner[j] >= 0:
            row = owner[j]
            if j < m:
                done[j] = True
            near = c[row] - u[row] - v[:m]
            better = ~done & (near < best)
            best[better], way[better] = near[better], j
            k = int(np.where(done, endless, best).argmin())
            step = best[k]
            u[i] += step
            for d in np.flatnonzero(done):
                u[owner[d]] += step
                v[d] -= step
            best[~done] -= step
            j = k
        while j != m:
            prev = way[j]
            owner[j] = owner[prev]
            j = prev
        owner[m] = -1
    cols = np.flatnonzero(owner[:m] >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    rows, cols = rows[order], cols[order]
    return (cols, rows) if turned else (rows, cols)


def whole_numbers(x: np.ndarray) -> list[int]:
    """Doubles times the least power of two that makes all of them whole: sums and comparisons are exact."""
    part, power = np.frexp(x)
    units, power = np.ldexp(part, 53).astype(np.int64).tolist(), (power - 53).tolist()
    low = min((p for u, p in zip(units, power) if u), default=0)
    return [u << (p - low) if u else 0 for u, p in zip(units, power)]


def components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The component of each edge of a bipartite graph: its least node of side a."""
    label = np.arange(a.max(initial=-1) + 1)
    other = np.zeros(b.max(initial=-1) + 1, np.int64)
    while True:
        other[:] = len(label)
        np.minimum.at(other, b, label[a])
        new = label.copy()
        np.minimum.at(new, a, other[b])
        new = new[new]  # a label's own label is nearer to the end
        if (new == label).all():
            return label[a]
        label = new


#: Edges up to which all matchings of a component are compared at once, and such components of one step.
SMALL, AT_ONCE = 8, 4_096


def _best_of_all(a: np.ndarray, b: np.ndarray, price: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """`best_matching` of many components of equally few edges (components x edges, edges in order of a, b; whole numbers): a mask of the edges taken."""
    n_edges = a.shape[1]
    sel = np.arange(1, 1 << n_edges) >> np.arange(n_edges)[:, None] & 1
    x, y = np.triu_indices(n_edges, 1)
    clash = ((a[:, x] == a[:, y]) | (b[:, x] == b[:, y])).astype(np.int64) @ (sel[x] & sel[y]) > 0
    by_b = np.argsort(b, axis=1, kind="stable")
    step = lambda v: np.cumsum(np.diff(v, axis=1, prepend=v[:, :1]) != 0, axis=1)
    i, j = step(a), np.empty_like(b)
    np.put_along_axis(j, by_b, step(np.take_along_axis(b, by_b, 1)), 1)
    m = j.max(1, keepdims=True) + 1
    place = (j - m) * (m + 1) ** (i[:, -1:] - i)  # below 0, which is no partner
    left = ~clash
    for value in (-np.where(clash, 0, sel.sum(0)), price @ sel, -shared @ sel, place @ sel):
        value = np.where(left, value, np.iinfo(np.int64).max)
        left &= value == value.min(1, keepdims=True)
    return sel[:, left.argmax(1)].T.astype(bool)


def best_matching(a: np.ndarray, b: np.ndarray, cost: np.ndarray, overlap: np.ndarray | None) -> np.ndarray:
    """Edges (a, b) of the best matching: as many as possible, of these the cheapest, then most overlap (to nine digits), then the lowest b for the
    lowest a. Components are matched one by one, with whole numbers, so no key disturbs the one before it."""
    if not len(a):
        return np.zeros(0, np.int64)
    group = np.unique(components(a, b), return_inverse=True)[1]
    first = [np.unique(x, return_index=True)[1] for x in (a, b)]
    star = np.minimum(*(np.bincount(group[x], minlength=group.max() + 1) for x in first)) == 1  # around one a or b: one edge of it is taken
    e = np.flatnonzero(star[group])
    e = e[np.lexsort((b[e], a[e], np.zeros(len(e)) if overlap is None else -np.rint(overlap[e] * 1e9), cost[e], group[e]))]
    taken = [e[np.diff(group[e], prepend=-1) != 0]]
    order = np.flatnonzero(~star[group])
    order = order[np.lexsort((b[order], a[order], group[order]))]
    begin = np.flatnonzero(np.diff(group[order], prepend=-1) != 0)
    ends = np.append(begin[1:], len(order))
    fine, nine = cost[order] * 1024, np.zeros(len(order)) if overlap is None else np.rint(overlap[order] * 1e9)
    whole = (np.rint(fine) == fine) & (np.abs(fine) < 2**45) & (np.abs(nine) < 2**45)  # sums of these are exact
    small = (ends - begin <= SMALL) & (np.add.reduceat(~whole, begin) == 0 if len(begin) else False)
    for size in np.unique((ends - begin)[small]):
        same = begin[small & (ends - begin == size)]
        for x in range(0, len(same), AT_ONCE):
            at = same[x : x + AT_ONCE, None] + np.arange(size)
            e = order[at]
            taken.append(e[_best_of_all(a[e], b[e], fine[at].astype(np.int64), nine[at].astype(np.int64))])
    begin, ends = begin[~small], ends[~small]
    for x, y in zip(begin, ends):
        e = order[x:y]
        rows, i = np.unique(a[e], return_inverse=True)
        cols, j = np.unique(b[e], return_inverse=True)
        n, m = len(rows), len(cols)
        price = whole_numbers(cost[e])
        shared = [0] * len(e) if overlap is None else [round(float(o) * 1e9) for o in overlap[e]]
        place = [(int(q) - m) * (m + 1) ** (n - 1 - int(p)) for p, q in zip(i, j)]  # below 0, which is no partner
        room = (m + 1) ** n
        more = room * (1 + n * max(map(abs, shared)))
        most = more * (1 + n * max(map(abs, price)))
        weight = np.zeros((n, m), object)
        for p, q, c, o, t in zip(i, j, price, shared, place):
            weight[p, q] = -4 * most + 2 * more * c - room * 2 * o + t
        edge = {(p, q): k for k, p, q in zip(e.tolist(), i.tolist(), j.tolist())}
        taken.append(np.array([edge[p, q] for p, q in zip(*(z.tolist() for z in assign(weight))) if (p, q) in edge], np.int64))
    return np.concatenate(taken)


# ---- polar frames: uint8 (chi rows, q columns), 0 = no data ---------------------------------------------------------


def area_resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over the area of each target cell."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        left, right = np.arange(n), np.arange(1, n + 1)
        part = np.clip(np.minimum(edges[1:, None], right) - np.maximum(edges[:-1, None], left), 0, None)
        return part / part.sum(1, keepdims=True)

    return weights(img.shape[0], h) @ img.astype(np.float64) @ weights(img.shape[1], w).T


def valid(img: np.ndarray) -> np.ndarray:
    return np.isfinite(img) & (img != 0)


def stretch(img: np.ndarray) -> np.ndarray:
    """8-bit image between the 1st and 99th percentile of the valid pixels, in log scale if none is negative."""
    ok = valid(img)
    if ok.sum() < 16:
        return np.zeros(img.shape, np.uint8)
    x = np.where(ok, img, 0).astype(np.float64)
    if x[ok].min() >= 0:
        x = np.log1p(x)
    lo, hi = np.percentile(x[ok], [1, 99])
    x = np.clip((x - lo) / (hi - lo if hi > lo else 1.0), 0, 1) * 255
    return np.where(ok, x, 0).astype(np.uint8)


def quality(img: np.ndarray) -> tuple[float, float, float, float, bool]:
    """Share of valid pixels, share of saturated ones, mean, dynamic range, blank flag."""
    n = int((img != 0).sum())
    v = img[img != 0]
    dyn = float(v.max()) - float(v.min()) if n else 0.0
    mean = round(float(v.mean()), 2) if n else 0.0
    return round(n / img.size, 4), round(float((img >= 254).sum()) / max(n, 1), 4), mean, dyn, bool(n < 0.02 * img.size or dyn < 4)


def descriptor(img: np.ndarray, h: int = 32, w: int = 64) -> np.ndarray:
    """Z-scores of the area means (no data counts as 0) over the cells that are mostly valid, rounded to half precision."""
    ok = valid(img)
    x = np.where(ok, img, 0).astype(np.float64)
    if ok.sum() >= 16 and x[ok].min() >= 0:
        x = np.log1p(x)
    cells = area_resize(x, h, w)
    good = area_resize(ok, h, w) > 0.5
    if good.sum() < 8:
        return np.zeros(h * w, np.float32)
    sd = cells[good].std()
    z = np.where(good, (cells - cells[good].mean()) / (sd if sd >= 1e-6 else 1.0), 0)
    return z.ravel().astype(np.float16).astype(np.float32)


#: Fixed value: bits of the whole-number weights of an 8-bit reduction.
WEIGHT_BITS = 22


@lru_cache(maxsize=64)
def sinc_weights(n: int, m: int) -> np.ndarray:
    """Weights of n samples for each of m: a sinc under a sinc window of three lobes, stretched by the reduction; each row is
    normalised and rounded to whole numbers of 2**-WEIGHT_BITS, halves away from 0."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    first, last = np.maximum((centre - 3 * wide + 0.5).astype(int), 0), np.minimum((centre + 3 * wide + 0.5).astype(int), n)
    x = (np.arange(n)[None, :] - centre[:, None] + 0.5) / wide
    inside = (np.arange(n)[None, :] >= first[:, None]) & (np.arange(n)[None, :] < last[:, None]) & (np.abs(x) < 3)
    w = np.where(inside, np.sinc(x) * np.sinc(x / 3), 0.0)
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * (1 << WEIGHT_BITS) + np.where(w < 0, -0.5, 0.5))


def sinc_resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """An 8-bit image reduced along its lines, then across, with 8-bit values between; the sums are whole and exact in doubles."""
    half, unit = 1 << (WEIGHT_BITS - 1), float(1 << WEIGHT_BITS)
    out = img.astype(np.float64)
    if out.shape[1] != w:
        out = np.clip(np.floor((out @ sinc_weights(out.shape[1], w).T + half) / unit), 0, 255)
    if out.shape[0] != h:
        out = np.clip(np.floor((sinc_weights(out.shape[0], h) @ out + half) / unit), 0, 255)
    return out


def perceptual_hash(img: np.ndarray) -> int:
    """64-bit hash: low 8 x 8 block of the cosine transform of a 32 x 32 reduction against its median, first bit highest; signed."""
    small = sinc_resize(stretch(img), 32, 32)
    k = np.arange(32)
    dct = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (dct @ small @ dct.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def profiles(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log intensity per q column and per chi row, over pixels with data."""
    x, n = np.log1p(img.astype(np.float64)), img != 0

    def mean(axis: int) -> np.ndarray:
        count = n.sum(axis)
        return np.divide(x.sum(axis), count, out=np.zeros(count.shape), where=count > 0).astype(np.float16).astype(np.float32)

    return mean(0), mean(1)


def polar(img: np.ndarray, h: int = H, w: int = W) -> np.ndarray:
    """Re-grid a reciprocal frame (origin bottom left): chi from 90 degrees down to 0, q from 0 to the far corner."""
    rows, cols = img.shape
    ok = valid(img)
    x = np.where(ok, img, 0).astype(np.float64)
    chi = np.deg2rad(np.linspace(90, 0, h))[:, None]
    q = np.linspace(0, np.hypot(cols - 1, rows - 1), w)[None, :]
    px, py = q * np.cos(chi), (rows - 1) - q * np.sin(chi)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    fx, fy = px - x0, py - y0
    num, den = np.zeros((h, w)), np.zeros((h, w))
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < rows) & (xx >= 0) & (xx < cols)
            yy, xx = np.clip(yy, 0, rows - 1), np.clip(xx, 0, cols - 1)
            num += np.where(inside, wy * wx * x[yy, xx], 0)
            den += np.where(inside, wy * wx * ok[yy, xx], 0)
    return np.divide(num, den, out=np.zeros((h, w)), where=den > 0.5)


def _sampled(img: np.ndarray, px: np.ndarray, py: np.ndarray, reach: int, weight) -> np.ndarray:
    """Values at (px, py) from the pixels up to `reach` away on each axis; outside the frame is 0."""
    rows, cols = img.shape
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    out = np.zeros(px.shape)
    for dy in range(1 - reach, reach + 1):
        for dx in range(1 - reach, reach + 1):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < rows) & (xx >= 0) & (xx < cols)
            part = weight(np.abs(px - xx)) * weight(np.abs(py - yy))
            out += np.where(inside, part * img[np.clip(yy, 0, rows - 1), np.clip(xx, 0, cols - 1)], 0)
    return out


def _cubic(d: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Weight of a pixel at distance d of 0 to 2 in cubic convolution."""
    near = (a + 2) * d**3 - (a + 3) * d**2 + 1
    far = a * (d**3 - 5 * d**2 + 8 * d - 4)
    return np.where(d <= 1, near, far)


def _grid(img: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Angle from 0 to 90 degrees by row, radius from 0 to the far pixel by column; the beam centre is pixel (0, 0)."""
    return np.linspace(0, np.pi / 2, h)[:, None], np.linspace(0, np.hypot(img.shape[0] - 1, img.shape[1] - 1), w)[None, :]


def polar_cubic(img: np.ndarray, h: int = H, w: int = W) -> np.ndarray:
    """Polar re-grid for evaluation, by cubic convolution."""
    angle, r = _grid(img, h, w)
    return _sampled(img, r * np.cos(angle), r * np.sin(angle), 2, _cubic)


def quasi_polar(img: np.ndarray, h: int = H, w: int = W, ratio: float = 0.6) -> np.ndarray:
    """Polar re-grid in which a row's angle widens at small radius: angle x ratio / (1e-4 + r / rmax), at most pi; linear."""
    angle, r = _grid(img, h, w)
    angle = np.minimum(angle * ratio / (1e-4 + r / r.max()), np.pi)
    return _sampled(img, r * np.cos(angle), r * np.sin(angle), 1, lambda d: 1 - d)


def equalise_levels(levels: np.ndarray) -> np.ndarray:
    """Histogram equalisation of 8-bit levels: the lowest level in use becomes 0, the highest 255."""
    count = np.bincount(levels, minlength=256)
    first = int((count > 0).argmax())
    rest = len(levels) - count[first]
    if not rest:
        return levels
    table = np.rint((count.cumsum() - count[first]) * (np.float32(255) / np.float32(rest)))
    return table.clip(0, 255).astype(np.uint8)[levels]


def contrast(img: np.ndarray, clip: bool = True, logarithm: bool = True, equalise: bool = True, low: float = 5.0, high: float = 99.5) -> np.ndarray:
    """Clip, log, min-max and histogram equalisation of 8-bit levels over the valid pixels; invalid ones are 0."""
    ok = ~np.isnan(img) & (img != 0)
    out = np.zeros(img.shape)
    if not ok.any():
        return out
    v = img[ok].astype(np.float64)
    if clip:
        v = np.clip(v, *np.percentile(v, [low, high]))
    if logarithm:
        v = np.log10(np.abs(v) + 1e-7)
    if logarithm or equalise:
        v = (v - v.min()) / max(v.max() - v.min(), 1e-12)
    if equalise:
        v = equalise_levels((v * 255).astype(np.uint8)) / 255
    out[ok] = v
    return out


def rescale(img: np.ndarray, mode: str) -> np.ndarray:
    """Normalise the pixels other than 0: `minmax`, `meanstd` (mean +- std / 2 become 0 and 1) or `z`."""
    ok = valid(img)
    out = np.zeros(img.shape)
    if ok.any():
        v = img[ok].astype(np.float64)
        lo, hi = {"minmax": (v.min(), v.max()), "meanstd": (v.mean() - v.std() / 2, v.mean() + v.std() / 2), "z": (v.mean(), v.mean() + v.std())}[mode]
        out[ok] = (v - lo) / (hi - lo if hi - lo > 1e-12 else 1.0)
    return out


def resample_q(profile: np.ndarray, q_max: float | None, n: int = 300, top: float = 6.0) -> np.ndarray:
    """A column profile on a common q grid; an unknown range counts as 5.4, outside is 0."""
    reach = q_max if q_max is not None and np.isfinite(q_max) and q_max > 0 else 5.4
    return np.interp(np.linspace(0, top, n), np.linspace(0, reach, len(profile)), profile, left=0.0, right=0.0)


def radial_profile(img: np.ndarray, qx: np.ndarray, qz: np.ndarray, n: int = 300, top: float = 6.0) -> np.ndarray:
    """Mean log intensity by |q|; values beyond the top land in the last bin."""
    v = np.log1p(np.clip(np.nan_to_num(img), 0, None))
    ok = valid(img)
    bins = np.clip((np.hypot(qz[:, None], qx[None, :]) / top * n).astype(int), 0, n - 1)
    count = np.bincount(bins[ok], minlength=n)
    return np.divide(np.bincount(bins[ok], v[ok], n), count, out=np.zeros(n), where=count > 0)


def angular_profile(img: np.ndarray, qx: np.ndarray, qz: np.ndarray, n: int = 512) -> np.ndarray:
    """Mean log intensity by angle from the qx axis."""
    v = np.log1p(np.clip(np.nan_to_num(img), 0, None))
    ok = valid(img)
    angle = np.rad2deg(np.arctan2(np.abs(qz[:, None]), np.abs(qx[None, :]) + 1e-9))
    bins = np.clip((angle / 90 * n).astype(int), 0, n - 1)
    count = np.bincount(bins[ok], minlength=n)
    return np.divide(np.bincount(bins[ok], v[ok], n), count, out=np.zeros(n), where=count > 0)


def augment(img: np.ndarray, seed: int, version: int = 1) -> np.ndarray:
    """Physics-legal augmentation of an image in [0, 1]: no-data pixels stay 0; one seed, one result.

    Both versions flip chi with probability one half, apply a gamma and add noise; version 2 has wider ranges, an exposure factor
    and a ramp along q between two random ends.
    """
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    first = version == 1
    x = img.astype(np.float64)
    if rng.random() < 0.5:
        x = x[::-1]
    ok = x > 0
    x = np.clip(x, 1e-6, 1) ** rng.uniform(*((0.8, 1.25) if first else (0.7, 1.4)))
    if not first:
        if rng.random() < 0.7:
            x = np.clip(x * rng.uniform(0.8, 1.2), 0, 1)
        if rng.random() < 0.5:
            x = np.clip(x * np.linspace(rng.uniform(0.85, 1), rng.uniform(0.85, 1), x.shape[1])[None, :], 0, 1)
    if rng.random() < (0.5 if first else 0.7):
        x = np.clip(x + rng.normal(0, 0.02 if first else 0.03, x.shape), 0, 1)
    return np.where(ok, x, 0)


# ---- PNG -----------------------------------------------------------------------------------------------------------


def read_png(data: bytes) -> np.ndarray:
    """First channel of an 8-bit PNG without interlace. Raises ValueError on anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        raise ValueError("unsupported PNG")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
        raw = raw[: h * (1 + w * channels)].reshape(h, 1 + w * channels)
    except (zlib.error, ValueError) as e:
        raise ValueError("broken PNG") from e
    # filters work on each channel by itself, and only the first one is wanted
    return unfiltered(raw[:, 1::channels], raw[:, 0])


def unfiltered(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """One channel with its line filters undone.

    A pixel needs those to the left, above, and above left: all pixels of an anti-diagonal are known once the two before it are, so the lines are
    put side by side, each shifted by one, and a step takes one column of all lines, whatever their filters.
    """
    h, w = lines.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    if not (kinds > 2).any():
        out = np.empty((h, w), np.uint8)
        above = np.zeros(w, np.uint8)
        for y in range(h):
            line = np.cumsum(lines[y], dtype=np.uint8) if kinds[y] == 1 else lines[y]
            out[y] = above = line + above if kinds[y] == 2 else line
        return out
    steps = np.zeros((h + w - 1, h), np.int16)
    place = np.arange(w)[None, :] + np.arange(h)[:, None]
    steps[place, np.arange(h)[:, None]] = lines
    left, up, mean, paeth = ((kinds == k).astype(np.int16) for k in (1, 2, 3, 4))
    mixed, simple, nearest = bool(left.any() or up.any()), bool(mean.any()), bool(paeth.any())
    before = last = np.zeros(h + 1, np.int16)  # the line above the first is 0
    for d in range(h + w - 1):
        a, b, c = last[1:], last[:-1], before[:-1]
        guess = steps[d].copy()
        if nearest:
            to_a, to_b = b - c, a - c
            to_c = np.abs(to_a + to_b)
            to_a, to_b = np.abs(to_a), np.abs(to_b)
            guess += np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c)) * paeth
        if simple:
            guess += ((a + b) >> 1) * mean
        if mixed:
            guess += a * left + b * up
        guess &= 255
        before, last = last, np.concatenate([before[:1], guess])
        steps[d] = guess
    return steps[place, np.arange(h)[:, None]].astype(np.uint8)
