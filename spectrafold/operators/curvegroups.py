"""Orders of curves y^2 = x^3 + a x + b over large prime fields, from the group law instead of p rows a curve.

The order lies within 2 sqrt(p) of p + 1 and is a multiple of the order of every point; that of the twisted curve,
2 p + 2 less the order, is one of every point of the twist.  Baby and giant steps find all multiples of a point's order
in that interval by about p^(1/4) additions; points of the curve and its twist are taken until one number is left.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# below it a curve and its twist may leave two numbers, and all x are as quick
DIRECT = 1_000
LARGEST = 2**31
# curves whose points are added together
AT_ONCE = 256


def _add(p: int, a: int, left, right):
    """Sum of two points (x, y); None is the neutral one."""
    if left is None or right is None:
        return right if left is None else left
    (x, y), (u, v) = left, right
    if x == u:
        if (y + v) % p == 0:
            return None
        slope = (3 * x * x + a) * pow(2 * y, -1, p) % p
    else:
        slope = (v - y) * pow(u - x, -1, p) % p
    s = (slope * slope - x - u) % p
    return s, (slope * (x - s) - y) % p


def _times(p: int, a: int, point, k: int):
    if k < 0:
        point, k = point and (point[0], -point[1] % p), -k
    total = None
    while k:
        if k & 1:
            total = _add(p, a, total, point)
        point, k = _add(p, a, point, point), k >> 1
    return total


def _multiples(p: int, a: int, point, low: int, high: int) -> set[int] | None:
    """Every m from low to high with m * point neutral; None for points of small order, which have too many."""
    width = math.isqrt((high - low) // 2) + 1
    baby, at = {}, None
    for j in range(width + 1):
        if (at and at[0]) in baby:
            return None
        baby[at and at[0]] = j, at
        at = _add(p, a, at, point)
    stride = 2 * width + 1
    step, giant, found = _times(p, a, point, stride), _times(p, a, point, low + width), set()
    for middle in range(low + width, high + width + 1, stride):
        if (giant and giant[0]) in baby:
            j, same = baby[giant and giant[0]]
            found.add(middle - j if giant == same else middle + j)
        giant = _add(p, a, giant, step)
    return {m for m in found if m <= high}


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, exponent = np.ones_like(base), exponent.copy()
    while exponent.any():
        out = np.where(exponent & np.uint64(1), out * base % p, out)
        base, exponent = base * base % p, exponent >> np.uint64(1)
    return out


def _add_rows(x, y, u, v, a, p):
    """Sums of points (x, y) and (u, v), a column for each curve, and which curves had no neutral sum.

    All differences of a column are inverted by one inversion of their product.
    """
    two, three = np.uint64(2), np.uint64(3)
    same = (x == u) & (y == v)
    under = np.where(same, two * y, u + p - x) % p
    before, product = np.empty_like(under), np.ones_like(p)
    for i, row in enumerate(under):
        before[i] = product
        product = product * row % p
    inverse = _power(product, p - two, p)
    good = product * inverse % p == 1
    for i in range(len(under) - 1, -1, -1):
        before[i] = before[i] * inverse % p
        inverse = inverse * under[i] % p
    slope = np.where(same, three * x * x % p + a, v + p - y) % p * before % p
    s = (slope * slope + two * p - x - u) % p
    return s, (slope * ((x + p - s) % p) + p - y) % p, good


def _progression(point, step, count: int, a, p):
    """point, point + step, .. as rows x, y, and which curves met no neutral point on the way."""
    (x, y), (sx, sy) = ([z[None] for z in both] for both in (point, step))
    good = np.ones(len(p), bool)
    while len(x) < count:
        u, v, fine = _add_rows(x, y, np.broadcast_to(sx, x.shape), np.broadcast_to(sy, y.shape), a, p)
        x, y, good = np.concatenate([x, u]), np.concatenate([y, v]), good & fine
        if len(x) < count:
            sx, sy, fine = _add_rows(sx, sy, sx, sy, a, p)
            good &= fine
    return x[:count], y[:count], good


def _multiples_of_all(jobs: list[tuple]) -> list[set[int] | None]:
    """``_multiples`` of each (p, a, point, low, high), the steps of all taken together.

    A curve that meets the neutral point or one of small order on the way is done alone.
    """
    widths = [math.isqrt((high - low) // 2) + 1 for _, _, _, low, high in jobs]
    starts = [(_times(p, a, point, low + w), _times(p, a, point, 2 * w + 1)) for (p, a, point, low, _), w in zip(jobs, widths)]
    out = [None if all(s) else _multiples(*job) for job, s in zip(jobs, starts)]
    live = [k for k, s in enumerate(starts) if all(s)]
    if not live:
        return out
    column = lambda values: np.array([int(z) for z in values], np.uint64)
    p, a = column(jobs[k][0] for k in live), column(jobs[k][1] % jobs[k][0] for k in live)
    width = np.array([widths[k] for k in live])
    strides = np.array([len(range(jobs[k][3] + widths[k], jobs[k][4] + widths[k] + 1, 2 * widths[k] + 1)) for k in live])
    point = [column(jobs[k][2][c] for k in live) for c in (0, 1)]
    first, step = ([column(starts[k][n][c] for k in live) for c in (0, 1)] for n in (0, 1))
    x, y, good = _progression(point, point, int(width.max()), a, p)
    gx, gy, fine = _progression(first, step, int(strides.max()), a, p)
    # baby points of all curves in one sorted list, the curve in the upper half
    curve = np.arange(len(live), dtype=np.uint64) << np.uint64(32)
    j = np.arange(1, len(x) + 1)[:, None]
    mine = j <= width
    keys, multiple, ys = (curve + x)[mine], np.broadcast_to(j, x.shape)[mine], y[mine]
    order = np.argsort(keys)
    keys, multiple, ys = keys[order], multiple[order], ys[order]
    good &= fine
    good[(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64)] = False
    wanted = curve + gx
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hits = (keys[at] == wanted) & (np.arange(len(gx))[:, None] < strides)
    found = [set() for _ in live]
    for t, c in zip(*np.nonzero(hits)):
        low, high, w, n = *jobs[live[c]][3:], widths[live[c]], at[t, c]
        middle = low + w + int(t) * (2 * w + 1)
        m = middle - int(multiple[n]) if gy[t, c] == ys[n] else middle + int(multiple[n])
        if m <= high:
            found[c].add(m)
    for c, k in enumerate(live):
        out[k] = found[c] if good[c] else _multiples(*jobs[k])
    return out


def _direct(a: int, b: int, p: int) -> int:
    roots = [0] * p
    for y in range(p):
        roots[y * y % p] += 1
    return 1 + sum(roots[(x * x * x + a * x + b) % p] for x in range(p))


def _square_root(n: int, p: int) -> int:
    """A root of the square n modulo an odd prime p, by repeated squaring of a generator of the 2-part."""
    if p % 4 == 3:
        return pow(n, (p + 1) // 4, p)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    z = next(z for z in range(2, p) if pow(z, (p - 1) // 2, p) == p - 1)
    c, root, t = pow(z, odd, p), pow(n, (odd + 1) // 2, p), pow(n, odd, p)
    while t != 1:
        k, u = 0, t
        while u != 1:
            k, u = k + 1, u * u % p
        factor = pow(c, 1 << (twos - k - 1), p)
        c, twos = factor * factor % p, k
        root, t = root * factor % p, t * c % p
    return root


def _narrowed(a: int, b: int, p: int):
    """Asks for the multiples of points of a curve and its twist, and returns the order."""
    non_square = next(n for n in range(2, p) if pow(n, (p - 1) // 2, p) == p - 1)
    twist = a * non_square**2 % p
    rng = random.Random(f"{a},{b},{p}")
    low, high = p + 1 - math.isqrt(4 * p), p + 1 + math.isqrt(4 * p)
    left = None
    while left is None or len(left) > 1:
        x = rng.randrange(p)
        value = (x * x * x + a * x + b) % p
        if value == 0:
            continue
        if pow(value, (p - 1) // 2, p) == 1:
            found = yield p, a, (x, _square_root(value, p)), low, high
        else:
            # non_square * value is a square: a point of y^2 = x^3 + a n^2 x + b n^3
            point = (non_square * x % p, _square_root(pow(non_square, 3, p) * value % p, p))
            found = yield p, twist, point, low, high
            found = found and {2 * p + 2 - m for m in found}
        if found is not None:
            left = found if left is None else left & found
    if not left:
        raise ArithmeticError(f"no order fits; {p} is not a prime")
    return left.pop()


def curve_orders(curves: list[tuple[int, int, int]]) -> list[int | None]:
    """Number of points of each curve (a, b, p), the one at infinity included; None where the curve is singular."""
    out, asked = [None] * len(curves), {}

    def go_on(k, search, found):
        try:
            asked[k] = search, search.send(found)
        except StopIteration as done:
            out[k] = done.value

    for k, (a, b, p) in enumerate(curves):
        a, b = a % p, b % p
        if p == 2 or (4 * a * a * a + 27 * b * b) % p == 0:
            continue
        if p < DIRECT:
            out[k] = _direct(a, b, p)
        else:
            go_on(k, _narrowed(a, b, p), None)
    while asked:
        # fields of like size take steps of like number
        now = sorted(asked, key=lambda k: curves[k][2])[:AT_ONCE]
        jobs = [asked.pop(k) for k in now]
        for k, (search, _), found in zip(now, jobs, _multiples_of_all([job for _, job in jobs])):
            go_on(k, search, found)
    return out


def curve_order(a: int, b: int, p: int) -> int | None:
    """Number of points of one curve."""
    return curve_orders([(a, b, p)])[0]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        orders = curve_orders([(int(a), int(b), int(p)) for a, b, p in zip(rows["a"], rows["b"], rows["p"])])
        yield rows.assign(n_points=pd.array(orders, dtype="Int64"))


def large_curve_orders(curves: DataFrame) -> DataFrame:
    """(a, b, p, n_points) of distinct curves over prime fields with p up to 2^31; NULL for singular ones and p = 2.

    A curve costs some p^(1/4) group operations in the task that holds it, so the work grows with the curves and hardly
    with p.  Rows with a null or with p out of range or below 2 are left out; that p is a prime is not checked.
    """
    rows = curves.select(*[F.col(c).cast("long").alias(c) for c in "abp"]).where(f"a IS NOT NULL AND b IS NOT NULL AND p BETWEEN 2 AND {LARGEST}")
    # a curve is heavy beside its row, so small tables are spread, too
    parts = int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "b", "p").distinct().mapInPandas(_count, "a long, b long, p long, n_points long")
