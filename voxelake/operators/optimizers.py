"""Optimisers of a metric over a few parameters: loops on the driver, one Spark job a value.

``cost`` maps parameters to a number; each returns (parameters, cost).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

Cost = Callable[[Sequence[float]], float]
Found = tuple[tuple[float, ...], float]


def gradient_descent(cost: Cost, start: Sequence[float], rate: float = 1.0, delta: float = 1e-3, rounds: int = 50, least: float = 1e-9) -> Found:
    """Steps against the central-difference gradient; a step that does not help is halved."""
    at, best = list(start), cost(start)
    for _ in range(rounds):
        g = []
        for k in range(len(at)):
            up, down = [*at], [*at]
            up[k] += delta
            down[k] -= delta
            g.append((cost(up) - cost(down)) / (2 * delta))
        new = [a - rate * d for a, d in zip(at, g)]
        value = cost(new)
        if value < best - least:
            at, best = new, value
        else:
            rate /= 2
            if rate * max(map(abs, g), default=0) < delta:
                break
    return tuple(at), best


def amoeba(cost: Cost, start: Sequence[float], size: float = 1.0, tolerance: float = 1e-6, rounds: int = 200) -> Found:
    """Nelder and Mead's simplex."""
    n = len(start)
    points = [list(start)] + [[x + size * (k == j) for j, x in enumerate(start)] for k in range(n)]
    simplex = sorted((cost(p), p) for p in points)
    for _ in range(rounds):
        if simplex[-1][0] - simplex[0][0] < tolerance:
            break
        centre = [sum(p[j] for _, p in simplex[:-1]) / n for j in range(n)]
        worst = simplex[-1]
        move = lambda t: [c + t * (c - w) for c, w in zip(centre, worst[1])]  # noqa: B023, E731
        p = move(1.0)
        f = cost(p)
        if f < simplex[0][0]:
            q = move(2.0)
            g = cost(q)
            simplex[-1] = (g, q) if g < f else (f, p)
        elif f < simplex[-2][0]:
            simplex[-1] = (f, p)
        else:
            q = move(0.5 if f < worst[0] else -0.5)
            g = cost(q)
            if g < min(f, worst[0]):
                simplex[-1] = (g, q)
            else:
                low = simplex[0][1]
                simplex = [simplex[0], *[(cost(s), s) for s in ([(a + b) / 2 for a, b in zip(p_, low)] for _, p_ in simplex[1:])]]
        simplex.sort()
    return tuple(simplex[0][1]), simplex[0][0]


def _line(cost: Cost, at: Sequence[float], along: Sequence[float], step: float, tolerance: float) -> Found:
    """Golden-section search along a direction, after bracketing by doubling."""
    f = lambda t: cost([a + t * d for a, d in zip(at, along)])
    if f(step) > f(0):
        step = -step
    far = step
    while f(2 * far) < f(far) and abs(far) < 1e6:
        far *= 2
    low, high = sorted((-step, 2 * far))
    golden = (5**0.5 - 1) / 2
    while high - low > tolerance:
        a, b = high - golden * (high - low), low + golden * (high - low)
        if f(a) < f(b):
            high = b
        else:
            low = a
    t = (low + high) / 2
    return tuple(a + t * d for a, d in zip(at, along)), f(t)


def powell(cost: Cost, start: Sequence[float], step: float = 1.0, tolerance: float = 1e-3, rounds: int = 20) -> Found:
    """Line searches along the axes and then along what a round gained."""
    at, best = tuple(start), cost(start)
    for _ in range(rounds):
        before, value = at, best
        for k in range(len(at)):
            p, f = _line(cost, at, [float(j == k) for j in range(len(at))], step, tolerance)
            at, best = (p, f) if f < best else (at, best)
        gained = [a - b for a, b in zip(at, before)]
        if any(gained):
            p, f = _line(cost, at, gained, step, tolerance)
            at, best = (p, f) if f < best else (at, best)
        if value - best < tolerance:
            break
    return at, best


def one_plus_one(cost: Cost, start: Sequence[float], radius: float = 1.0, grow: float = 1.05, rounds: int = 100, least: float = 1e-4, seed: int = 0) -> Found:
    """(1+1) evolution: Gaussian children, the radius grows on success and shrinks on failure."""
    rng = random.Random(seed)
    at, best = list(start), cost(start)
    for _ in range(rounds):
        child = [a + rng.gauss(0, radius) for a in at]
        value = cost(child)
        if value < best:
            at, best, radius = child, value, radius * grow
        else:
            radius *= grow**-0.25
        if radius < least:
            break
    return tuple(at), best
