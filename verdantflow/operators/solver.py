"""Mean-variance problems of many accounts at once, in factor form, with a bound on the distance from the optimum.

For each account: maximise w'm - gamma/2 w'Sw - cost |w - w0| with weights in [0, cap] that sum to a total and a
mean g of at least a floor; S = D + B F B'. Accounts are rows of a matrix; they share D, B, F, m and g.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_STEPS = 6000
CHECK = 20
LOWEST, HIGHEST = 0.05, 1e3


@dataclass(frozen=True)
class Market:
    """Expected value ``m`` of each candidate, loadings ``b``, covariance of factors ``f``, own variance ``d``, score ``g``."""

    m: np.ndarray
    b: np.ndarray
    f: np.ndarray
    d: np.ndarray
    g: np.ndarray

    def risk(self, w: np.ndarray) -> np.ndarray:
        """S w, by rows."""
        return w * self.d + (w @ self.b) @ self.f @ self.b.T

    def volatility(self, w: np.ndarray) -> np.ndarray:
        return np.sqrt(12 * np.maximum((w * self.risk(w)).sum(1), 0))


@dataclass(frozen=True)
class Accounts:
    """Weights held ``w0`` (a row an account), ``total`` and ``cap`` of the new ones, ``floor`` on their sum of w g (-inf: none), ``cost`` of a trade."""

    w0: np.ndarray
    total: np.ndarray
    cap: np.ndarray
    floor: np.ndarray
    cost: float

    def only(self, rows: np.ndarray) -> Accounts:
        return Accounts(self.w0[rows], self.total[rows], self.cap[rows], self.floor[rows], self.cost)


def project(v: np.ndarray, total: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Nearest weights in [0, cap] with these sums, by rows: the shift of a row is found by halving."""
    low, high = (v - cap[:, None]).min(1), v.max(1)
    for _ in range(80):
        middle = (low + high) / 2
        over = np.clip(v - middle[:, None], 0, cap[:, None]).sum(1) > total
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    return np.clip(v - high[:, None], 0, cap[:, None])


def _inverse(k: Market, gamma: np.ndarray, rho: np.ndarray):
    """v -> (gamma S + rho I)^-1 v by rows, over systems of as many unknowns as there are factors."""
    delta = gamma[:, None] * k.d + rho[:, None]
    inner = np.eye(k.f.shape[0]) + gamma[:, None, None] * (k.f @ np.einsum("nk,an,nl->akl", k.b, 1 / delta, k.b, optimize=True))
    core = np.linalg.solve(inner, gamma[:, None, None] * k.f[None])

    def apply(v: np.ndarray) -> np.ndarray:
        y = v / delta
        return y - (np.einsum("akl,al->ak", core, y @ k.b) @ k.b.T) / delta

    return apply


def certificate(k: Market, a: Accounts, gamma: np.ndarray, w: np.ndarray, price: np.ndarray, reward: np.ndarray) -> np.ndarray:
    """How far a feasible w may be below the optimum, by weak duality: any price of the total, any reward of g at least 0 bound it."""
    quadratic = gamma * (w * k.risk(w)).sum(1) / 2
    value = w @ k.m - quadratic - a.cost * np.abs(w - a.w0).sum(1)
    slope = k.m - price[:, None] + reward[:, None] * k.g - gamma[:, None] * k.risk(w)
    inside = np.minimum(a.w0, a.cap[:, None])
    best = np.minimum.reduce([a.cost * np.abs(x - a.w0) - slope * x for x in (np.zeros_like(w), inside, np.broadcast_to(a.cap[:, None], w.shape))])
    bound = quadratic - best.sum(1) + price * a.total - reward * np.where(np.isfinite(a.floor), a.floor, 0.0)
    return bound - value


def polish(k: Market, a: Accounts, gamma: np.ndarray, w: np.ndarray, reward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights with their multipliers if those at 0, at the cap or at w0 stay there: the rest solve a linear system in closed form."""
    near = 1e-6 * a.cap[:, None]
    kink = (a.cost > 0) & (np.abs(w - a.w0) <= near)
    free = (w > near) & (w < a.cap[:, None] - near) & ~kink
    held = np.where(free, 0.0, np.where(kink, a.w0, np.where(w > near, a.cap[:, None], 0.0)))
    inverse_delta = free / (gamma[:, None] * k.d)
    inner = np.eye(k.f.shape[0]) + gamma[:, None, None] * (k.f @ np.einsum("nk,an,nl->akl", k.b, inverse_delta, k.b, optimize=True))
    core = np.linalg.solve(inner, gamma[:, None, None] * k.f[None])

    def apply(v: np.ndarray) -> np.ndarray:
        y = v * inverse_delta
        return y - (np.einsum("akl,al->ak", core, y @ k.b) @ k.b.T) * inverse_delta

    p = apply(k.m - a.cost * np.sign(w - a.w0) - gamma[:, None] * k.risk(held))
    one, green = apply(np.ones_like(w)), apply(np.broadcast_to(k.g, w.shape))
    s11, s1g, sgg = np.maximum(one.sum(1), 1e-300), one @ k.g, green @ k.g
    short, low = p.sum(1) + held.sum(1) - a.total, (p + held) @ k.g - a.floor
    price, tight = short / s11, (reward > 0) & np.isfinite(a.floor)
    det = s1g * s1g - s11 * sgg
    tight &= np.abs(det) > 1e-12 * np.maximum(s11 * sgg, 1e-300)
    det, low = np.where(tight, det, 1.0), np.where(tight, low, 0.0)
    price = np.where(tight, (s1g * low - short * sgg) / det, price)
    reward = np.where(tight, (s11 * low - s1g * short) / det, 0.0)
    return p - price[:, None] * one + reward[:, None] * green + held, price, np.maximum(reward, 0)


def solve(k: Market, a: Accounts, gamma: np.ndarray, start: np.ndarray | None = None, gap: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Weights and gaps of all accounts, by alternating directions.

    One side is the quadratic with the sum and the floor on g, solved in closed form; the other the box and the
    cost of trades, weight by weight. An account stops when its gap is below ``gap``.
    """
    n_accounts, n = a.w0.shape
    floor = np.where(np.isfinite(a.floor), a.floor, -1e300)
    weights, gaps = project(a.w0 if start is None else start, a.total, a.cap), np.full(n_accounts, np.inf)
    x, u, open_ = weights.copy(), np.zeros((n_accounts, n)), np.arange(n_accounts)
    rho = np.maximum(gamma * k.d.mean(), np.abs(k.m).max() / np.maximum(a.cap, 1e-12) / 4)
    inverse = None
    for step in range(1, MOST_STEPS + 1):
        own, y = a.only(open_), gamma[open_]
        if inverse is None:
            inverse = _inverse(k, y, rho)
            one, green = inverse(np.ones((len(open_), n))), inverse(np.broadcast_to(k.g, (len(open_), n)))
            s11, s1g, sgg = one.sum(1), one @ k.g, green @ k.g
        p = inverse(k.m + rho[:, None] * (x - u))
        short, low = p.sum(1) - own.total, p @ k.g - floor[open_]
        price, reward = short / s11, np.zeros(len(open_))
        below = low - price * s1g < 0
        if below.any():
            # both hold with equality: price s11 - reward s1g = short, price s1g - reward sgg = low
            det = s1g * s1g - s11 * sgg
            det = np.where(np.abs(det) < 1e-300, -1e-300, det)
            price = np.where(below, (short * -sgg + s1g * low) / det, price)
            reward = np.where(below, (s11 * low - s1g * short) / det, reward)
        w = p - price[:, None] * one + reward[:, None] * green
        mixed = 1.6 * w - 0.6 * x
        v = mixed + u - own.w0
        new = np.clip(own.w0 + np.sign(v) * np.maximum(np.abs(v) - (own.cost / rho)[:, None], 0), 0, own.cap[:, None])
        u += mixed - new
        primal, dual = np.abs(w - new).max(1), np.abs(new - x).max(1)
        x = new
        if step % CHECK == 0 or step == MOST_STEPS:
            near = project(x, own.total, own.cap)
            found = certificate(k, own, y, near, price, np.maximum(reward, 0))
            exact, at, given = polish(k, own, y, near, np.maximum(reward, 0))
            fits = (exact >= 0).all(1) & (exact <= own.cap[:, None]).all(1) & (np.abs(exact.sum(1) - own.total) < 1e-12)
            polished = certificate(k, own, y, exact, at, given)
            better = fits & (polished < found)
            near, found = np.where(better[:, None], exact, near), np.where(better, polished, found)
            short_of = floor[open_] - near @ k.g > 1e-7 * np.maximum(1, np.abs(floor[open_]))
            weights[open_], gaps[open_] = near, np.where(short_of, np.inf, found)
            stay = (gaps[open_] > gap) if step < MOST_STEPS else np.zeros(len(open_), bool)
            if step == MOST_STEPS:
                gaps[open_] = found
            grow = np.where(primal > 4 * dual, 2.0, np.where(dual > 4 * primal, 0.5, 1.0))[stay] if step % (5 * CHECK) == 0 else np.ones(int(stay.sum()))
            if not stay.any():
                break
            if not stay.all() or (grow != 1).any():
                open_, x, u, rho, inverse = open_[stay], x[stay], u[stay] / grow[:, None], rho[stay] * grow, None
    return weights, gaps


def solve_to_volatility(k: Market, a: Accounts, target: float, near: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, aversions and gaps: the least aversion to risk (from LOWEST) at which the annual volatility is at most the target, by halving.

    Where no aversion up to HIGHEST brings it down to the target, the weights are those of HIGHEST.
    """
    n = len(a.w0)
    low, high = np.full(n, LOWEST), np.full(n, LOWEST)
    w, gaps = solve(k, a, high)
    risky = k.volatility(w) > target
    high = np.where(risky, 8.0, high)
    while (grow := risky & (high < HIGHEST)).any():
        rows = np.flatnonzero(grow)
        w[rows], gaps[rows] = solve(k, a.only(rows), high[rows], w[rows])
        settled = k.volatility(w[rows]) <= target
        if settled.all():
            break
        risky_rows = rows[~settled]
        low[risky_rows], high[risky_rows] = high[risky_rows], np.minimum(high[risky_rows] * 4, HIGHEST)
        risky = np.isin(np.arange(n), risky_rows) & (high < HIGHEST)
    rows = np.flatnonzero(high > LOWEST)
    w[rows], gaps[rows] = solve(k, a.only(rows), high[rows], w[rows]) if len(rows) else (w[rows], gaps[rows])
    for _ in range(40):
        volatility = k.volatility(w)
        rows = rows[(np.abs(volatility[rows] - target) > near) & (high[rows] - low[rows] > 1e-9 * high[rows])]
        if not len(rows):
            break
        middle = np.sqrt(low[rows] * high[rows])
        found, gap = solve(k, a.only(rows), middle, w[rows])
        over = k.volatility(found) > target
        low[rows], high[rows] = np.where(over, middle, low[rows]), np.where(over, high[rows], middle)
        fits = rows[~over]
        w[fits], gaps[fits] = found[~over], gap[~over]
        close = over & (np.abs(k.volatility(found) - target) <= near)
        w[rows[close]], gaps[rows[close]], high[rows[close]] = found[close], gap[close], middle[close]
    return w, high, gaps
