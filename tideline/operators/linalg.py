"""Small dense linear algebra, chi-square and normal quantiles."""

from __future__ import annotations

import math

import numpy as np


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: halve until the norm is at most a half, Pade of order 6, square back."""
    a = np.asarray(a, float)
    norm = np.abs(a).sum(1).max(initial=0.0)
    halvings = max(0, math.ceil(math.log2(norm / 0.5))) if norm > 0.5 else 0
    x = a / 2.0**halvings
    up, down, power, c, order = np.eye(len(a)), np.eye(len(a)), np.eye(len(a)), 1.0, 6
    for k in range(1, order + 1):
        c *= (order - k + 1) / (k * (2 * order - k + 1))
        power = power @ x
        up, down = up + c * power, down + (-1) ** k * c * power
    out = np.linalg.solve(down, up)
    for _ in range(halvings):
        out = out @ out
    return out


def van_loan(a, g, qc, dt: float, drift=None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """F, Q and the control of dx = (A x + drift) dt + G dW over dt, with noise of intensity Qc."""
    a, g, qc = (np.atleast_2d(np.asarray(m, float)) for m in (a, g, qc))
    n = len(a)
    block = np.zeros((2 * n, 2 * n))
    block[:n, :n], block[:n, n:], block[n:, n:] = -a, g @ qc @ g.T, a.T
    done = expm(block * dt)
    f = done[n:, n:].T
    q = f @ done[:n, n:]
    u = None
    if drift is not None:
        wide = np.zeros((n + 1, n + 1))
        wide[:n, :n], wide[:n, n] = a, drift
        u = expm(wide * dt)[:n, n]
    return f, (q + q.T) / 2, u


def symmetric(p: np.ndarray) -> np.ndarray:
    return (p + p.T) / 2


def is_positive_definite(p: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(p)
    except np.linalg.LinAlgError:
        return False
    return True


def cholesky_semidefinite(p: np.ndarray) -> np.ndarray:
    """Lower L with L L^T = p for p with zero eigenvalues, too."""
    n, low = len(p), np.zeros_like(p, dtype=float)
    scale = max(1e-300, np.abs(np.diag(p)).max(initial=0.0))
    for j in range(n):
        d = p[j, j] - low[j, :j] @ low[j, :j]
        if d > 1e-14 * scale:
            low[j, j] = math.sqrt(d)
            low[j + 1 :, j] = (p[j + 1 :, j] - low[j + 1 :, :j] @ low[j, :j]) / low[j, j]
    return low


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    return _bisect(lambda x: normal_cdf(x) - p, -40.0, 40.0)


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: its series, or one less the continued fraction."""
    if x <= 0:
        return 0.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return head * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        b += 2
        an = -i * (i - a)
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - head * h


def chi2_cdf(x: float, dof: float) -> float:
    return gamma_p(dof / 2, x / 2)


def chi2_quantile(p: float, dof: float) -> float:
    hi = max(10.0, dof)
    while chi2_cdf(hi, dof) < p:
        hi *= 2
    return _bisect(lambda x: chi2_cdf(x, dof) - p, 0.0, hi)


def chi2_mean_bounds(dof: float, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Where the mean of n chi-square variables of dof lies with this confidence."""
    tail = (1 - confidence) / 2
    return chi2_quantile(tail, n * dof) / n, chi2_quantile(1 - tail, n * dof) / n


def nees(error: np.ndarray, p: np.ndarray) -> float:
    return float(error @ np.linalg.solve(p, error))


def observability_rank(f: np.ndarray, h: np.ndarray) -> int:
    rows, power = [], np.eye(len(f))
    for _ in range(len(f)):
        rows.append(h @ power)
        power = power @ f
    return int(np.linalg.matrix_rank(np.vstack(rows)))


def dare(f, q, h, r, tolerance: float = 1e-12, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The predicted covariance and gain at which the filter's covariance rests, by iteration."""
    f, q, h, r = (np.atleast_2d(np.asarray(m, float)) for m in (f, q, h, r))
    p = q + np.eye(len(f))
    for _ in range(most):
        s = h @ p @ h.T + r
        k = np.linalg.solve(s.T, h @ p.T).T
        new = symmetric(f @ (p - k @ h @ p) @ f.T + q)
        if np.abs(new - p).max() <= tolerance * max(1.0, np.abs(new).max()):
            p = new
            break
        p = new
    else:
        raise ValueError("no steady state")
    s = h @ p @ h.T + r
    return p, np.linalg.solve(s.T, h @ p.T).T
