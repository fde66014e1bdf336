"""Rarefaction and extrapolation of Hill numbers from abundance counts."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.functions.numbers import chance_of_none, harmonic, log_factorial
from siltflow.plans.spread import spread

class Abundances:
    """Abundances as distinct counts x with the number of taxa f that have each."""

    def __init__(self, x: np.ndarray, f: np.ndarray):
        self.x, self.f = np.asarray(x, float), np.asarray(f, float)
        self.n = int((self.x * self.f).sum())
        self.f1 = float(self.f[self.x == 1].sum())
        self.f2 = float(self.f[self.x == 2].sum())
        self._limits: tuple[float, float] | None = None
        n, f1, f2 = self.n, self.f1, self.f2
        self.f0 = (n - 1) / n * (f1 * f1 / (2 * f2) if f2 > 0 else f1 * (f1 - 1) / 2)
        if f2 > 0:
            self.a = (n - 1) * f1 / ((n - 1) * f1 + 2 * f2)
        else:
            self.a = (n - 1) * (f1 - 1) / ((n - 1) * (f1 - 1) + 2) if f1 > 1 else 0.0

    def coverage(self, m: int) -> float:
        n = self.n
        if m < n:
            return float(1 - (self.f * self.x / n * chance_of_none(n - 1, self.x - 1, m)).sum())
        return 1 - self.f1 / n * self.a ** (m - n + 1)

    def _drawn_entropy(self, m: int) -> float:
        """Expected Shannon entropy of a sample of m: a taxon of x reads has k of them in it by the hypergeometric
        distribution. For all counts x together the k within twelve deviations of the mean are taken; what lies beyond has no digit in the sum."""
        n, x = self.n, self.x.astype(np.int64)
        mean = m * self.x / n
        wide = 12 * np.sqrt(mean * (1 - self.x / n) * (n - m) / max(n - 1, 1)) + 40
        low = np.maximum(np.maximum(0, m - (n - x)), (mean - wide).astype(np.int64))
        many = np.minimum(np.minimum(x, m), (mean + wide).astype(np.int64)) - low + 1
        total = 0.0
        for at in np.array_split(np.arange(len(x)), max(1, int(many.sum()) // 1_000_000)):
            begins = np.cumsum(many[at]) - many[at]
            k = np.arange(many[at].sum()) - np.repeat(begins - low[at], many[at])
            xs = np.repeat(x[at], many[at])
            log_p = -log_factorial(k) - log_factorial(xs - k) - log_factorial(m - k) - log_factorial(n - xs - m + k)
            p = np.exp(log_p - np.repeat(np.maximum.reduceat(log_p, begins), many[at]))
            part = p * (k / m) * np.log(np.maximum(k, 1) / m)  # k = 0 adds nothing
            total -= float((self.f[at] * np.add.reduceat(part, begins) / np.add.reduceat(p, begins)).sum())
        return total

    def _entropy_of_one_less(self) -> float:
        """The same for all reads but one, which is one of a taxon of x reads with chance x / n; without logarithms of
        factorials, as it is only used for its small difference from the entropy of all reads."""
        m, x = self.n - 1, self.x
        part = lambda k: k / m * np.log(np.maximum(k, 1) / m)
        return -float((self.f * (x / self.n * part(x - 1) + (1 - x / self.n) * part(x))).sum())

    def entropy(self) -> float:
        """Asymptotic estimate of Shannon entropy."""
        first = float((self.f * self.x / self.n * (harmonic(np.array(self.n - 1)) - harmonic(self.x - 1))).sum())
        if not self.f1:
            return first
        t = 1 - (2 * self.f2 / ((self.n - 1) * self.f1 + 2 * self.f2) if self.f2 else 2 / ((self.n - 1) * (self.f1 - 1) + 2) if self.f1 > 1 else 1.0)
        if t <= 0:
            return first
        # The unseen part is f1 / n times t^(1 - n) times the sum of t^r / r from n on. Where t^n is small, the difference
        # that gives this sum has no digits left, and it is added up with the power drawn in.
        if self.n * (1 - t) < 5:
            rest = -math.log(1 - t)
            for i in range(1, self.n, 1 << 20):
                r = np.arange(i, min(i + (1 << 20), self.n))
                rest -= float((t**r / r).sum())
            return first + self.f1 / self.n * t ** (1 - self.n) * max(rest, 0.0)
        rest, at, step = 0.0, 0, 1 << 16
        while True:
            r = np.arange(at, at + step)
            rest += float((np.exp((r + 1) * math.log(t)) / (self.n + r)).sum())
            at += step
            if math.exp((at + 1) * math.log(t)) / ((self.n + at) * (1 - t)) < 1e-15 * rest:
                return first + self.f1 / self.n * rest

    def diversity(self, m: int, q: int) -> float:
        n = self.n
        if q == 0:
            if m <= n:
                return float((self.f * (1 - chance_of_none(n, self.x, m))).sum())
            grown = self.f0 * (1 - (1 - self.f1 / (n * self.f0 + self.f1)) ** (m - n)) if self.f0 > 0 else 0.0
            return float(self.f.sum() + grown)
        if q == 2:
            pair = float((self.f * self.x * (self.x - 1)).sum()) / (n * (n - 1)) if n > 1 else 0.0
            return 1 / (1 / m + (m - 1) / m * pair)
        if q == 1:
            seen = math.exp(-(self.f * self.x / n * np.log(self.x / n)).sum())
            if m < n:
                return math.exp(self._drawn_entropy(m))
            if m == n or n < 2:
                return seen
            if self._limits is None:
                self._limits = math.exp(self.entropy()), math.exp(self._entropy_of_one_less())
            goal, before = self._limits
            if goal <= before:
                return seen
            step = (seen - before) / (goal - before)
            return seen + (goal - seen) * (1 - (1 - step) ** (m - n))
        raise ValueError("q must be 0, 1 or 2")


def knots_of(n: int, endpoint: int, knots: int) -> list[int]:
    """Sample sizes: evenly from 1 to n and from n to the endpoint, with both."""
    low = np.linspace(1, min(n, endpoint), max(2, knots // 2))
    high = np.linspace(n, endpoint, max(2, knots - knots // 2)) if endpoint > n else []
    return sorted({int(m) for m in [*low, *high]})


def _redrawn(a: Abundances, times: int, seed: int) -> list[Abundances]:
    """Samples of the estimated community: seen taxa with shares lowered for what was missed, and the estimated number of
    unseen taxa with equal parts of the missing share."""
    share = np.repeat(a.x / a.n, a.f.astype(int))
    unseen = math.ceil(a.f0)
    missing = 1 - a.coverage(a.n) if unseen else 0.0
    loss = share * (1 - share) ** a.n
    known = share - missing * loss / loss.sum() if missing and loss.sum() > 0 else share
    p = np.concatenate([known, np.full(unseen, missing / unseen if unseen else 0.0)])
    rng = np.random.default_rng(seed)
    drawn = (rng.multinomial(a.n, p / p.sum()) for _ in range(times))
    return [Abundances(*np.unique(d[d > 0], return_counts=True)) for d in drawn]


def rarefaction(cells: DataFrame, q: int = 0, endpoint: int = 150_000, knots: int = 40, sample: str = "tag", count: str = "cnt", nboot: int = 0) -> DataFrame:
    """(tag, m, method, qD, SC): diversity of order q and coverage at each sample size.

    Cells are first reduced to counts of counts, so a task gets the distinct counts of a sample and
    not its taxa. Null, zero and negative counts are left out; samples without others have no rows.
    With ``nboot`` the columns based, qD_LCL, qD_UCL, SC_LCL and SC_UCL are added: 95 % intervals from so many samples
    redrawn with a seed made of the tag, once at equal size and once at equal coverage (SC then is fixed and has no interval). Redrawing holds the taxa of one sample in a task.
    """
    counts = cells.where(F.col(count) > 0).groupBy(F.col(sample).alias("tag"), F.col(count).cast("long").alias("x")).agg(F.count("*").alias("f"))
    plain = ["tag", "m", "method", "qD", "SC"]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        a = Abundances(b.x.to_numpy(), b.f.to_numpy())
        tag, sizes = b.tag.iloc[0], knots_of(a.n, endpoint, knots)
        kind = lambda m: "Rarefaction" if m < a.n else "Observed" if m == a.n else "Extrapolation"
        rows = pd.DataFrame([(tag, m, kind(m), a.diversity(m, q), a.coverage(m)) for m in sizes], columns=plain)
        if not nboot:
            return rows
        curves = [[(r.diversity(m, q), r.coverage(m)) for m in sizes] for r in _redrawn(a, nboot, zlib.crc32(str(tag).encode()))]
        d, c = np.array(curves).transpose(2, 0, 1)
        at_coverage = np.array([np.interp(rows.SC, *zip(*sorted(zip(ci, di)))) for ci, di in zip(c, d)])
        half = lambda v: 1.959963984540054 * v.std(axis=0, ddof=1) if nboot > 1 else np.zeros(v.shape[1])
        out = []
        for based, qd, sc in (("size", half(d), half(c)), ("coverage", half(at_coverage), None)):
            limits = {"qD_LCL": np.maximum(rows.qD - qd, 0), "qD_UCL": rows.qD + qd, "SC_LCL": np.nan if sc is None else np.maximum(rows.SC - sc, 0), "SC_UCL": np.nan if sc is None else np.minimum(rows.SC + sc, 1)}
            out.append(rows.assign(based=based, **limits))
        return pd.concat(out)

    more = ", based string, qD_LCL double, qD_UCL double, SC_LCL double, SC_UCL double" if nboot else ""
    return spread(counts, "tag").groupBy("tag").applyInPandas(run, "tag string, m long, method string, qD double, SC double" + more)
