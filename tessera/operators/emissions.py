"""Emission models: the likelihood of a response vector under each parcel.

A model is an immutable set of driver-side parameters (M x K values).  It
scores Arrow batches, adds up its sufficient statistics inside each task, and
makes an updated model from the totals.  It never holds data.

Statistics are dicts ``name -> (rows, K)`` of sums over locations, so tasks can
emit them as rows of K numbers and Spark can add them up.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np

from tessera.functions import special


@dataclass(frozen=True)
class Emission:
    """What inference and learning ask of an emission model."""

    def loglik(self, y, num_part, kappa=None):
        raise NotImplementedError

    def stats(self, u, y, num_part):
        raise NotImplementedError

    def updated(self, totals, rows):
        raise NotImplementedError

    def params(self) -> dict[str, np.ndarray]:
        raise NotImplementedError

    @property
    def n_parcels(self) -> int:
        return self.v.shape[1]


@dataclass(frozen=True)
class VonMisesFisher(Emission):
    """Directions on the unit sphere.

    ``v`` is M x K with unit columns; ``kappa`` a scalar or one value per
    parcel.  With ``per_subject`` the concentrations live in a table keyed by
    subject instead (a scalar or K values each), because subjects are data.
    """

    v: np.ndarray
    kappa: float | np.ndarray = 10.0
    per_parcel: bool = False
    per_subject: bool = False
    equal_weight: bool = False
    fit_v: bool = True
    fit_kappa: bool = True

    @classmethod
    def random(cls, n_parcels, width, seed=0, **flags):
        rng = np.random.default_rng(seed)
        v = rng.standard_normal((width, n_parcels))
        size = n_parcels if flags.get("per_parcel") else None
        return cls(v / np.linalg.norm(v, axis=0), rng.uniform(10, 400, size), **flags)

    @property
    def width(self):
        return self.v.shape[0]

    def loglik(self, y, num_part, kappa=None):
        k = self.kappa if kappa is None else kappa
        c = special.vmf_log_constant_np(self.width, np.asarray(k, dtype=float))
        return np.nan_to_num(c * num_part[:, None] + k * (y @ self.v))

    def stats(self, u, y, num_part):
        return {"yu": np.nan_to_num(y).T @ u, "ju": (num_part @ u)[None, :]}

    def updated(self, totals, rows, mean_direction=None):
        """``mean_direction`` replaces the pooled mean when subjects weigh equally."""
        with np.errstate(invalid="ignore", divide="ignore"):
            pooled = totals["yu"] / totals["ju"]
            v = self.v
            if self.fit_v:
                mean = pooled if mean_direction is None else mean_direction
                length = np.sqrt((mean**2).sum(axis=0))
                v = mean / np.where(length == 0, np.nan, length)
        kappa = self.kappa
        if self.fit_kappa and not self.per_subject:
            r = (pooled * v).sum(axis=0)
            kappa = special.concentration_np(r if self.per_parcel else r.mean(), self.width)
        return replace(self, v=v, kappa=kappa)

    def params(self):
        out = {"V": self.v}
        if not self.per_subject:
            out["kappa"] = np.atleast_1d(self.kappa)
        return out


@dataclass(frozen=True)
class IsotropicGaussian(Emission):
    """Gaussian noise of one variance around the predicted responses ``x @ v``.

    ``two_pi=False`` normalises by pi, not 2 pi; the constant is the same for
    every parcel, so posteriors do not depend on it.
    """

    v: np.ndarray
    sigma2: float = 1.0
    x: np.ndarray | None = None
    unit_v: bool = True
    two_pi: bool = False
    fit_v: bool = True
    fit_sigma2: bool = True

    @classmethod
    def random(cls, n_parcels, width, seed=0, x=None, unit_v=True):
        rng = np.random.default_rng(seed)
        m = width if x is None else x.shape[1]
        v = rng.standard_normal((m, n_parcels)) / math.sqrt(m)
        if unit_v:
            v = v / np.linalg.norm(v, axis=0)
        return cls(v, float(np.exp(rng.normal(0, 0.3))), x, unit_v)

    @property
    def predicted(self):
        return self.v if self.x is None else self.x @ self.v

    @property
    def width(self):
        return self.predicted.shape[0]

    def loglik(self, y, num_part, kappa=None):
        mu = self.predicted
        rss = (y * y).sum(axis=1, keepdims=True) - 2 * (y @ mu) + (mu * mu).sum(axis=0)
        c = math.log((2 if self.two_pi else 1) * math.pi) + math.log(self.sigma2)
        return np.nan_to_num(-0.5 * self.width * c - 0.5 / self.sigma2 * rss)

    def stats(self, u, y, num_part):
        # A location is valid for the mean if its first observation is present,
        # and for the residuals only if all of them are.
        whole = ~np.isnan(y).any(axis=1)
        first = ~np.isnan(y[:, 0])
        uw, yw = u[whole], y[whole]
        return {
            "yu": np.nan_to_num(y).T @ u,
            "u": u[first].sum(axis=0)[None, :],
            "wyu": yw.T @ uw,
            "wu": uw.sum(axis=0)[None, :],
            "wyy": ((yw * yw).sum(axis=1) @ uw)[None, :],
        }

    def updated(self, totals, rows):
        v = self.v
        if self.fit_v:
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = totals["yu"] / totals["u"]
                v = mean if self.x is None else np.linalg.inv(self.x.T @ self.x) @ self.x.T @ mean
                if self.unit_v:
                    v = v / np.sqrt((v**2).sum(axis=0))
        sigma2 = self.sigma2
        if self.fit_sigma2:
            mu = v if self.x is None else self.x @ v
            rss = totals["wyy"][0] - 2 * (mu * totals["wyu"]).sum(axis=0) + (mu * mu).sum(axis=0) * totals["wu"][0]
            sigma2 = float(np.nansum(rss) / (mu.shape[0] * rows))
        return replace(self, v=v, sigma2=sigma2)

    def params(self):
        return {"V": self.v, "sigma2": np.atleast_1d(self.sigma2)}


@dataclass(frozen=True)
class Multinomial(Emission):
    """Noisy labels: an indicator vector agrees with the parcel with strength ``w``."""

    k: int
    w: float = 1.0

    @property
    def n_parcels(self):
        return self.k

    @property
    def width(self):
        return self.k

    def loglik(self, y, num_part, kappa=None):
        return y * self.w - math.log(self.k - 1 + math.exp(self.w))

    def stats(self, u, y, num_part):
        return {"agree": (np.nan_to_num(y) * u).sum(axis=0)[None, :]}

    def updated(self, totals, rows):
        agree = totals["agree"].sum() / rows
        return replace(self, w=float(np.log(1 - self.k + (self.k - 1) / (1 - agree))))

    def params(self):
        return {"w": np.atleast_1d(self.w)}


@dataclass(frozen=True)
class GaussianExponential(Emission):
    """Gaussian noise around ``s * v`` with exponential signal strength ``s``.

    The posterior of ``s`` is evaluated on evenly spaced bins up to 1.2 times
    the largest data length, which must be known before scoring
    (``estep="linspace"``).  ``"import"`` weighs exponential draws shared by
    all locations, ``"reject"`` thins them by rejection, and ``"max"`` takes
    the most probable strength.
    """

    v: np.ndarray
    max_length: float
    sigma2: float = 1.0
    beta: float = 1.0
    bins: int = 88
    x: np.ndarray | None = None
    unit_v: bool = True
    estep: str = "linspace"
    seed: int = 0

    @classmethod
    def random(cls, n_parcels, width, max_length, seed=0, **flags):
        rng = np.random.default_rng(seed)
        v = rng.standard_normal((width, n_parcels))
        return cls(v / np.linalg.norm(v, axis=0), max_length, float(np.exp(rng.normal(0, 0.3))), **flags)

    @property
    def predicted(self):
        return self.v if self.x is None else self.x @ self.v

    @property
    def width(self):
        return self.predicted.shape[0]

    @property
    def grid(self):
        top = self.max_length * 1.2
        return np.linspace(top / self.bins / 2, top, self.bins)

    def signal(self, y):
        """Posterior mean and mean square of the signal strength, each n x K."""
        mu = self.predicted
        yv, vv = y @ mu, (mu * mu).sum(axis=0)
        if self.estep == "max":
            s = np.maximum(yv / vv - self.beta * self.sigma2, 0.0)
            return s, s * s
        sampled = self.estep in ("import", "reject")
        x = self.draws if sampled else self.grid
        density = self.beta * np.exp(-self.beta * x)
        s, s2 = np.empty_like(yv), np.empty_like(yv)
        for k in range(yv.shape[1]):
            ll = -0.5 / self.sigma2 * (-2 * yv[:, k, None] * x + vv[k] * x**2)
            if self.estep != "import":  # there the draws already follow the prior
                ll = ll - self.beta * x
            p = np.exp(ll - ll.max(axis=1, keepdims=True))
            if self.estep == "reject":
                ratio = p / density
                ratio /= ratio.max(axis=1, keepdims=True)
                p = (self.thresholds[k] <= ratio).astype(float)
            p /= p.sum(axis=1, keepdims=True)
            s[:, k], s2[:, k] = p @ x, p @ x**2
        return s, s2

    def _uniforms(self, tag):
        """Hashed uniforms, the same in every task."""
        heads = [hashlib.md5(f"{self.seed}|{tag}|{i}".encode()).hexdigest()[:8] for i in range(self.bins)]
        return np.array([int(h, 16) for h in heads]) / 4294967296.0

    @property
    def draws(self):
        return -np.log(1 - self._uniforms("signal")) / self.beta

    @property
    def thresholds(self):
        return [self._uniforms(f"accept{k}") for k in range(self.n_parcels)]

    def loglik(self, y, num_part, kappa=None):
        mu = self.predicted
        s, s2 = self.signal(y)
        rss = (y * y).sum(axis=1, keepdims=True) - 2 * (y @ mu) * s + s2 * (mu * mu).sum(axis=0)
        c = math.log(2 * math.pi) + math.log(self.sigma2)
        return np.nan_to_num(-0.5 * self.width * c - 0.5 / self.sigma2 * rss + math.log(self.beta) - self.beta * s)

    def stats(self, u, y, num_part):
        s, s2 = self.signal(y)
        whole = ~np.isnan(y).any(axis=1)
        us, us2 = np.nan_to_num(u * s), np.nan_to_num(u * s2)
        first = ~np.isnan(y[:, 0])
        return {
            "yus": np.nan_to_num(y).T @ us,
            "us": us[first].sum(axis=0)[None, :],
            "us2": us2[first].sum(axis=0)[None, :],
            "wyus": y[whole].T @ us[whole],
            "wus2": us2[whole].sum(axis=0)[None, :],
            "wyy": ((y[whole] ** 2).sum(axis=1) @ u[whole])[None, :],
        }

    def updated(self, totals, rows):
        mean = totals["yus"] / totals["us2"]
        v = mean if self.x is None else np.linalg.inv(self.x.T @ self.x) @ self.x.T @ mean
        if self.unit_v:
            v = v / np.sqrt((v**2).sum(axis=0))
        mu = v if self.x is None else self.x @ v
        rss = totals["wyy"][0] - 2 * (mu * totals["wyus"]).sum(axis=0) + totals["wus2"][0] * (mu * mu).sum(axis=0)
        return replace(
            self, v=v, sigma2=float(rss.sum() / (mu.shape[0] * rows)), beta=float(rows / totals["us"].sum())
        )

    def params(self):
        return {"V": self.v, "sigma2": np.atleast_1d(self.sigma2), "beta": np.atleast_1d(self.beta)}


def build_emission(kind: str, n_parcels: int, x, v=None, seed=0, **flags) -> Emission:
    """An emission model by name; a given ``v`` stays fixed while learning."""
    m = x.shape[1]
    if kind == "VMF":
        model = VonMisesFisher.random(n_parcels, m, seed, **flags)
    elif kind == "GMM":
        model = IsotropicGaussian.random(n_parcels, m, seed, x=x, **flags)
    else:
        raise ValueError(f"unknown emission model {kind}")
    return model if v is None else replace(model, v=np.asarray(v, dtype=float), fit_v=False)
