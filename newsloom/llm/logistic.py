"""Logistic regression by damped Newton steps, for the small models trained here."""

from __future__ import annotations

import numpy as np


class Logistic:
    def __init__(self, l2: float = 1e-3, steps: int = 25):
        self.l2, self.steps = l2, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        x = np.asarray(x, np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        weight = np.ones(len(y)) if weight is None else weight
        weight = weight / max(weight.sum(), 1e-9)
        ridge = np.full(z.shape[1], self.l2)
        ridge[-1] = 1e-9
        w, loss = np.zeros(z.shape[1]), np.inf
        share = float((weight * y).sum())
        w[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            slope = z.T @ (weight * (p - y)) + ridge * w
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z
            step = np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)
            size = 1.0
            while size > 1e-4:
                new = self._loss(z, y, weight, ridge, w - size * step)
                if new <= loss:
                    break
                size /= 2
            w, done, loss = w - size * step, loss - new < 1e-9, new
            if done:
                break
        self.w, self.b = w[:-1], float(w[-1])
        return self

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Scaled features and a column of ones."""
        return np.concatenate([(np.asarray(x, np.float64) - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def sums(self, x: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature of the loss of rows that are all marked y, to be added up over parts of a table."""
        z = self.padded(x)
        p = sigmoid(z @ np.append(self.w, self.b))
        return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z

    def taught(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, more: list[tuple[float, np.ndarray, np.ndarray, int]]) -> Logistic:
        """One Newton step from here on the rows given and on sums (weight of each row, slope, curvature, rows) of others;
        the step is halved until it does the rows given no real harm."""
        z, w = self.padded(x), np.append(self.w, self.b)
        total = weight.sum() + sum(k * n for k, _, _, n in more)
        ridge = np.full(len(w), self.l2)
        ridge[-1] = 1e-9
        p = sigmoid(z @ w)
        slope = z.T @ (weight * (p - y)) + sum(k * g for k, g, _, _ in more)
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + sum(k * h for k, _, h, _ in more)
        step = np.linalg.solve(curve / total + np.diag(ridge + 1e-9), slope / total + ridge * w)
        share = weight / weight.sum()
        most, size = 1.2 * self._loss(z, y, share, ridge, w) + 0.02, 1.0
        while size > 1e-4 and self._loss(z, y, share, ridge, w - size * step) > most:
            size /= 2
        out = Logistic(self.l2, self.steps)
        out.mean, out.scale, w = self.mean, self.scale, w - (size * step if size > 1e-4 else 0)
        out.w, out.b = w[:-1], float(w[-1])
        return out

    @staticmethod
    def _loss(z, y, weight, ridge, w):
        t = z @ w
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (ridge * w * w).sum())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x, np.float64) - self.mean) / self.scale @ self.w + self.b

    def prob(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(t):
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))
