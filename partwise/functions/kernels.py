"""NumPy pieces of the support-vector solver: feature maps and Newton sums on one block of rows."""

from __future__ import annotations

import numpy as np

GRAM_COLUMNS = 2048    # wider fits are solved without a Gram matrix
POLY_DEGREE = 3


def kernel_matrix(x: np.ndarray, y: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    product = x @ y.T
    if kernel == "linear":
        return product
    if kernel == "rbf":
        away = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * product
        return np.exp(-gamma * np.maximum(away, 0.0))
    if kernel == "poly":
        return (gamma * product) ** POLY_DEGREE
    if kernel == "sigmoid":
        return np.tanh(gamma * product)
    raise ValueError(f"unknown kernel {kernel!r}")


def self_kernel(x: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    """Kernel of each row with itself."""
    square = (x * x).sum(1)
    if kernel == "rbf":
        return np.ones(len(x))
    if kernel == "poly":
        return (gamma * square) ** POLY_DEGREE
    return np.tanh(gamma * square) if kernel == "sigmoid" else square


def feature_map(x: np.ndarray, kernel: str, gamma: float, landmarks: np.ndarray | None) -> np.ndarray:
    """Explicit features with a constant last column: identity, or Nystroem over the landmarks."""
    if kernel == "linear":
        mapped = x
    else:
        values, vectors = np.linalg.eigh(kernel_matrix(landmarks, landmarks, kernel, gamma))
        keep = values > 1e-10 * max(values.max(), 1e-300)      # also drops negative ones (sigmoid)
        mapped = kernel_matrix(x, landmarks, kernel, gamma) @ (vectors[:, keep] / np.sqrt(values[keep]))
    return np.hstack([mapped, np.ones((len(x), 1))])


def newton_sums(phi: np.ndarray, target: np.ndarray, w: np.ndarray, task: str, epsilon: float):
    """(Gram, right-hand side, squared loss, active rows) of the rows with non-zero loss."""
    f = phi @ w
    if task == "clf":
        slack = 1.0 - target * f
        active = slack > 0
        loss, aim = slack[active], target[active]
    else:
        rest = target - f
        active = np.abs(rest) > epsilon
        loss = np.abs(rest[active]) - epsilon
        aim = target[active] - np.sign(rest[active]) * epsilon
    rows = phi[active]
    return rows.T @ rows, rows.T @ aim, float(loss @ loss), int(active.sum())


def slopes(phi: np.ndarray, target: np.ndarray, w: np.ndarray, task: str, epsilon: float):
    """(sum of residual * row over rows with non-zero loss, squared loss, active rows)."""
    f = phi @ w
    if task == "clf":
        away = np.where(target * f < 1.0, f - target, 0.0)
    else:
        rest = f - target
        away = np.sign(rest) * np.maximum(np.abs(rest) - epsilon, 0.0)
    return phi.T @ away, float(away @ away), int(np.count_nonzero(away))


def curvature(phi: np.ndarray, target: np.ndarray, w: np.ndarray, v: np.ndarray, task: str, epsilon: float):
    """Sum of row * (row . v) over rows with non-zero loss at w."""
    f = phi @ w
    active = phi[target * f < 1.0] if task == "clf" else phi[np.abs(f - target) > epsilon]
    return active.T @ (active @ v)


class WideState:
    """One fit without a Gram matrix: Newton steps, each by conjugate gradients on sums over the rows."""

    STEPS = 30

    def __init__(self, width: int, c: float):
        self.c, self.w, self.value = c, np.zeros(width), np.inf
        self.slope = self.direction = None
        self.step, self.scale = np.zeros(width), 1.0
        self.rounds, self.done, self.active, self.residual, self.n = 0, False, 0, np.inf, 0
        self.phase = "measure"

    @property
    def candidate(self) -> np.ndarray:
        return self.w + self.scale * self.step

    def ridge(self, v: np.ndarray) -> np.ndarray:
        return np.append(v[:-1], 1e-9 * v[-1])      # the constant column is not penalised

    def measured(self, sums: np.ndarray, loss: float, active: int, max_rounds: int) -> None:
        """Gradient and loss at the candidate: take it if the objective fell, halve the step if not."""
        value = objective(self.candidate, loss, self.c)
        if value > self.value:
            self.scale /= 2
            self.done = self.scale < 1e-10
            return
        settled = self.value - value <= 1e-10 * max(1.0, abs(value))
        self.w, self.value, self.active = self.candidate, value, active
        self.rounds += 1
        self.slope = np.append(self.w[:-1], 0.0) + 2 * self.c * sums
        self.residual = float(np.abs(self.slope).max())
        self.done = settled or self.residual <= 1e-9 or self.rounds >= max_rounds
        self.step, self.scale = np.zeros(len(self.w)), 1.0
        self.rest, self.direction, self.turn = -self.slope, -self.slope, 0
        self.norm = self.start = float(self.rest @ self.rest)
        self.phase = "solve"

    def solved(self, sums: np.ndarray) -> None:
        """One step of conjugate gradients, given the curvature along the direction."""
        along = self.ridge(self.direction) + 2 * self.c * sums
        size = self.norm / max(float(self.direction @ along), 1e-300)
        self.step = self.step + size * self.direction
        self.rest = self.rest - size * along
        norm = float(self.rest @ self.rest)
        self.direction = self.rest + norm / self.norm * self.direction
        self.norm, self.turn = norm, self.turn + 1
        if self.turn >= self.STEPS or norm <= 1e-12 * self.start:
            self.phase = "measure"


def newton_solution(gram: np.ndarray, aim: np.ndarray, c: float) -> np.ndarray:
    """Minimiser for a fixed active set; the constant column is not penalised."""
    system = 2.0 * c * gram
    system[np.diag_indices_from(system)] += np.append(np.ones(len(aim) - 1), 1e-9)
    try:
        return np.linalg.solve(system, 2.0 * c * aim)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, 2.0 * c * aim, rcond=None)[0]


def objective(w: np.ndarray, loss: float, c: float) -> float:
    return 0.5 * float(w[:-1] @ w[:-1]) + c * loss


class NewtonState:
    """One fit: accepts a candidate if the objective fell, otherwise halves the step."""

    def __init__(self, width: int, c: float):
        self.c, self.w, self.value = c, None, np.inf
        self.candidate = np.zeros(width)
        self.rounds, self.done, self.active, self.residual = 0, False, 0, np.inf

    def advance(self, loss: float, active: int, solution: np.ndarray, max_rounds: int) -> None:
        """Take in the sums measured at the candidate and the solution they imply."""
        value = objective(self.candidate, loss, self.c)
        self.rounds += 1
        if value <= self.value:
            settled = self.w is not None and self.value - value <= 1e-10 * max(1.0, abs(value))
            self.w, self.value, self.active = self.candidate, value, active
            self.residual = float(np.abs(solution - self.w).max())
            self.done = settled or self.residual <= 1e-9 * max(1.0, np.abs(self.w).max())
            self.candidate = solution
        else:
            step = self.candidate - self.w
            self.done = np.abs(step).max() <= 1e-12 * max(1.0, np.abs(self.w).max())
            self.candidate = self.w + 0.5 * step
        self.done = self.done or self.rounds >= max_rounds


def solve_rows(phi: np.ndarray, target: np.ndarray, c: float, task: str, epsilon: float, max_rounds: int,
               start: np.ndarray | None = None) -> NewtonState:
    """The whole iteration on rows held by one task, from ``start`` (any point leads to the same minimum). With more
    columns than rows it runs in the space the rows span, where the minimum lies, and is turned back at the end."""
    if phi.shape[1] - 1 > len(phi) > 0:
        _, s, vt = np.linalg.svd(phi[:, :-1], full_matrices=False)
        basis = vt[s > 1e-12 * max(s.max(), 1e-300)]
        inner = None if start is None else np.append(basis @ start[:-1], start[-1])
        state = solve_rows(np.hstack([phi[:, :-1] @ basis.T, phi[:, -1:]]), target, c, task, epsilon, max_rounds, inner)
        state.w = np.append(state.w[:-1] @ basis, state.w[-1])
        return state
    state = NewtonState(phi.shape[1], c)
    if start is not None:
        state.candidate = start
    while not state.done:
        gram, aim, loss, active = newton_sums(phi, target, state.candidate, task, epsilon)
        state.advance(loss, active, newton_solution(gram, aim, c), max_rounds)
    return state


def class_pairs(classes) -> list[tuple[float, float]]:
    ordered = sorted(float(c) for c in classes)
    return [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:]]


def vote(phi: np.ndarray, fits: list[tuple[float, float, np.ndarray]]) -> np.ndarray:
    """Majority over class pairs; equal votes go to the lowest class."""
    classes = sorted({c for a, b, _ in fits for c in (a, b)})
    place = {c: i for i, c in enumerate(classes)}
    votes = np.zeros((len(phi), len(classes)), dtype=np.int32)
    for a, b, w in fits:
        first = phi @ w > 0
        votes[:, place[a]] += first
        votes[:, place[b]] += ~first
    return np.array(classes)[votes.argmax(1)]
