"""Numeric kernels on arrays, for Arrow batches: filters, transforms, small linear models.

Own designs from the textbook definitions; everything is vectorised over leading axes."""

from __future__ import annotations

import warnings
from collections import OrderedDict

import numpy as np


# --- filters -----------------------------------------------------------------------------------------------


def butterworth_bandpass(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) by the bilinear transform with prewarped edges.

    Poles are paired with their conjugates; each section has a zero at 1 and one at -1; the gain is 1 at the centre."""
    wl, wh = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    width, centre = wh - wl, np.sqrt(wl * wh)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    root = np.sqrt((proto * width / 2) ** 2 - centre**2)
    analog = np.concatenate([proto * width / 2 + root, proto * width / 2 - root])
    poles = (2 * fs + analog) / (2 * fs - analog)
    upper = sorted(poles[poles.imag > 1e-12], key=lambda p: -abs(p))
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    denominators = [(1.0, -2 * p.real, abs(p) ** 2) for p in upper]
    denominators += [(1.0, -(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    sos = np.array([[1.0, 0.0, -1.0, *d] for d in denominators])
    mid = np.exp(-2j * np.arctan(centre / (2 * fs)))
    gain = np.prod([abs((s[0] + s[1] * mid + s[2] * mid**2) / (s[3] + s[4] * mid + s[5] * mid**2)) for s in sos])
    sos[:, :3] *= gain ** (-1 / len(sos))
    return sos


def notch(centre: float, quality: float, fs: float) -> np.ndarray:
    """One second-order section with zeros on the circle at `centre` and a 3 dB width of centre / quality."""
    w = 2 * np.pi * centre / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    return np.array([[gain, -2 * gain * np.cos(w), gain, 1.0, -2 * gain * np.cos(w), 2 * gain - 1]])


def _steady(s: np.ndarray) -> tuple[float, float]:
    """State of a section (transposed direct form II) that a constant input of 1 leaves unchanged."""
    level = s[:3].sum() / s[3:].sum()
    second = s[2] - s[5] * level
    return s[1] - s[4] * level + second, second


def _run(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sections over the last axis, each begun in the steady state of the first sample."""
    y = np.moveaxis(np.array(x, dtype=float), -1, 0)
    for s in sos:
        z1, z2 = (k * y[0] for k in _steady(s))
        out = np.empty_like(y)
        for t in range(len(y)):
            v = y[t]
            out[t] = s[0] * v + z1
            z1 = s[1] * v - s[4] * out[t] + z2
            z2 = s[2] * v - s[5] * out[t]
        y = out
    return np.moveaxis(y, 0, -1)


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward with an odd extension at both ends, so phases cancel and edges stay calm."""
    zeros = min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    pad = min(3 * (2 * len(sos) + 1 - zeros), x.shape[-1] - 1)
    if pad > 0:
        head = 2 * x[..., :1] - x[..., pad:0:-1]
        tail = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
        x = np.concatenate([head, x, tail], axis=-1)
    y = _run(sos, _run(sos, x)[..., ::-1])[..., ::-1]
    return y[..., pad:-pad] if pad > 0 else y


def polynomials(sos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(b, a): sections multiplied out into one direct form."""
    b, a = np.ones(1), np.ones(1)
    for s in sos:
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    return b, a


def zero_phase_direct(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """zero_phase in one direct form, with that form's own extension of three times its length: the older filters' numbers."""
    pad = min(3 * len(a), x.shape[-1] - 1)
    if pad > 0:
        x = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    level, calm = b.sum() / a.sum(), np.zeros(len(a))
    for k in range(len(a) - 1, 0, -1):  # the state that a constant input of 1 leaves unchanged
        calm[k - 1] = b[k] - a[k] * level + calm[k]

    def run(x: np.ndarray) -> np.ndarray:
        y = np.moveaxis(np.array(x, dtype=float), -1, 0)
        state = calm[: len(a) - 1].reshape(-1, *[1] * (y.ndim - 1)) * y[0]
        out = np.empty_like(y)
        for t in range(len(y)):
            out[t] = b[0] * y[t] + state[0]
            state[:-1] = state[1:]
            state[-1] = 0
            state += np.multiply.outer(b[1:], y[t]) - np.multiply.outer(a[1:], out[t])
        return np.moveaxis(out, 0, -1)

    y = run(run(x)[..., ::-1])[..., ::-1]
    return y[..., pad:-pad] if pad > 0 else y


# --- transforms --------------------------------------------------------------------------------------------


def stockwell(x: np.ndarray, fs: float, frequencies: np.ndarray, guard: float = 1e-10) -> np.ndarray:
    """|S| as (.., frequency, time): per frequency f, the spectrum about f under exp(-2 pi^2 (a - f)^2 / (f^2 + guard)).

    One forward transform serves all frequencies; frequencies stream, so memory holds one plane more than the result."""
    n = x.shape[-1]
    spectrum, axis = np.fft.fft(x).astype(np.complex64), np.fft.fftfreq(n, 1 / fs)
    out = np.empty((*x.shape[:-1], len(frequencies), n), np.float32)
    for k, f in enumerate(frequencies):
        shape = np.exp(-2 * np.pi**2 * (axis - f) ** 2 / (f * f + guard)).astype(np.float32)
        out[..., k, :] = np.abs(np.fft.ifft(spectrum * shape))
    return out


def stockwell_entropy(x: np.ndarray, fs: float, bands, low: float, high: float, count: int = 75, eps: float = 1e-10) -> np.ndarray:
    """Differential entropy per band from the log power of the band's mean: (.., band). An empty band, NaN or -inf
    give -10, +inf gives 10."""
    frequencies = np.logspace(np.log10(low), np.log10(high), count)
    power = stockwell(x, fs, frequencies).astype(float) ** 2
    out = []
    for _, lo, hi in bands:
        inside = (frequencies >= lo) & (frequencies <= hi)
        if not inside.any():
            out.append(np.full(x.shape[:-1], -10.0))
            continue
        level = np.log(power[..., inside, :].mean(axis=-2) + eps)
        v = np.maximum(level.var(axis=-1, ddof=1), 1e-10)
        out.append(0.5 * np.log(2 * np.pi * np.e * v))
    return np.nan_to_num(np.stack(out, axis=-1), nan=-10.0, posinf=10.0, neginf=-10.0)


def stockwell_amplitude_entropy(x: np.ndarray, fs: float, bands, low: float, high: float, count: int = 75, eps: float = 1e-10) -> np.ndarray:
    """The older form: entropy of the variance of the band's mean amplitude; an empty band gives 0."""
    frequencies = np.logspace(np.log10(low), np.log10(high), count)
    size = stockwell(x, fs, frequencies, guard=1e-8).astype(float)
    out = []
    for _, lo, hi in bands:
        inside = (frequencies >= lo) & (frequencies <= hi)
        v = size[..., inside, :].mean(axis=-2).var(axis=-1) if inside.any() else None
        out.append(np.zeros(x.shape[:-1]) if v is None else 0.5 * np.log(2 * np.pi * np.e * (v + eps)))
    return np.stack(out, axis=-1)


def filtered_entropy(x: np.ndarray, fs: float, bands, order: int = 4, eps: float = 1e-10) -> np.ndarray:
    """Entropy of the variance of each band-passed signal: (.., band)."""
    parts = [zero_phase(butterworth_bandpass(order, lo, min(hi, 0.49 * fs), fs), x).var(axis=-1) for _, lo, hi in bands]
    return 0.5 * np.log(2 * np.pi * np.e * (np.stack(parts, axis=-1) + eps))


def daubechies(order: int) -> np.ndarray:
    """Low-pass filter of the Daubechies wavelet with `order` vanishing moments, by spectral factorisation:
    of the roots of the half-band polynomial those inside the unit circle."""
    from math import comb

    p = [comb(order - 1 + k, k) for k in range(order)]
    inside = []
    for y in np.roots(p[::-1]) if order > 1 else []:
        b = 2 - 4 * y
        z = np.roots([1, -b, 1])
        inside.append(z[np.argmin(np.abs(z))])
    h = np.array([1.0 + 0j])
    for _ in range(order):
        h = np.convolve(h, [1, 1])
    for z in inside:
        h = np.convolve(h, [1, -z])
    h = h.real
    return h * np.sqrt(2) / h.sum()


def wavelet_log_variance(x: np.ndarray, order: int = 4, level: int = 5, eps: float = 1e-10, mode: str = "symmetric") -> np.ndarray:
    """log(var + eps) of the approximation and the details of a wavelet decomposition, coarsest first.

    mode: at its ends a signal is mirrored ("symmetric", edge samples twice) or begins anew ("periodic")."""
    low = daubechies(order)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    out, a = [], np.asarray(x, dtype=float)
    for _ in range(level):
        if mode == "symmetric":
            size = len(low)
            wide = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(size - 1, size - 1)], mode="symmetric")
            parts = np.lib.stride_tricks.sliding_window_view(wide, size, axis=-1)[..., 1::2, :]
            out.append(parts @ high)
            a = parts @ low
            continue
        if a.shape[-1] % 2:
            a = np.concatenate([a, a[..., -1:]], axis=-1)
        n = a.shape[-1]
        index = (np.arange(0, n, 2)[:, None] + np.arange(len(low))) % n
        parts = a[..., index]
        out.append(parts @ high)
        a = parts @ low
    out.append(a)
    return np.stack([np.log(v.var(axis=-1) + eps) for v in out[::-1]], axis=-1)


def welch_density(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density: Hann window, half overlap, constant detrend."""
    step, w = nperseg // 2, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=-1)[..., ::step, :]
    parts = (parts - parts.mean(axis=-1, keepdims=True)) * w
    p = (np.abs(np.fft.rfft(parts)) ** 2).mean(axis=-2) / (fs * (w * w).sum())
    p[..., 1 : (nperseg + 1) // 2] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), p


# --- small linear models -----------------------------------------------------------------------------------


def fix_signs(columns: np.ndarray) -> np.ndarray:
    """Each column's largest entry made positive: eigenvectors become comparable."""
    top = columns[np.argmax(np.abs(columns), axis=0), np.arange(columns.shape[1])]
    return columns * np.where(top < 0, -1.0, 1.0)


def csp_filters(cov_a: np.ndarray, cov_b: np.ndarray, count: int, ridge: float = 0.1) -> np.ndarray:
    """Common spatial patterns: the `count` generalised eigenvectors of (A, A + B) farthest from one half, with
    covariances shrunk to their scaled identity."""
    shrink = lambda c: (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c))
    a, b = shrink(cov_a), shrink(cov_b)
    lower = np.linalg.cholesky(a + b)
    inverse = np.linalg.inv(lower)
    value, vector = np.linalg.eigh(inverse @ a @ inverse.T)
    order = np.argsort(-np.abs(value - 0.5), kind="stable")[:count]
    return fix_signs(inverse.T @ vector[:, order])


def lda_fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, weights and offsets of linear discriminants with a shrunk pooled covariance."""
    classes = np.unique(y)
    means = np.stack([x[y == c].mean(axis=0) for c in classes])
    centred = x - means[np.searchsorted(classes, y)]
    cov = centred.T @ centred / len(x)
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))
    w = np.linalg.solve(cov + 1e-12 * np.eye(len(cov)), means.T)
    prior = np.array([(y == c).mean() for c in classes])
    return classes, w, np.log(prior) - 0.5 * np.einsum("cd,dc->c", means, w)


def ledoit_wolf(centred: np.ndarray) -> float:
    """The shrinkage towards a scaled identity that is best for a covariance of so many centred rows."""
    n, d = centred.shape
    cov = centred.T @ centred / n
    mean = np.trace(cov) / d
    spread = ((cov - mean * np.eye(d)) ** 2).sum() / d
    noise = (((centred * centred).sum(axis=1) ** 2).sum() / n - (cov * cov).sum()) / (n * d)
    return float(np.clip(noise / spread, 0.0, 1.0)) if spread > 0 else 0.0


def lda_auto_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lda_fit with the shrinkage set by the training rows."""
    classes, index = np.unique(y, return_inverse=True)
    centred = x - np.stack([x[y == c].mean(axis=0) for c in classes])[index]
    return lda_fit(x, y, ledoit_wolf(centred))


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, balanced: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, weights and offsets of weighted least squares on +-1 targets, one column per class."""
    classes, index = np.unique(y, return_inverse=True)
    counts = np.bincount(index)
    weight = (len(y) / (len(classes) * counts))[index] if balanced else np.ones(len(y))
    target = np.where(index[:, None] == np.arange(len(classes)), 1.0, -1.0)
    mx, my = np.average(x, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    xc = (x - mx) * np.sqrt(weight)[:, None]
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ ((target - my) * np.sqrt(weight)[:, None]))
    return classes, w, my - mx @ w


def logistic_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, weights, offsets: multinomial logistic regression, l2 penalty 1 / (2c), by Newton steps on a bound."""
    classes, index = np.unique(y, return_inverse=True)
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.diag(np.r_[np.full(x.shape[1], 1 / c), 1e-9])
    k = len(classes)
    bound = np.linalg.inv(0.5 * (1 - 1 / k) * design.T @ design + penalty + 1e-9 * np.eye(design.shape[1]))
    w = np.zeros((design.shape[1], k))
    hot = np.eye(k)[index]
    for _ in range(rounds * 4):
        logits = design @ w
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = bound @ (design.T @ (p - hot) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return classes, w[:-1], w[-1]


def kernel_matrix(x: np.ndarray, z: np.ndarray, gamma: float, degree: int = 0) -> np.ndarray:
    """exp(-gamma |x - z|^2), or (gamma x.z + 1) ** degree for a degree over 0."""
    if degree:
        return (gamma * x @ z.T + 1) ** degree
    out = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :]
    out -= 2 * x @ z.T
    np.maximum(out, 0, out=out)
    out *= -gamma
    if not out.size or not out.min() <= -746:
        return np.exp(out, out=out)
    none = out <= -746  # the exponential is 0, which takes it five times as long to find out
    np.exp(out, out=out, where=~none)
    out[none] = 0
    return out


class KernelRows:
    """Rows of the kernel of x with itself, in bounded memory: whole where it is small, as singles where it still fits `most` bytes,
    else rows as they are asked for, of which those used last are kept."""

    def __init__(self, x: np.ndarray, gamma: float, degree: int = 0, small: int = 1 << 26, most: int = 3 << 27) -> None:
        n = len(x)
        self.gamma, self.degree, self.whole, self.held = gamma, degree, None, OrderedDict()
        self.kind = np.float64 if n * n * 8 <= small else np.float32
        if self.kind is np.float64:
            self.whole = kernel_matrix(x, x, gamma, degree)
            self.diagonal = self.whole.diagonal().copy()
            return
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.norms = (self.x * self.x).sum(axis=1)
        self.diagonal = (gamma * self.norms.astype(float) + 1) ** degree if degree else np.ones(n)
        if n * n * 4 <= most:
            self.whole = np.empty((n, n), np.float32)
            for a in range(0, n, 256):
                self.whole[a : a + 256] = self._made(slice(a, a + 256))
        self.places = max(2, most // (4 * n))

    def _made(self, rows: slice) -> np.ndarray:
        out = self.x[rows] @ self.x.T
        if self.degree:
            return (np.float32(self.gamma) * out + 1) ** self.degree
        out *= -2
        out += self.norms
        out += self.norms[rows, None]
        np.maximum(out, 0, out=out)
        out *= np.float32(-self.gamma)
        return np.exp(out, out=out)

    def row(self, i: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[i]
        if i in self.held:
            self.held.move_to_end(i)
        else:
            if len(self.held) >= self.places:
                self.held.popitem(last=False)
            self.held[i] = self._made(slice(i, i + 1))[0]
        return self.held[i]


def scale_gamma(x: np.ndarray) -> float:
    """The width that follows from the rows: 1 / (features x variance)."""
    return 1.0 / (x.shape[1] * max(x.var(), 1e-12))


def svm_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, gamma: float | None = None, degree: int = 0, rounds: int = 2000, tol: float = 1e-3, kernel: KernelRows | None = None) -> tuple:
    """Two-class support vectors by sequential minimal optimisation on the pair that violates most; balanced weights.

    Warns if it has not converged in `rounds` steps, or a hundred a row. kernel: that of x, gamma and degree, if at hand. Returns classes,
    support vectors, coefficients, offset, gamma, degree."""
    classes, index = np.unique(y, return_inverse=True)
    t = np.where(index == 1, 1.0, -1.0)
    gamma = gamma or scale_gamma(x)
    kernel = kernel or KernelRows(x, gamma, degree)
    rounds = max(rounds, 100 * len(t))
    limit = c * len(t) / (2 * np.where(t > 0, (t > 0).sum(), (t < 0).sum()))
    # Score: minus t times the gradient, held twice: in one for the rows that may move up, in two for those that may move down, else -inf and
    # inf. Every row may do one of the two. Single numbers are kept as lists.
    one, two = np.where(t > 0, 1.0, -np.inf), np.where(t < 0, -1.0, np.inf)
    apart = np.empty(len(t))
    part = apart if kernel.kind is np.float64 else np.empty(len(t), np.float32)
    alpha, most, side, diagonal = [0.0] * len(t), limit.tolist(), (t > 0).tolist(), kernel.diagonal.tolist()
    may_rise, may_fall = side.copy(), (t < 0).tolist()
    for _ in range(rounds):
        i, j = int(one.argmax()), int(two.argmin())
        gap = float(one[i]) - float(two[j])
        if not gap >= tol:
            break
        row_i, row_j = kernel.row(i), kernel.row(j)
        room_i = most[i] - alpha[i] if side[i] else alpha[i]
        room_j = alpha[j] if side[j] else most[j] - alpha[j]
        move = min(gap / max(diagonal[i] + diagonal[j] - 2 * float(row_i[j]), 1e-12), room_i, room_j)
        alpha[i] += move if side[i] else -move
        alpha[j] += -move if side[j] else move
        np.subtract(row_i, row_j, out=part)
        if part is not apart:
            apart[:] = part
        apart *= move
        one -= apart
        two -= apart
        for k in (i, j):
            up, down = (alpha[k] < most[k], alpha[k] > 0) if side[k] else (alpha[k] > 0, alpha[k] < most[k])
            if up is not may_rise[k] or down is not may_fall[k]:
                own = one[k] if may_rise[k] else two[k]
                one[k], two[k] = own if up else -np.inf, own if down else np.inf
                may_rise[k], may_fall[k] = up, down
    else:
        warnings.warn(f"support vectors of {len(t)} rows not converged in {rounds} steps", RuntimeWarning, stacklevel=2)
    alpha = np.array(alpha)
    free = (alpha > 1e-9) & (alpha < limit - 1e-9)
    offset = np.where(one > -np.inf, one, two)[free].mean() if free.any() else (one.max() + two.min()) / 2
    held = alpha > 1e-9
    return classes, x[held], (alpha * t)[held], offset, gamma, degree


def svm_margin(model: tuple, x: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Rows of x are met with the support vectors some at a time, up to `most` pairs."""
    _, support, coef, offset, gamma, degree = model
    if not len(support):
        return np.full(len(x), -1.0)
    step = max(1, most // len(support))
    return np.concatenate([kernel_matrix(x[a : a + step], support, gamma, degree) @ coef + offset for a in range(0, max(len(x), 1), step)])


def svm_decide(model: tuple, x: np.ndarray) -> np.ndarray:
    return model[0][(svm_margin(model, x) > 0).astype(int)]


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    up, down = x >= 0, x < 0
    out = np.empty_like(x, dtype=float)
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else ((x[up] + 1) ** lam - 1) / lam
    out[down] = -np.log1p(-x[down]) if abs(lam - 2) < 1e-12 else -((1 - x[down]) ** (2 - lam) - 1) / (2 - lam)
    return out


def yeo_johnson_fit(x: np.ndarray, low: float = -3.0, high: float = 5.0, rounds: int = 60) -> float:
    """The exponent of the largest likelihood, by golden section."""

    def loss(lam: float) -> float:
        v = yeo_johnson(x, lam).var()
        return 0.5 * len(x) * np.log(max(v, 1e-300)) - (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    g = (np.sqrt(5) - 1) / 2
    a, b = low, high
    p, q = b - g * (b - a), a + g * (b - a)
    fp, fq = loss(p), loss(q)
    for _ in range(rounds):
        if fp < fq:
            b, q, fq = q, p, fp
            p = b - g * (b - a)
            fp = loss(p)
        else:
            a, p, fp = p, q, fq
            q = a + g * (b - a)
            fq = loss(q)
    return (a + b) / 2


def kth_distance(x: np.ndarray, k: int) -> np.ndarray:
    """Of each value the distance to its k-th nearest other: in one dimension the least reach of the k + 1 neighbours in order that hold it."""
    order = np.argsort(x, kind="stable")
    v = np.concatenate([np.full(k, -np.inf), x[order], np.full(k, np.inf)])
    n, out = len(x), np.full(len(x), np.inf)
    at = np.arange(k, k + n)
    for j in range(k + 1):
        out = np.minimum(out, np.maximum(v[at] - v[at - j], v[at - j + k] - v[at]))
    back = np.empty(n)
    back[order] = out
    return back


def knn_mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Mutual information of a continuous feature and a class by distances to the k-th neighbour of the own class."""
    x = x / max(x.std(), 1e-12) + 1e-10 * np.random.default_rng(seed).standard_normal(len(x))
    order = np.sort(x)
    psi = lambda n: _digamma(np.asarray(n, dtype=float))
    total, used, terms = 0.0, 0, []
    for c in np.unique(y):
        own = x[y == c]
        if len(own) < 2:
            continue
        kk = min(k, len(own) - 1)
        d = kth_distance(own, kk)
        d = d * (1 - 1e-9)  # the k-th neighbour itself stays outside, rounding or not
        m = np.searchsorted(order, own + d, "right") - np.searchsorted(order, own - d, "left")
        terms.append((psi(kk), psi(len(own)), psi(np.maximum(m, 1)), len(own)))
        used += len(own)
    for pk, pn, pm, n in terms:
        total += n * (pk - pn) - pm.sum()
    return float(max(0.0, psi(used) + total / used)) if used else 0.0


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        shift = shift - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))
