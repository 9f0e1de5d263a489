"""A small reverse-mode tensor on NumPy with the layers, losses and optimizers the models need (MD11, MD12)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class Tensor:
    """An array that remembers how it was made. ``back`` adds a gradient to the parents'."""

    def __init__(self, data, parents: tuple[Tensor, ...] = (), back: Callable[[np.ndarray], None] | None = None, trainable: bool = False):
        self.data = np.asarray(data, np.float32)
        self.parents, self.back, self.trainable = parents, back, trainable
        self.grad: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape

    def add_grad(self, g: np.ndarray) -> None:
        while g.ndim > self.data.ndim:
            g = g.sum(axis=0)
        for axis, n in enumerate(self.data.shape):
            if n == 1 and g.shape[axis] != 1:
                g = g.sum(axis=axis, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g

    def backward(self) -> None:
        order: list[Tensor] = []
        seen: set[int] = set()
        stack: list[tuple[Tensor, bool]] = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p in node.parents]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            if node.back and node.grad is not None:
                node.back(node.grad)

    def _made(self, data, back, *others: Tensor) -> Tensor:
        return Tensor(data, (self, *others), back)

    def __add__(self, o) -> Tensor:
        o = as_tensor(o)
        return self._made(self.data + o.data, lambda g: (self.add_grad(g), o.add_grad(g)), o)

    def __sub__(self, o) -> Tensor:
        o = as_tensor(o)
        return self._made(self.data - o.data, lambda g: (self.add_grad(g), o.add_grad(-g)), o)

    def __mul__(self, o) -> Tensor:
        o = as_tensor(o)
        return self._made(self.data * o.data, lambda g: (self.add_grad(g * o.data), o.add_grad(g * self.data)), o)

    def __truediv__(self, o) -> Tensor:
        o = as_tensor(o)
        return self._made(self.data / o.data, lambda g: (self.add_grad(g / o.data), o.add_grad(-g * self.data / o.data**2)), o)

    def __matmul__(self, o: Tensor) -> Tensor:
        def back(g):
            self.add_grad(g @ np.swapaxes(o.data, -1, -2))
            o.add_grad(np.swapaxes(self.data, -1, -2) @ g)

        return self._made(self.data @ o.data, back, o)

    def __neg__(self) -> Tensor:
        return self * -1.0

    __radd__, __rmul__ = __add__, __mul__

    def __pow__(self, n: float) -> Tensor:
        return self._made(self.data**n, lambda g: self.add_grad(g * n * self.data ** (n - 1)))

    def _map(self, value: np.ndarray, slope: np.ndarray) -> Tensor:
        return self._made(value, lambda g: self.add_grad(g * slope))

    def exp(self) -> Tensor:
        v = np.exp(self.data)
        return self._map(v, v)

    def log(self) -> Tensor:
        return self._map(np.log(self.data), 1 / self.data)

    def abs(self) -> Tensor:
        return self._map(np.abs(self.data), np.sign(self.data))

    def sin(self) -> Tensor:
        return self._map(np.sin(self.data), np.cos(self.data))

    def cos(self) -> Tensor:
        return self._map(np.cos(self.data), -np.sin(self.data))

    def sigmoid(self) -> Tensor:
        v = 1 / (1 + np.exp(-np.clip(self.data, -60, 60)))
        return self._map(v, v * (1 - v))

    def relu(self) -> Tensor:
        return self._map(np.maximum(self.data, 0), (self.data > 0).astype(np.float32))

    def sum(self, axis=None, keepdims: bool = False) -> Tensor:
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            self.add_grad(np.broadcast_to(g, self.data.shape))

        return self._made(self.data.sum(axis=axis, keepdims=keepdims), back)

    def mean(self, axis=None, keepdims: bool = False) -> Tensor:
        n = self.data.size if axis is None else self.data.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def softmax(self, axis: int = -1) -> Tensor:
        e = np.exp(self.data - self.data.max(axis=axis, keepdims=True))
        v = e / e.sum(axis=axis, keepdims=True)
        return self._made(v, lambda g: self.add_grad(v * (g - (g * v).sum(axis=axis, keepdims=True))))

    def reshape(self, *shape: int) -> Tensor:
        return self._made(self.data.reshape(shape), lambda g: self.add_grad(g.reshape(self.data.shape)))

    def flatten(self) -> Tensor:
        return self.reshape(len(self.data), -1)

    def broadcast(self, *shape: int) -> Tensor:
        return self._made(np.broadcast_to(self.data, shape), self.add_grad)

    def take(self, rows: np.ndarray) -> Tensor:
        """Rows of a table by number: the embedding lookup."""

        def back(g):
            total = np.zeros_like(self.data)
            np.add.at(total, rows, g)
            self.add_grad(total)

        return self._made(self.data[rows], back)


def as_tensor(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def mse(predicted: Tensor, target: np.ndarray) -> Tensor:
    return ((predicted - target) ** 2).mean()


def bce_with_logits(logits: Tensor, target: np.ndarray) -> Tensor:
    """Mean of ln(1 + exp(-t x)) for targets +1 and -1."""
    margin = logits.data * target
    value = np.logaddexp(0, -margin)
    slope = -target / (1 + np.exp(np.clip(margin, -60, 60))) / value.size
    return Tensor(value.mean(), (logits,), lambda g: logits.add_grad(g * slope))


def softmax_cross_entropy(logits: Tensor, target: np.ndarray) -> Tensor:
    e = np.exp(logits.data - logits.data.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    rows = np.arange(len(target))

    def back(g):
        d = p.copy()
        d[rows, target] -= 1
        logits.add_grad(g * d / len(target))

    return Tensor(-np.log(np.maximum(p[rows, target], 1e-30)).mean(), (logits,), back)


class Linear:
    def __init__(self, n: int, m: int, rng: np.random.Generator):
        bound = 1 / np.sqrt(n)
        self.w, self.b = Tensor(rng.uniform(-bound, bound, (n, m)), trainable=True), Tensor(np.zeros(m), trainable=True)

    def __call__(self, x: Tensor) -> Tensor:
        return x @ self.w + self.b

    def parameters(self) -> list[Tensor]:
        return [self.w, self.b]


class Attention:
    """Weights over the rows of a set from a two-layer score of each row, and their weighted sum."""

    def __init__(self, n: int, hidden: int, rng: np.random.Generator):
        self.one, self.two = Linear(n, hidden, rng), Linear(hidden, 1, rng)

    def __call__(self, x: Tensor) -> Tensor:
        return (self.two(self.one(x).relu()).softmax(axis=-2) * x).sum(axis=-2)

    def parameters(self) -> list[Tensor]:
        return self.one.parameters() + self.two.parameters()


class Sgd:
    def __init__(self, parameters: Iterable[Tensor], rate: float, decay: float = 0.0):
        self.parameters, self.rate, self.decay = list(parameters), rate, decay

    def step(self) -> None:
        for p in self.parameters:
            if p.grad is not None:
                p.data -= self.rate * (p.grad + self.decay * p.data)
                p.grad = None


class Adam(Sgd):
    def __init__(self, parameters: Iterable[Tensor], rate: float = 0.001, decay: float = 0.0, betas: tuple[float, float] = (0.9, 0.999)):
        super().__init__(parameters, rate, decay)
        self.betas, self.t = betas, 0
        self.m, self.v = [np.zeros_like(p.data) for p in self.parameters], [np.zeros_like(p.data) for p in self.parameters]

    def step(self) -> None:
        self.t += 1
        b1, b2 = self.betas
        for i, p in enumerate(self.parameters):
            if p.grad is not None:
                g = p.grad + self.decay * p.data
                self.m[i] = b1 * self.m[i] + (1 - b1) * g
                self.v[i] = b2 * self.v[i] + (1 - b2) * g * g
                p.data -= self.rate * (self.m[i] / (1 - b1**self.t)) / (np.sqrt(self.v[i] / (1 - b2**self.t)) + 1e-8)
                p.grad = None
