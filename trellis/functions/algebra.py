"""Vectors, matrices and complex numbers as Python tuples of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]
Matrix = Sequence[Sequence[Column]]


def elemental(f: Callable) -> Callable:
    """Lifts a function of scalars over (nested) lists of one shape; scalars go along."""

    @wraps(f)
    def lifted(*args):
        long = next((a for a in args if isinstance(a, (list, tuple))), None)
        if long is None:
            return f(*args)
        return [lifted(*(a[i] if isinstance(a, (list, tuple)) else a for a in args)) for i in range(len(long))]

    return lifted


add = elemental(lambda a, b: a + b)
sub = elemental(lambda a, b: a - b)
mul = elemental(lambda a, b: a * b)
div = elemental(lambda a, b: a / b)
neg = elemental(lambda a: -a)


def total(a: Sequence[Column]) -> Column:
    out = a[0]
    for x in a[1:]:
        out = out + x
    return out


def dot(a: Vector, b: Vector) -> Column:
    return total([x * y for x, y in zip(a, b)])


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def matvec(m: Matrix, v: Vector) -> list[Column]:
    return [dot(r, v) for r in m]


def matmul(a: Matrix, b: Matrix) -> list[list[Column]]:
    return [[dot(r, c) for c in zip(*b)] for r in a]


def transpose(m: Matrix) -> list[list[Column]]:
    return [list(c) for c in zip(*m)]


def trace(m: Matrix) -> Column:
    return total([m[i][i] for i in range(len(m))])


def determinant(m: Matrix) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def symmetric(xx, yy, zz, xy, xz, yz) -> list[list[Column]]:
    return [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]


def largest(m: Sequence) -> Column:
    flat = [c for r in m for c in (r if isinstance(r, (list, tuple)) else [r])]
    return F.greatest(*flat)


class Complex:
    """re and im columns."""

    def __init__(self, re: Column, im: Column | float = 0.0):
        self.re, self.im = re, im if isinstance(im, Column) else F.lit(float(im))

    @classmethod
    def of(cls, struct: str) -> Complex:
        return cls(F.col(f"{struct}.re"), F.col(f"{struct}.im"))

    def column(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))

    def __add__(self, o):
        o = o if isinstance(o, Complex) else Complex(o if isinstance(o, Column) else F.lit(float(o)))
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        return self + (-o)

    def __neg__(self):
        return Complex(-self.re, -self.im)

    def __mul__(self, o):
        o = o if isinstance(o, Complex) else Complex(o if isinstance(o, Column) else F.lit(float(o)))
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o):
        o = o if isinstance(o, Complex) else Complex(o if isinstance(o, Column) else F.lit(float(o)))
        n = o.re * o.re + o.im * o.im
        p = self * o.conjugate()
        return Complex(p.re / n, p.im / n)

    def conjugate(self):
        return Complex(self.re, -self.im)

    def abs(self) -> Column:
        return F.sqrt(self.re * self.re + self.im * self.im)

    def exp(self):
        e = F.exp(self.re)
        return Complex(e * F.cos(self.im), e * F.sin(self.im))
