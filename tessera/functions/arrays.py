"""Vector arithmetic on array<double> columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def required(value: Column, message: str) -> Column:
    """``value``, or an error where it is NULL: for keys that a join must find."""
    return F.coalesce(value, F.raise_error(F.lit(message)))


def known(value: Column, values, message: str) -> Column:
    """``value`` if it is one of ``values``, else an error."""
    return F.when(value.isin(list(values)), value).otherwise(F.raise_error(F.lit(message)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, c: Column) -> Column:
    return F.transform(a, lambda x: x * c)


def sum_squares(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(sum_squares(a))


def unit(a: Column) -> Column:
    """Unit-length vector; every element NULL where the length is zero."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x, n)))


def softmax(a: Column) -> Column:
    """Softmax after subtracting the largest element, so large scores cannot overflow."""
    return let(
        let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m))),
        lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)),
    )


def log_softmax(a: Column) -> Column:
    return let(
        F.array_max(a),
        lambda m: let(
            m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))),
            lambda z: F.transform(a, lambda x: x - z),
        ),
    )


def argmax(a: Column) -> Column:
    """Index of the largest element; the lowest index wins ties."""
    return F.array_position(a, F.array_max(a)) - 1


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def fill_missing(a: Column, value: float = 0.0) -> Column:
    return F.transform(a, lambda x: F.coalesce(x, F.lit(value)))


def has_missing(a: Column) -> Column:
    return a.isNull() | F.exists(a, lambda x: x.isNull())


def literal(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def literal_rows(matrix) -> Column:
    """A small driver-side matrix as array<array<double>>, one inner array per row."""
    return F.array(*[literal(row) for row in matrix])


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def nan_to_null(a: Column) -> Column:
    """NaN elements become NULL, the engine's only missing value."""
    return F.transform(a, lambda x: F.when(F.isnan(x), F.lit(None)).otherwise(x))


def sum_elements(a: Column, width: int) -> list[Column]:
    """One sum aggregate per element: an element-wise vector sum with map-side combine."""
    return [F.sum(a[i]) for i in range(width)]
