"""Fuzzy inference as column expressions, from the published definitions.

Which terms and rules the surveyed classifier used is not known; engines here are our own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = Callable[[Column], Column]
ZERO, ONE = 0.0, 1.0


def _clamp(x: Column) -> Column:
    return F.least(F.lit(ONE), F.greatest(F.lit(ZERO), x))


def triangle(a: float, b: float, c: float) -> Term:
    return lambda x: F.when((x < a) | (x > c), ZERO).when(x == b, ONE).when(x < b, (x - a) / ((b - a) or 1.0)).otherwise((c - x) / ((c - b) or 1.0))


def trapezoid(a: float, b: float, c: float, d: float) -> Term:
    return lambda x: F.when((x < a) | (x > d), ZERO).when(x < b, (x - a) / ((b - a) or 1.0)).when(x <= c, ONE).otherwise((d - x) / ((d - c) or 1.0))


def rectangle(a: float, b: float) -> Term:
    return lambda x: F.when(x.between(a, b), ONE).otherwise(ZERO)


def ramp(a: float, b: float) -> Term:
    """Rises from a to b; falls where a is above b."""
    return lambda x: _clamp((x - a) / (b - a)) if a != b else F.lit(ZERO)


def gaussian(mean: float, sigma: float) -> Term:
    return lambda x: F.exp(-((x - mean) * (x - mean)) / (2.0 * sigma * sigma))


def gaussian_product(mean_a: float, sigma_a: float, mean_b: float, sigma_b: float) -> Term:
    return lambda x: F.when(x < mean_a, gaussian(mean_a, sigma_a)(x)).otherwise(ONE) * F.when(x > mean_b, gaussian(mean_b, sigma_b)(x)).otherwise(ONE)


def bell(center: float, width: float, slope: float) -> Term:
    return lambda x: ONE / (ONE + F.pow(F.abs((x - center) / width), F.lit(2.0 * slope)))


def sigmoid(inflection: float, slope: float) -> Term:
    return lambda x: ONE / (ONE + F.exp(-slope * (x - inflection)))


def sigmoid_difference(left: float, rise: float, fall: float, right: float) -> Term:
    return lambda x: F.abs(sigmoid(left, rise)(x) - sigmoid(right, fall)(x))


def sigmoid_product(left: float, rise: float, fall: float, right: float) -> Term:
    return lambda x: sigmoid(left, rise)(x) * sigmoid(right, fall)(x)


def s_shape(a: float, b: float) -> Term:
    return lambda x: F.when(x <= a, ZERO).when(x <= (a + b) / 2, 2 * F.pow((x - a) / (b - a), F.lit(2.0))).when(x < b, ONE - 2 * F.pow((x - b) / (b - a), F.lit(2.0))).otherwise(ONE)


def z_shape(a: float, b: float) -> Term:
    return lambda x: ONE - s_shape(a, b)(x)


def pi_shape(a: float, b: float, c: float, d: float) -> Term:
    return lambda x: s_shape(a, b)(x) * z_shape(c, d)(x)


def discrete(points: list[tuple[float, float]]) -> Term:
    """Linear between the points, and the outer points' values beyond them."""
    p = sorted(points)

    def at(x: Column) -> Column:
        out = F.when(x <= p[0][0], p[0][1])
        for (x0, y0), (x1, y1) in zip(p, p[1:], strict=False):
            out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / ((x1 - x0) or 1.0)))
        return out.otherwise(p[-1][1])

    return at


def thresholded(term: Term, level: Column, norm: Callable | None = None) -> Term:
    """A term cut by how far its rule holds."""
    return lambda x: (norm or T_NORMS["minimum"])(term(x), level)


def accumulated(terms: list[Term], norm: Callable | None = None) -> Term:
    return lambda x: reduce(norm or S_NORMS["maximum"], [t(x) for t in terms])


T_NORMS: dict[str, Callable[[Column, Column], Column]] = {
    "minimum": lambda a, b: F.least(a, b),
    "algebraic_product": lambda a, b: a * b,
    "bounded_difference": lambda a, b: F.greatest(F.lit(ZERO), a + b - ONE),
    "drastic_product": lambda a, b: F.when(F.greatest(a, b) == ONE, F.least(a, b)).otherwise(ZERO),
    "einstein_product": lambda a, b: a * b / (2.0 - (a + b - a * b)),
    "hamacher_product": lambda a, b: F.when(a + b - a * b == 0, ZERO).otherwise(a * b / (a + b - a * b)),
}
S_NORMS: dict[str, Callable[[Column, Column], Column]] = {
    "maximum": lambda a, b: F.greatest(a, b),
    "algebraic_sum": lambda a, b: a + b - a * b,
    "bounded_sum": lambda a, b: F.least(F.lit(ONE), a + b),
    "normalized_sum": lambda a, b: (a + b) / F.greatest(F.lit(ONE), a + b),
    "drastic_sum": lambda a, b: F.when(F.least(a, b) == ZERO, F.greatest(a, b)).otherwise(ONE),
    "einstein_sum": lambda a, b: (a + b) / (ONE + a * b),
    "hamacher_sum": lambda a, b: F.when(a * b == ONE, ONE).otherwise((a + b - 2.0 * a * b) / (ONE - a * b)),
}
HEDGES: dict[str, Callable[[Column], Column]] = {
    "not": lambda x: ONE - x,
    "very": lambda x: x * x,
    "somewhat": lambda x: F.sqrt(x),
    "seldom": lambda x: F.when(x <= 0.5, F.sqrt(x / 2.0)).otherwise(ONE - F.sqrt((ONE - x) / 2.0)),
    "extremely": lambda x: F.when(x <= 0.5, 2.0 * x * x).otherwise(ONE - 2.0 * (ONE - x) * (ONE - x)),
    "any": lambda x: F.when(x.isNotNull(), ONE),
}


def samples(low: float, high: float, n: int) -> Column:
    """Middles of n equal parts of a range."""
    return F.array(*(F.lit(low + (i + 0.5) * (high - low) / n) for i in range(n)))


def centroid(term: Term, low: float, high: float, n: int = 100) -> Column:
    """Centre of gravity of a term over a range; null where the term is 0 throughout."""
    x = samples(low, high, n)
    area = F.aggregate(x, F.lit(ZERO), lambda s, v: s + term(v))
    moment = F.aggregate(x, F.lit(ZERO), lambda s, v: s + v * term(v))
    return F.when(area > 0, moment / area)


def of_maximum(term: Term, low: float, high: float, which: str = "mean", n: int = 100) -> Column:
    """The smallest, largest or mean sample at which a term is greatest."""
    x = samples(low, high, n)
    most = F.array_max(F.transform(x, term))
    at = F.filter(x, lambda v: term(v) == most)
    return {"smallest": F.array_min(at), "largest": F.array_max(at), "mean": (F.array_min(at) + F.array_max(at)) / 2}[which]


@dataclass
class Engine:
    """Inputs and outputs with named terms, and rules such as 'if size is small and hue is not near then match is low with 0.5'."""

    inputs: dict[str, dict[str, Term]]
    output: tuple[str, dict[str, Term], float, float]
    rules: list[str] = field(default_factory=list)
    t_norm: str = "minimum"
    s_norm: str = "maximum"
    activation: str = "minimum"
    accumulation: str = "maximum"
    default: float | None = None

    def _proposition(self, words: list[str], values: dict[str, Column]) -> Column:
        name, is_, *hedges, term = words
        if is_ != "is" or name not in self.inputs:
            raise ValueError(f"not a proposition: {' '.join(words)}")
        x = HEDGES["any"](values[name]) if term == "any" else self.inputs[name][term](values[name])
        for h in reversed(hedges):
            x = HEDGES[h](x)
        return x

    def firing(self, rule: str, values: dict[str, Column]) -> tuple[Column, str]:
        """How far a rule holds, and the output's term it speaks of; 'and' binds before 'or'."""
        words = rule.split()
        if words[0] != "if" or "then" not in words:
            raise ValueError(f"not a rule: {rule}")
        head, tail = words[1 : words.index("then")], words[words.index("then") + 1 :]
        weight = float(tail[tail.index("with") + 1]) if "with" in tail else ONE
        split = lambda ws, by: [list(filter(None, g.split(" "))) for g in " ".join(ws).split(f" {by} ")]
        ors = [reduce(T_NORMS[self.t_norm], [self._proposition(p, values) for p in split(g, "and")]) for g in split(head, "or")]
        if tail[:2] != [self.output[0], "is"]:
            raise ValueError(f"not the output: {rule}")
        return reduce(S_NORMS[self.s_norm], ors) * weight, tail[2]

    def levels(self, values: dict[str, Column]) -> list[Column]:
        """How far each rule holds: to be made columns before the output is taken, so that they are computed once."""
        return [self.firing(r, values)[0] for r in self.rules]

    def conclude(self, levels: list[Column], n: int = 100) -> Column:
        """The output by centre of gravity, from the rules' levels; the default where no rule fires."""
        _, terms, low, high = self.output
        spoken = [r.split()[r.split().index("then") + 3] for r in self.rules]
        cut = [thresholded(terms[t], level, T_NORMS[self.activation]) for t, level in zip(spoken, levels, strict=True)]
        out = centroid(accumulated(cut, S_NORMS[self.accumulation]), low, high, n)
        return out if self.default is None else F.coalesce(out, F.lit(self.default))

    def process(self, values: dict[str, Column], n: int = 100) -> Column:
        return self.conclude(self.levels(values), n)
