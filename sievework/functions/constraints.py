"""Three-valued constraints over the labels chosen for tasks, and exact decoding under them.

A state has, for each task, the labels selected, whether the task is decided and the labels still
possible. SQL's three-valued logic is the one needed, so a constraint compiles to a boolean column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Kleene = bool | None


def k_not(v: Kleene) -> Kleene:
    return None if v is None else not v


def k_and(values: Iterable[Kleene]) -> Kleene:
    seen = list(values)
    return False if False in seen else None if None in seen else True


def k_or(values: Iterable[Kleene]) -> Kleene:
    return k_not(k_and(map(k_not, values)))


def k_implies(a: Kleene, b: Kleene) -> Kleene:
    return k_or((k_not(a), b))


def k_iff(a: Kleene, b: Kleene) -> Kleene:
    return None if a is None or b is None else a == b


@dataclass
class State:
    """Labels of tasks: order of each task's labels, what is selected, which tasks are decided."""

    labels: dict[str, Sequence[str]]
    selected: dict[str, frozenset] = field(default_factory=dict)
    decided: frozenset = frozenset()
    domains: dict[str, frozenset] = field(default_factory=dict)

    def chosen(self, task: str) -> frozenset:
        return self.selected.get(task, frozenset())

    def possible(self, task: str) -> frozenset:
        return self.chosen(task) if task in self.decided else self.domains.get(task, frozenset(self.labels.get(task, ())))

    def holds(self, task: str, label: str) -> Kleene:
        return True if label in self.chosen(task) else None if label in self.possible(task) and task not in self.decided else False


@dataclass(frozen=True)
class Columns:
    """The same as columns: array<string> selected and domain, boolean decided, by task."""

    labels: dict
    selected: dict
    decided: dict
    domain: dict

    def holds(self, task: str, label) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        open_ = F.array_contains(self.domain[task], label) & ~self.decided[task]
        return F.when(F.array_contains(self.selected[task], label), F.lit(True)).when(open_, F.lit(None).cast("boolean")).otherwise(F.lit(False))


class Constraint:
    parts: tuple = ()

    def references(self) -> set[str]:
        return {self.task} if hasattr(self, "task") else set().union(*(p.references() for p in self.parts)) if self.parts else set()

    def still_satisfiable(self, s: State) -> bool:
        return self.evaluate(s) is not False

    def satisfied(self, s: State) -> bool:
        return self.evaluate(s) is True


@dataclass(frozen=True)
class Label(Constraint):
    task: str
    name: str

    def evaluate(self, s):
        return s.holds(self.task, self.name)

    def column(self, c):
        return c.holds(self.task, self.name)


@dataclass(frozen=True)
class Cardinality(Constraint):
    """Between least and most labels of the task."""

    task: str
    least: int = 0
    most: int | None = None

    def evaluate(self, s):
        low, high = len(s.chosen(self.task)), len(s.chosen(self.task) | s.possible(self.task))
        if high < self.least or (self.most is not None and low > self.most):
            return False
        return True if low >= self.least and (self.most is None or high <= self.most) else None

    def column(self, c):
        low = F.size(c.selected[self.task])
        high = F.when(c.decided[self.task], low).otherwise(F.size(F.array_union(c.selected[self.task], c.domain[self.task])))
        most = self.most if self.most is not None else 2**31 - 1
        return F.when((high < self.least) | (low > most), F.lit(False)).when((low >= self.least) & ((high <= most) if self.most is not None else F.lit(True)), F.lit(True))


@dataclass(frozen=True)
class Level(Constraint):
    """The task's label, in declared order, is at (sign 0), at least at (1) or at most at (-1) ``name``."""

    task: str
    name: str
    sign: int = 0

    def _fitting(self, labels) -> list[str]:
        at = list(labels).index(self.name)
        return [x for i, x in enumerate(labels) if (i == at if self.sign == 0 else (i - at) * self.sign >= 0)]

    def evaluate(self, s):
        fit = self._fitting(s.labels[self.task])
        return k_or(s.holds(self.task, x) for x in fit)

    def column(self, c):
        return reduce(lambda a, b: a | b, (c.holds(self.task, x) for x in self._fitting(c.labels[self.task])))


@dataclass(frozen=True)
class Not(Constraint):
    part: Constraint

    @property
    def parts(self):
        return (self.part,)

    def evaluate(self, s):
        return k_not(self.part.evaluate(s))

    def column(self, c):
        return ~self.part.column(c)


@dataclass(frozen=True)
class All(Constraint):
    parts: tuple

    def evaluate(self, s):
        return k_and(p.evaluate(s) for p in self.parts)

    def column(self, c):
        return reduce(lambda a, b: a & b, (p.column(c) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Any(Constraint):
    parts: tuple

    def evaluate(self, s):
        return k_or(p.evaluate(s) for p in self.parts)

    def column(self, c):
        return reduce(lambda a, b: a | b, (p.column(c) for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Iff(Constraint):
    parts: tuple

    def evaluate(self, s):
        return k_iff(self.parts[0].evaluate(s), self.parts[1].evaluate(s))

    def column(self, c):
        return self.parts[0].column(c) == self.parts[1].column(c)


@dataclass(frozen=True)
class ExactlyOne(Constraint):
    parts: tuple

    def evaluate(self, s):
        seen = [p.evaluate(s) for p in self.parts]
        true, open_ = seen.count(True), seen.count(None)
        return False if true > 1 or true + open_ == 0 else True if true == 1 and not open_ else None

    def column(self, c):
        cols = [p.column(c) for p in self.parts]
        true = reduce(lambda a, b: a + b, (F.coalesce(x.cast("int"), F.lit(0)) for x in cols))
        open_ = reduce(lambda a, b: a + b, (x.isNull().cast("int") for x in cols))
        return F.when((true > 1) | (true + open_ == 0), F.lit(False)).when((true == 1) & (open_ == 0), F.lit(True))


def label(task, name):
    return Label(task, name)


def any_selected(task):
    return Cardinality(task, 1)


any_other_selected = any_selected


def is_default(task):
    return Not(any_selected(task))


def at_least(task, k):
    return Cardinality(task, k)


def at_most(task, k):
    return Cardinality(task, 0, k)


def exactly(task, k):
    return Cardinality(task, k, k)


def min_level(task, name):
    return Level(task, name, 1)


def max_level(task, name):
    return Level(task, name, -1)


def at_level(task, name):
    return Level(task, name, 0)


def not_(c):
    return Not(c)


def all_of(cs):
    return All(tuple(cs))


def any_of(cs):
    return Any(tuple(cs))


def implies(a, b):
    return Any((Not(a), b))


def iff(a, b):
    return Iff((a, b))


def excludes(a, b):
    return Not(All((a, b)))


def exactly_one_of(cs):
    return ExactlyOne(tuple(cs))


@dataclass(frozen=True)
class Solution:
    choice: dict
    score: float
    exact: bool


def touching(task: str, constraints: Sequence[Constraint]) -> list[Constraint]:
    return [c for c in constraints if task in c.references()]


def decode(options: dict[str, list[tuple[frozenset, float]]], constraints: Sequence[Constraint], labels: dict[str, Sequence[str]], budget: int = 100_000) -> Solution | None:
    """The choice of one option a task with the highest total utility that breaks no constraint.

    Depth first over tasks, the most constrained first; options by utility, left when even the best of the
    tasks ahead cannot beat what is known. None if nothing fits; exact is false if the budget ran out.
    """
    tasks = sorted(options, key=lambda t: (-len(touching(t, constraints)), t))
    ranked = {t: sorted(options[t], key=lambda o: -o[1]) for t in tasks}
    ahead = [0.0]
    for t in reversed(tasks):
        ahead.append(ahead[-1] + (ranked[t][0][1] if ranked[t] else float("-inf")))
    ahead.reverse()
    domains = {t: frozenset().union(*(o for o, _ in options[t])) for t in tasks}
    best: list = [None, float("-inf")]
    steps = 0

    def go(k: int, chosen: dict, score: float) -> bool:
        nonlocal steps
        if k == len(tasks):
            if score > best[1]:
                best[:] = [dict(chosen), score]
            return True
        t = tasks[k]
        for option, utility in ranked[t]:
            steps += 1
            if steps > budget:
                return False
            if score + utility + ahead[k + 1] <= best[1]:
                break
            chosen[t] = option
            state = State(labels, chosen, frozenset(chosen), domains)
            if all(c.still_satisfiable(state) for c in touching(t, constraints)) and not go(k + 1, chosen, score + utility):
                del chosen[t]
                return False
            chosen.pop(t, None)
        return True

    exact = go(0, {}, 0.0)
    return None if best[0] is None else Solution(best[0], best[1], exact)
