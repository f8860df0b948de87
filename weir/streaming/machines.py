"""Per-row state and windows as small state machines, for the operators that Spark's own streaming state can't express.

A machine is fed rows in arrival order and can be pickled between micro-batches.
"""

from __future__ import annotations

import copy
from collections import deque
from dataclasses import dataclass, field

from ..operators import stateful


def null(x):
    return x is None or x != x


@dataclass
class Lag:
    n: int = 1
    ignore_null: bool = True
    seen: list = field(default_factory=list)

    def step(self, accept: bool, args: list):
        out = self.seen[0] if len(self.seen) == self.n else None
        if accept and not (self.ignore_null and null(args[0])):
            self.seen = [*self.seen, args[0]][-self.n :]
        return out


@dataclass
class Latest:
    value: object = None

    def step(self, accept: bool, args: list):
        if accept and not null(args[0]):
            self.value = args[0]
        return self.value


@dataclass
class Changed:
    """Of each tracked argument, whether it differs from the last accepted one."""

    ignore_null: bool
    values: bool
    before: dict = field(default_factory=dict)

    def step(self, accept: bool, args: list):
        changed = False
        for i, x in enumerate(args):
            x = None if null(x) else x
            if not accept or self.ignore_null and x is None:
                continue
            # what was never seen counts as null
            changed |= self.before.get(i) != x
            self.before[i] = x
        return (args[0] if changed else None) if self.values else changed


@dataclass
class Accumulated:
    kind: str
    lived: bool = False
    on: bool = False
    n: int = 0
    total: float = 0.0
    least: float | None = None
    most: float | None = None

    def step(self, accept: bool, args: list):
        x, begin, reset = args if self.lived else (*args, False, False)
        self.on |= not self.lived or bool(begin) and not null(begin)
        if self.on and accept and not null(x):
            self.n += 1
            if self.kind != "acc_count":
                x = float(x)
                self.total += x
                self.least = x if self.least is None else min(self.least, x)
                self.most = x if self.most is None else max(self.most, x)
        out = {"acc_count": self.n, "acc_sum": self.total, "acc_avg": self.total / self.n if self.n else 0.0, "acc_min": self.least or 0.0, "acc_max": self.most or 0.0}[self.kind]
        if reset and not null(reset):
            self.on, self.n, self.total, self.least, self.most = False, 0, 0.0, None, None
        return out


def machine(name: str, literals: list):
    """The machine of a call, and which of its arguments are fed to it."""
    if name in stateful.FOLDS:
        fold = stateful.FOLDS[name]
        return Folded(fold.step, fold.start()), list(range(len(literals)))
    if name == "lag":
        return Lag(literals[1] if len(literals) > 1 else 1, literals[2] if len(literals) > 2 else True), [0]
    if name == "latest":
        return Latest(), [0]
    if name in ("changed_col", "had_changed"):
        return Changed(literals[0], name == "changed_col"), list(range(1, len(literals)))
    return Accumulated(name, len(literals) == 3), list(range(len(literals)))


@dataclass
class Folded:
    """A user's function: ``step(state, accepted, arguments)`` gives the new state and the value."""

    function: object
    state: object

    def step(self, accept: bool, args: list):
        self.state, out = self.function(self.state, accept, args)
        return out


def saved(own: list) -> list:
    """What is kept of machines between micro-batches; of a user's function its state alone."""
    return [m.state if isinstance(m, Folded) else m for m in own]


def restored(fresh: list, kept: list | None) -> list:
    """Machines as they were when they were saved, or new ones."""
    if kept is None:
        return copy.deepcopy(fresh)
    return [Folded(m.function, x) if isinstance(m, Folded) else x for m, x in zip(fresh, kept)]


@dataclass
class CountWindow:
    rows: int
    index: int = 0
    held: list = field(default_factory=list)

    def step(self, row: tuple, open_: bool = False, emit: bool = False):
        self.held.append(row)
        if len(self.held) == self.rows:
            out, self.held, self.index = [(self.index, r) for r in self.held], [], self.index + 1
            return out
        return []


@dataclass
class StateWindow:
    active: bool = False
    index: int = 0
    held: list = field(default_factory=list)

    def step(self, row: tuple, open_: bool = False, emit: bool = False):
        if not self.active:
            if open_:
                self.active, self.held, self.index = True, [row], self.index + 1
            return []
        self.held.append(row)
        if not emit:
            return []
        out, self.held, self.active = [(self.index, r) for r in self.held], [], False
        return out


@dataclass
class SlidingWindow:
    """Rows of the last ``back`` microseconds for every row, and with ``ahead`` of the next ones, once a row beyond them comes; time ascends with arrival."""

    back: int
    ahead: int = 0
    held: deque = field(default_factory=deque)
    waiting: deque = field(default_factory=deque)

    def step_at(self, row: tuple, at: int, seq: int):
        out = []
        while self.waiting and self.waiting[0][0] + self.ahead < at:
            t, number = self.waiting.popleft()
            out += [(number, r) for u, r in self.held if t - self.back <= u <= t + self.ahead]
        self.held.append((at, row))
        oldest = self.waiting[0][0] if self.waiting else at
        while self.held and self.held[0][0] < oldest - self.back:
            self.held.popleft()
        if self.ahead:
            self.waiting.append((at, seq))
            return out
        return [(seq, r) for t, r in self.held if t <= at]
