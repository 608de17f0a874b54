"""Named steps over a table: replayable, described in words, with undo and redo."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

UNDO_LIMIT = 5

_OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def register_op(name: str) -> Callable:
    """Decorator: make a ``DataFrame -> DataFrame`` function available to recipes by name."""

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _OPERATORS[name] = fn
        return fn

    return keep


def registered_op(name: str) -> Callable[..., DataFrame]:
    if name not in _OPERATORS:
        raise ValueError(f"no operator {name!r}; known: {sorted(_OPERATORS)}")
    return _OPERATORS[name]


@dataclass(frozen=True)
class Step:
    """One operator call and how to describe it."""

    fn: Callable[..., DataFrame]
    args: tuple = ()
    options: dict = field(default_factory=dict)
    text: str = ""

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.fn(df, *self.args, **self.options)

    def describe(self) -> str:
        if self.text:
            return self.text
        values = [repr(a) for a in self.args] + [f"{k}={v!r}" for k, v in self.options.items()]
        return f"{self.fn.__name__.replace('_', ' ')}: {', '.join(values)}" if values else self.fn.__name__.replace("_", " ")


class Recipe:
    """A list of steps. Running it only builds a plan; Spark executes when a result is asked for."""

    def __init__(self, steps: list[Step] | None = None, undo_limit: int = UNDO_LIMIT):
        self._undo_limit = undo_limit
        self.steps: list[Step] = list(steps or [])
        self._undone: list[Step] = []
        self._undoable = 0

    def add(self, fn: Callable[..., DataFrame] | str, *args, text: str = "", **options) -> "Recipe":
        fn = registered_op(fn) if isinstance(fn, str) else fn
        self.steps.append(Step(fn, args, options, text))
        self._undone.clear()
        self._undoable = min(self._undo_limit, self._undoable + 1)
        return self

    def undo(self) -> "Recipe":
        if not self._undoable:
            raise ValueError("nothing to undo")
        self._undone.append(self.steps.pop())
        self._undoable -= 1
        return self

    def redo(self) -> "Recipe":
        if not self._undone:
            raise ValueError("nothing to redo")
        self.steps.append(self._undone.pop())
        self._undoable = min(self._undo_limit, self._undoable + 1)
        return self

    def describe(self) -> list[str]:
        return [f"{i}. {s.describe()}" for i, s in enumerate(self.steps, 1)]

    def run(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        for step in self.steps[:upto]:
            df = step(df)
        return df
