"""Decisions: their questions, prompts, probabilities and answers, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("noul", "score", "choice")


@dataclass(frozen=True)
class DecisionSpec:
    """A question with its ordered answers: ``noul`` is false or true, ``score`` 0 to 5, ``choice`` 2 to 16 lines."""

    question: str
    kind: str = "noul"
    options: tuple = (False, True)

    @classmethod
    def create(cls, question: str, kind: str = "noul", options: Sequence[str] | None = None) -> DecisionSpec:
        if not isinstance(question, str) or not question.strip():
            raise ValueError("a question must be given")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if kind != "choice":
            if options is not None:
                raise ValueError(f"the options of {kind} are fixed")
            return cls(question, kind, (False, True) if kind == "noul" else (0, 1, 2, 3, 4, 5))
        if options is None or isinstance(options, str):
            raise ValueError("choice needs 2 to 16 options")
        labels = tuple(options)
        if not 2 <= len(labels) <= 16 or not all(isinstance(x, str) and x.strip() for x in labels):
            raise ValueError("choice needs 2 to 16 options, none of them empty")
        if len(set(labels)) < len(labels) or any(set(x) & {"\n", "\r"} for x in labels):
            raise ValueError("options must differ and have one line each")
        return cls(question, kind, labels)

    @property
    def lines(self) -> list[str]:
        if self.kind == "noul":
            return ["false", "true"]
        return [f"{'ABCDEFGHIJKLMNOP'[i]}) {x}" if self.kind == "choice" else str(x) for i, x in enumerate(self.options)]

    @property
    def labels(self) -> tuple[str, ...]:
        return ("no", "yes") if self.kind == "noul" else tuple(map(str, self.options))

    # Fixed format: the template that decision models are trained on.
    def before(self) -> str:
        return f"[kind] {self.kind}\n[state] "

    def after(self) -> str:
        return f"\n[question] {self.question}\n[options]\n" + "\n".join(self.lines) + "\n[decision]:"

    def prompt(self, state: str) -> str:
        return self.before() + state + self.after()

    def prompt_column(self, state: Column) -> Column:
        return F.concat(F.lit(self.before()), state, F.lit(self.after()))

    def option_columns(self) -> list[str]:
        """Names of the columns with each option's probability; equal ones get a number."""
        names: list[str] = []
        for x in self.options:
            name, n = f"p_{str(x).lower()}", 2
            while name in names:
                name, n = f"p_{str(x).lower()}_{n}", n + 1
            names.append(name)
        return names


@dataclass(frozen=True)
class DecisionResponse:
    probabilities: tuple[float, ...]
    prompt_tokens: int | None = None
    cached_tokens: int | None = None
    completion_tokens: int | None = None
    created_cache_tokens: int | None = None
    queue_time_ms: float | None = None
    time_to_first_token_ms: float | None = None
    generation_time_ms: float | None = None
    request_id: str | None = None


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax(logs: Column, bias: Column | None = None, temperature: float = 1.0) -> Column:
    """(log + bias) / temperature of each, raised and normalised; the largest is taken off first."""
    scores = F.transform(logs, lambda x: x / temperature) if bias is None else F.zip_with(logs, bias, lambda x, b: (x + b) / temperature)
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return normalised(raised)


def normalised(p: Column) -> Column:
    return F.transform(p, lambda x: x / total(p))


def valid(p: Column, n: int) -> Column:
    """Whether p is a distribution over n options: finite, none negative, a sum of 1 within a millionth."""
    good = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((F.size(p) == n) & good & (F.abs(total(p) - 1) <= 1e-6), F.lit(False))


def shares(weights: Sequence[float]) -> tuple[float, ...]:
    """Weights as parts of their sum."""
    whole = math.fsum(weights)
    return tuple(w / whole for w in weights)


def raised(scores: Sequence[float]) -> tuple[float, ...]:
    """The softmax of scores, as ``softmax`` gives it for columns."""
    return shares([math.exp(s - max(scores)) for s in scores])


def valid_response(p: Sequence[float], n: int) -> bool:
    return len(p) == n and all(math.isfinite(x) and x >= 0 for x in p) and abs(sum(p) - 1) <= 1e-6


def decided(p: Column, options: Sequence) -> Column:
    """The first option with the largest probability, as text of ``options``."""
    return F.element_at(F.array(*(F.lit(str(x)) for x in options)), F.array_position(p, F.array_max(p)).cast("int"))
