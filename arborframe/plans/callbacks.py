"""Callbacks of the training loop."""

from __future__ import annotations

import logging
from typing import Any, NamedTuple

_logger = logging.getLogger("arborframe")


def register_logger(logger) -> None:
    """Sends the engine's messages to another logger (with info and warning)."""
    global _logger
    _logger = logger


class Env(NamedTuple):
    model: Any
    params: dict
    iteration: int
    begin_iteration: int
    end_iteration: int
    results: list | None


class EarlyStop(Exception):
    def __init__(self, best_iteration: int, best_score: list):
        super().__init__()
        self.best_iteration, self.best_score = best_iteration, best_score


def log_evaluation(period: int = 1, show_stdv: bool = True):
    def call(env: Env) -> None:
        if period > 0 and env.results and (env.iteration + 1) % period == 0:
            _logger.info("[%d]\t%s", env.iteration + 1, "\t".join(f"{r.dataset}'s {r.metric}: {r.value:g}" + (f" + {r.std:g}" if show_stdv and r.std is not None else "") for r in env.results))

    call.order = 10
    return call


def record_evaluation(history: dict):
    def call(env: Env) -> None:
        for r in env.results or []:
            own = history.setdefault(r.dataset, {})
            if r.std is None:
                own.setdefault(r.metric, []).append(r.value)
            else:
                own.setdefault(f"{r.metric}-mean", []).append(r.value)
                own.setdefault(f"{r.metric}-stdv", []).append(r.std)

    call.order = 20
    return call


def reset_parameter(**schedules):
    """Each value: a list with a value per round, or a function of the round."""

    def call(env: Env) -> None:
        new = {}
        for k, v in schedules.items():
            if isinstance(v, list):
                if len(v) != env.end_iteration - env.begin_iteration:
                    raise ValueError(f"{k}: the list must have a value for each round")
                new[k] = v[env.iteration - env.begin_iteration]
            else:
                new[k] = v(env.iteration - env.begin_iteration)
        changed = {k: v for k, v in new.items() if env.params.get(k) != v}
        if changed:
            env.model.reset_parameter(changed)

    call.before_iteration = True
    call.order = 10
    return call


class EarlyStopping:
    order = 30

    def __init__(self, rounds: int, first_metric_only: bool = False, min_delta: float | list[float] = 0.0):
        if rounds <= 0:
            raise ValueError("stopping rounds must be positive")
        self.rounds, self.first_only, self.min_delta = rounds, first_metric_only, min_delta
        self.best: dict = {}

    def __call__(self, env: Env) -> None:
        if env.iteration == env.begin_iteration:
            self.best = {}
        results = env.results or []
        train = getattr(env.model, "train_name", "training")
        first = next((r.metric.split("@")[0] for r in results), None)
        for r in results:
            if r.dataset in (train, "train"):
                continue
            key = (r.dataset, r.metric)
            delta = self.min_delta if not isinstance(self.min_delta, list) else self.min_delta[0]
            old = self.best.get(key)
            if old is None or (r.value > old[1] + delta if r.higher_better else r.value < old[1] - delta):
                self.best[key] = (env.iteration, r.value, list(results))
            if self.first_only and r.metric.split("@")[0] != first:
                continue
            at, _, scores = self.best[key]
            if env.iteration - at >= self.rounds:
                raise EarlyStop(at, scores)
        if env.iteration == env.end_iteration - 1 and self.best:
            for r in results:
                key = (r.dataset, r.metric)
                if key in self.best and not (self.first_only and r.metric.split("@")[0] != first):
                    raise EarlyStop(self.best[key][0], self.best[key][2])


def early_stopping(stopping_rounds: int, first_metric_only: bool = False, verbose: bool = True, min_delta: float | list[float] = 0.0) -> EarlyStopping:
    return EarlyStopping(stopping_rounds, first_metric_only, min_delta)
