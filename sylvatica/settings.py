"""Configuration of a trial from the environment, and the text of its command: driver-side, no rows involved."""

from __future__ import annotations

import hmac
import os
import shlex
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Defaults of a run.
DEFAULT_WORKERS, DEFAULT_TIMEOUT, DEFAULT_MODEL, DEFAULT_MODE = 3, 75.0, "mock-local", "mock"
MODES = ("mock", "command")


def listed(value: str) -> list[str]:
    """The parts between commas, stripped, without blank ones."""
    return [part.strip() for part in value.split(",") if part.strip()]


def whole_or_text(value: str) -> int | str:
    try:
        return int(value)
    except ValueError:
        return value


@dataclass(frozen=True)
class TrialSettings:
    models: list[str] = field(default_factory=lambda: [DEFAULT_MODEL])
    features: list[str] = field(default_factory=list)
    workers: int = DEFAULT_WORKERS
    sample_limit: str = ""
    mode: str = DEFAULT_MODE
    command: str = ""
    timeout: float = DEFAULT_TIMEOUT

    @classmethod
    def from_environment(cls, values: Mapping[str, str] | None = None, prefix: str = "EXPERIMENT_") -> TrialSettings:
        """Settings from variables with a prefix; blank ones count as not set, and an unknown mode is an error."""
        given = {k.removeprefix(prefix): v.strip() for k, v in (os.environ if values is None else values).items() if k.startswith(prefix) and v.strip()}
        mode = given.get("MODEL_MODE", DEFAULT_MODE).lower()
        if mode not in MODES:
            raise ValueError(f"unsupported mode: {mode}")
        return cls(
            listed(given.get("MODELS", DEFAULT_MODEL)), listed(given.get("FEATURES", "")), int(given.get("WORKERS", DEFAULT_WORKERS)), given.get("SAMPLE_LIMIT", ""),
            mode, given.get("MODEL_COMMAND", ""), float(given.get("MODEL_COMMAND_TIMEOUT", DEFAULT_TIMEOUT)),
        )

    @property
    def limit(self) -> int | None:
        """The number of sample rows; "0" is none of them, "" is all."""
        return int(self.sample_limit) if self.sample_limit else None


def command_text(program: list[str], arguments: list[str]) -> str:
    """A command line that a shell reads back as the same words."""
    return " ".join([*program, *map(shlex.quote, arguments)]).rstrip()


def same_key(presented: str | None, required: str | None) -> bool:
    """Whether a presented key is the required one, in constant time; without a required key all are let in."""
    return required is None or hmac.compare_digest((presented or "").encode(), required.encode())
