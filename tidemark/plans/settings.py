"""Settings from the environment, read with a default for whatever is missing or malformed."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime

TRUE_WORDS = ("1", "true", "yes", "on")


def env_list(name: str, default: list[str]) -> list[str]:
    """Comma-separated words without blanks; the default if there are none."""
    return [x.strip() for x in os.environ.get(name, "").split(",") if x.strip()] or default


def env_float(name: str, default: float) -> float:
    try:
        return float(os.environ.get(name) or default)
    except ValueError:
        return default


def env_bool(name: str, default: bool) -> bool:
    """True for one of ``TRUE_WORDS``, the default for no text, else false."""
    text = os.environ.get(name) or ""
    return text.strip().lower() in TRUE_WORDS if text else default


def env_datetime(name: str, default: datetime) -> datetime:
    try:
        return datetime.fromisoformat(os.environ.get(name, "").strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class Credentials:
    """Login of a remote bar source."""

    login: int
    password: str
    server: str

    @classmethod
    def from_env(cls, prefix: str = "BARS") -> Credentials | None:
        """``<prefix>_LOGIN``, ``_PASSWORD`` and ``_SERVER``; None if one is missing. Raises ValueError if the login is no number."""
        login, password, server = (os.environ.get(f"{prefix}_{k}") for k in ("LOGIN", "PASSWORD", "SERVER"))
        if not (login and password and server):
            return None
        if not login.lstrip("+-").isdigit():
            raise ValueError(f"{prefix}_LOGIN must be a whole number, not {login!r}")
        return cls(int(login), password, server)


@dataclass(frozen=True)
class Universe:
    """Symbols, timeframes and range of a run."""

    symbols: tuple[str, ...]
    timeframes: tuple[str, ...]
    start: datetime
    end: datetime

    @classmethod
    def from_env(cls, prefix: str = "BARS") -> Universe:
        """``<prefix>_SYMBOLS``, ``_TIMEFRAMES``, ``_START`` and ``_END``; defaults are one pair at half hours over the last year."""
        now = datetime.now().replace(microsecond=0)
        return cls(tuple(env_list(f"{prefix}_SYMBOLS", ["GBPUSD"])), tuple(env_list(f"{prefix}_TIMEFRAMES", ["M30"])), env_datetime(f"{prefix}_START", now.replace(year=now.year - 1, day=min(now.day, 28))), env_datetime(f"{prefix}_END", now))
