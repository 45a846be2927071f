"""The episode machine as a table of rules.

An instrument is idle, watched or confirmed; which of the two an episode is follows from its confirmation date.
A session takes the first rule of the present state whose condition holds. Effects are applied in the order of
EFFECTS, so rules say only what happens, and ages are counted in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date
from decimal import Decimal

from tidemark.functions.scalar import EPISODE_POLICY

# Sessions that a watch and a confirmation last, and the part of the prior high from which a close is watched.
WATCH_SESSIONS, CONFIRMED_SESSIONS, WATCH_BAND = 5, 20, "0.98"


@dataclass(frozen=True)
class Episode:
    id: str
    start: date
    age: int = 0
    confirmed: date | None = None
    confirmed_age: int | None = None
    trigger: object = None
    watch: object = None
    end: date | None = None
    why: str | None = None


@dataclass(frozen=True)
class Bar:
    instrument: str
    day: date
    close: object
    high: object

    @property
    def band(self):
        return (Decimal(WATCH_BAND) if isinstance(self.high, Decimal) else float(WATCH_BAND)) * self.high


CONDITIONS: dict[str, Callable[[Bar, Episode | None], bool]] = {
    "above the prior high": lambda bar, _: bar.close > bar.high,
    "in the band": lambda bar, _: bar.close >= bar.band,
    "below the trigger": lambda bar, episode: bar.close < episode.trigger,
    "watched long enough": lambda _, episode: episode.age >= WATCH_SESSIONS,
    "confirmed long enough": lambda _, episode: episode.confirmed_age >= CONFIRMED_SESSIONS,
    "otherwise": lambda *_: True,
}

EFFECTS: dict[str, Callable[[Bar, Episode | None, str], Episode]] = {
    "open": lambda bar, _, why: Episode(f"{EPISODE_POLICY}/{bar.instrument.lower()}/{bar.day:%Y-%m-%d}", bar.day),
    "confirm": lambda bar, e, why: replace(e, confirmed=bar.day, confirmed_age=0, trigger=bar.high, watch=None),
    "watch": lambda bar, e, why: replace(e, watch=bar.high),
    "count": lambda bar, e, why: replace(e, age=e.age + 1, confirmed_age=None if e.confirmed_age is None else e.confirmed_age + 1),
    "end": lambda bar, e, why: replace(e, end=bar.day, why=why, watch=None),
}

# Condition, setup, reason and effects, by state.
RULES: dict[str, tuple[tuple[str, str, str, tuple[str, ...]], ...]] = {
    "idle": (
        ("above the prior high", "CONFIRMED", "CLOSE_ABOVE_PRIOR_HIGH", ("open", "confirm", "count")),
        ("in the band", "WATCH", "WITHIN_WATCH_BAND", ("open", "watch", "count")),
        ("otherwise", "NONE", "NO_SETUP", ()),
    ),
    "watched": (
        ("watched long enough", "NONE", "WATCH_EXPIRED", ("end",)),
        ("above the prior high", "CONFIRMED", "CLOSE_ABOVE_PRIOR_HIGH", ("confirm", "count")),
        ("in the band", "WATCH", "WITHIN_WATCH_BAND", ("watch", "count")),
        ("otherwise", "NONE", "WATCH_LEFT_BAND", ("count", "end")),
    ),
    "confirmed": (
        ("confirmed long enough", "NONE", "CONFIRMED_EXPIRED", ("end",)),
        ("below the trigger", "FAILED", "CLOSE_BELOW_TRIGGER", ("count", "end")),
        ("otherwise", "CONFIRMED", "AT_OR_ABOVE_TRIGGER", ("count",)),
    ),
}


def advance(episode: Episode | None, bar: Bar, eligibility: str) -> tuple[Episode | None, str, bool, str, Episode | None]:
    """The episode that goes on, and what the session shows: setup, evaluated, reason and the episode it belongs to."""
    if eligibility != "ELIGIBLE" or bar.close is None or bar.high is None:
        why = "INELIGIBLE" if eligibility == "INELIGIBLE" else "DATA_INTERRUPTED"
        return None, "NONE", False, "NOT_EVALUATED", episode and EFFECTS["end"](bar, episode, why)
    state = "idle" if episode is None else "watched" if episode.confirmed is None else "confirmed"
    setup, reason, effects = next((s, r, e) for condition, s, r, e in RULES[state] if CONDITIONS[condition](bar, episode))
    for effect in effects:
        episode = EFFECTS[effect](bar, episode, reason)
    return None if episode is None or episode.end else episode, setup, True, reason, episode
