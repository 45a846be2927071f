"""Registered queries by family."""

from importlib import import_module

FAMILIES = ("market", "calendar_days", "technical", "health", "screening", "portfolio", "research", "replays", "evidence", "binding", "execution", "fundamental", "ingest", "scalar", "streams")


def load_all() -> None:
    for family in FAMILIES:
        try:
            import_module(f"tidemark.plans.{family}")
        except ModuleNotFoundError as error:
            if error.name != f"tidemark.plans.{family}":
                raise
