"""Repair actions by name: each takes a specification text and arguments and returns the changed text."""

from __future__ import annotations

from collections.abc import Callable

from trivane.functions import contracts, specs

ACTIONS: dict[str, Callable[..., str]] = {}


def action(name: str):
    """Register a function under a name that isn't taken."""

    def register(f: Callable[..., str]) -> Callable[..., str]:
        if name in ACTIONS:
            raise ValueError(f"action {name} exists")
        ACTIONS[name] = f
        return f

    return register


action("insert_clause")(contracts.insert_clause)
action("remove_clause")(contracts.remove_clause)


@action("mask_contract")
def mask_contract(text: str, name: str) -> str:
    return specs.masked(text, name)[0]


@action("merge_lines")
def merge_lines(text: str, other: str) -> str:
    return specs.merged_lines(text, other)


def apply(name: str, text: str, *args, **kwargs) -> str:
    """The action's result; an unknown name is an error."""
    if name not in ACTIONS:
        raise ValueError(f"unknown action {name}")
    return ACTIONS[name](text, *args, **kwargs)
