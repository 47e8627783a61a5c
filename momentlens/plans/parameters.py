"""Parameters of plans from environment variables and command lines.

Any dataclass of plain fields serves, such as ``Profile`` and ``Condense``. A variable is the field's name in capitals behind a prefix, an option the name with
dashes. Texts become what the field's default is; what can't, and options that no field has, is an error. Options go before variables, and those before defaults.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import MISSING, fields, is_dataclass, replace
from typing import TypeVar

P = TypeVar("P")


def _plain(default: object) -> bool:
    return isinstance(default, (bool, int, float, str))


def _value(name: str, text: str, default: object) -> object:
    """``text`` as the type of a default."""
    if isinstance(default, bool):
        known = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
        if text.strip().lower() not in known:
            raise ValueError(f"{name}: {text!r} is neither true nor false")
        return known[text.strip().lower()]
    try:
        return type(default)(text.strip()) if not isinstance(default, str) else text
    except ValueError as e:
        raise ValueError(f"{name}: {text!r} isn't a number") from e


def _plain_fields(of: object) -> dict[str, object]:
    return {f.name: getattr(of, f.name) for f in fields(of) if f.default is not MISSING and _plain(getattr(of, f.name))}


def from_environment(defaults: P, prefix: str = "", env: Mapping[str, str] | None = None) -> P:
    """``defaults`` with the fields that variables name; empty ones don't count."""
    if not is_dataclass(defaults):
        raise TypeError("parameters are dataclasses")
    env = os.environ if env is None else env
    found = {n: (f"{prefix}{n}".upper(), v) for n, v in _plain_fields(defaults).items()}
    return replace(defaults, **{n: _value(name, env[name], v) for n, (name, v) in found.items() if env.get(name, "").strip()})


def from_arguments(defaults: P, arguments: Sequence[str]) -> tuple[P, list[str]]:
    """``defaults`` with the fields that options name (``--name value`` or ``--name=value``; ``--name`` alone for what is true or false), and the other arguments in order."""
    known = {"--" + n.replace("_", "-"): (n, v) for n, v in _plain_fields(defaults).items()}
    changed, rest, at = {}, [], iter(arguments)
    for a in at:
        if a == "--":
            rest.extend(at)
            break
        if not a.startswith("--"):
            rest.append(a)
            continue
        option, given, text = a.partition("=")
        if option not in known:
            raise ValueError(f"there is no option {option}")
        name, default = known[option]
        if not given:
            text = "true" if isinstance(default, bool) else next(at, None)
            if text is None:
                raise ValueError(f"{option} needs a value")
        changed[name] = _value(option, text, default)
    return replace(defaults, **changed), rest


def parameters(defaults: P, arguments: Sequence[str], prefix: str = "", env: Mapping[str, str] | None = None) -> tuple[P, list[str]]:
    """Both: variables over defaults, options over variables."""
    return from_arguments(from_environment(defaults, prefix, env), arguments)
