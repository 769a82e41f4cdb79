"""Nested parameters with dotted keys: defaults, files and command-line words merged into one, in the defaults' types."""

from __future__ import annotations

import json


def as_type(text: str, like):
    """A command-line word in the type of the default it replaces; a word that isn't of that type raises."""
    if isinstance(like, bool):
        if text.lower() in ("1", "true", "yes", "on"):
            return True
        if text.lower() in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"{text!r} is no truth value")
    if isinstance(like, (int, float)):
        return type(like)(text)
    if isinstance(like, (list, dict)):
        value = json.loads(text)
        if not isinstance(value, type(like)):
            raise ValueError(f"{text!r} is no {type(like).__name__}")
        return value
    return text


def merged(defaults: dict, *others: dict) -> dict:
    """Later values win; nested dictionaries merge; unknown keys raise, so that a misspelt parameter is noticed."""
    out = {k: merged(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for other in others:
        for k, v in other.items():
            if k not in out:
                raise KeyError(f"no parameter {k}")
            out[k] = merged(out[k], v) if isinstance(out[k], dict) and isinstance(v, dict) else v
    return out


def with_words(defaults: dict, words: list[str]) -> dict:
    """``a.b=3`` words laid over the defaults."""
    out = merged(defaults)
    for w in words:
        path, sep, text = w.partition("=")
        if not sep:
            raise ValueError(f"{w!r} is no key=value")
        at = out
        *above, last = path.split(".")
        for k in above:
            at = at[k]
        if last not in at:
            raise KeyError(f"no parameter {path}")
        at[last] = as_type(text, at[last])
    return out
