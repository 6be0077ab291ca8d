"""Where violations are: each gets a place in the text, those before it in the text's list taken into account."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..operators.rules import VIOLATION


def snippet(text: str, start: int, end: int, width: int) -> str:
    middle = (start + end) // 2
    lo, hi = max(0, middle - width // 2), min(len(text), middle + width // 2)
    return ("..." if lo else "") + text[lo:hi].replace("\n", " ") + ("..." if hi < len(text) else "")


def places(text: str, violations: list[dict], width: int) -> list[dict]:
    """In order of preference: its own span; an occurrence of the match in that very context; any occurrence, if the context names it; the context; the whole text. Of several, the first that no earlier violation got."""
    flat, used, literal, out = text.replace("\n", " "), set(), {}, []

    def pick(found: list) -> tuple | None:
        return next((x for x in found if x not in used), found[0] if found else None)

    for v in violations:
        span = (v["start"], v["end"]) if v["start"] is not None else None
        if span is None:
            match, around = v["match"], v["context"]
            if match not in literal:
                literal[match] = [m.span() for m in re.finditer(re.escape(match), text, re.IGNORECASE)] if match else []
            span = pick([x for x in literal[match] if snippet(text, *x, width) == around])
            if span is None and match.casefold() in around.casefold():
                span = pick(literal[match])
            if span is None:
                core = around.removeprefix("...")
                core = core[:-3] if around.endswith("...") else core
                found, at = [], flat.find(core) if core else -1
                while at >= 0:
                    found.append((at, at + len(core)))
                    at = flat.find(core, at + 1)
                span = pick(found)
            if span is None:
                span = (0, len(text))
        used.add(span)
        out.append({**v, "start": span[0], "end": span[1]})
    return out


def resolve_spans(text: Column, violations: Column, width: int) -> Column:
    @pandas_udf(VIOLATION)
    def resolve(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([places(t, [dict(v) for v in f], width) if t is not None and f is not None and len(f) else [] for t, f in zip(texts, found, strict=True)], dtype=object)

    return resolve(text, violations)
