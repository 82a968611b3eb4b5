"""The catalogue of questions that a reader can ask, each one shape of the registry, and the asks that are refused."""

from __future__ import annotations

from dataclasses import dataclass

from terrafold.operators.evidence import PROHIBITED, Registry
from terrafold.sources.sinks import context_key


@dataclass(frozen=True)
class Question:
    """A question: the registry's shape, the tables that must be ready, and the parts of the context that are its parameters."""

    id: str
    shape: str
    needs: tuple[str, ...]
    params: tuple[tuple[str, str, str], ...]
    """(parameter, part of the context, key in it)"""


_POINT = (("lat", "lens", "lat"), ("lon", "lens", "lon"))
_CIRCLE = (*_POINT, ("radius_m", "lens", "radius_m"))
_CODE = (("code", "selection", "code"),)
CATALOGUE = {
    q.id: q
    for q in (
        Question("area_here", "AREA_AT_POINT", ("planning",), _POINT),
        Question("areas_around", "AREAS_IN_LENS", ("planning",), _CIRCLE),
        Question("phase_of_area", "AREA_PHASE", ("editions",), _CODE),
        Question("quantity_of_area", "AREA_QUANTITY", ("editions",), _CODE),
        Question("what_changed", "EDITION_DIFF", ("editions",), ()),
        Question("licences_around", "LICENCES_IN_LENS", ("licences",), (*_CIRCLE, ("first", "window", "first"), ("last", "window", "last"))),
    )
}


def ask(registry: Registry, question: str, context: dict) -> dict:
    """The outcome of a question in a context: loading while a table it needs is on its way, else answered or abstained, with the registry's row untouched.

    The outcome keeps the key of its context, so that an answer is not taken for one to a later
    question; a parameter that the context lacks makes the question abstain.
    """
    q = CATALOGUE[question]
    out = {"question": q.id, "shape": q.shape, "context_key": context_key(context), "params": None, "result": None}
    waiting = [n for n in q.needs if (context.get("ready") or {}).get(n, "ready") in ("loading", "idle")]
    if waiting:
        return out | {"status": "loading", "waiting_for": waiting[0]}
    params = {p: (context.get(part) or {}).get(key) for p, part, key in q.params}
    missing = [p for p, part, _ in q.params if params[p] is None and part != "window"]
    if missing:
        return out | {"status": "abstained", "params": params, "result": {"kind": "ABSTENTION", "shape": q.shape, "reason": "MISSING_PARAMETER", "message": f"the question needs {missing[0]}"}}
    row = registry.query(q.shape, **params).first().asDict()
    return out | {"status": "answered" if row["kind"] == "EVIDENCE" else "abstained", "params": params, "result": row}


def refuse(registry: Registry, question: str, flag: str) -> dict:
    """The registry's refusal of an ask that it never answers; no table is read for it."""
    if flag not in PROHIBITED:
        raise ValueError(f"{flag} is not refused")
    row = registry.query(CATALOGUE[question].shape, flags=(flag,)).first().asDict()
    return {"question": question, "status": "refused", "result": row}
