"""What is done to a span: warn, hash, redact, mask, or an action of one's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PolicyError
from .fixed import ACTIONS
from .spans import part, pieces_of

VIOLATION = "struct<entity_type:string,original:string,start:int,end:int,action:string,replacement:string,confidence:double>"
VIOLATIONS = f"array<{VIOLATION}>"


@dataclass(frozen=True)
class ActionContext:
    salt: str = ""


#: From (span struct, context) to the replacement's column; null keeps the text.
NativeAction = Callable[[Column, ActionContext], Column]
#: From (entity type, text, context) to the replacement, for actions that no expression can state.
PythonAction = Callable[[str, str, ActionContext], "str | None"]
_native: dict[str, NativeAction] = {}
_python: dict[str, PythonAction] = {}


def register_action(name: str, build: NativeAction) -> None:
    """A known name is overridden."""
    if not name or not isinstance(name, str):
        raise PolicyError(f"an action's name must be a text, not {name!r}")
    _python.pop(name, None)
    _native[name] = build


def register_python_action(name: str, fn: PythonAction) -> None:
    """Runs in Arrow batches; a built-in expression is faster where it can do the same."""
    register_action(name, lambda s, c: F.lit(None).cast("string"))
    del _native[name]
    _python[name] = fn


def registered_actions() -> frozenset[str]:
    return frozenset(_native) | frozenset(_python)


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask(entity: Column, text: Column) -> Column:
    n = F.length(text)
    digits = F.regexp_replace(text, "[^0-9]", "")
    enough = F.length(digits) >= 4
    at = F.instr(text, "@")
    return (
        F.when(entity == "CREDIT_CARD", F.when(enough, F.concat(stars(F.length(digits) - 4), F.right(digits, F.lit(4)))).otherwise(stars(n)))
        .when(entity == "EMAIL", F.when(at > 1, F.concat(F.left(text, F.lit(1)), stars(F.greatest(at - 2, F.lit(1))), F.substring(text, at, n))).otherwise(stars(n)))
        .when(entity == "PHONE", F.when(enough, F.concat(stars(n - 4), F.right(text, F.lit(4)))).otherwise(stars(n)))
        .when(entity == "SSN", F.when(enough, F.concat(F.lit("***-**-"), F.right(digits, F.lit(4)))).otherwise(stars(n)))
        .when(entity == "IBAN", F.when(n >= 6, F.concat(F.left(text, F.lit(2)), stars(n - 6), F.right(text, F.lit(4)))).otherwise(stars(n)))
        .when(entity.isin("TC_ID", "NIN"), F.when(n >= 3, F.concat(stars(n - 3), F.right(text, F.lit(3)))).otherwise(stars(n)))
        .otherwise(F.when(n >= 4, F.concat(F.left(text, F.lit(2)), stars(n - 4), F.right(text, F.lit(2)))).otherwise(stars(n)))
    )


def salted_hash(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value), 256)


register_action("warn", lambda s, c: F.lit(None).cast("string"))
register_action("hash", lambda s, c: F.concat(F.lit("["), s["entity_type"], F.lit(":"), F.substring(salted_hash(s["text"], c.salt), 1, 16), F.lit("]")))
register_action("redact", lambda s, c: F.concat(F.lit("["), s["entity_type"], F.lit("]")))
register_action("mask", lambda s, c: mask(s["entity_type"], s["text"]))
assert registered_actions() == frozenset(ACTIONS)


def check_action(action: object, where: str) -> str:
    if action not in registered_actions():
        raise PolicyError(f"unknown action {action!r} for {where}; known: {sorted(registered_actions())}")
    return str(action)


def python_replacements(actions: dict[str, str], context: ActionContext) -> Column | None:
    """A function of (entity types, texts) to an array of replacements, if any type's action is a Python one."""
    used = {entity: _python[a] for entity, a in actions.items() if a in _python}
    if not used:
        return None

    @F.pandas_udf("array<string>")
    def replace(types: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [used[k](k, x, context) if k in used else None for k, x in zip(t, v, strict=True)] for t, v in zip(types, texts, strict=True)])

    return replace


def with_actions(spans: Column, actions: dict[str, str], salt: str, from_python: Column | None = None) -> Column:
    """Violations of resolved spans; a type without an action is only warned of."""
    context = ActionContext(salt)
    chosen = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair]) if actions else None
    native = sorted({a for a in actions.values() if a in _native} - {"warn"})

    def one(s: Column, i: Column) -> Column:
        action = F.coalesce(F.try_element_at(chosen, s["entity_type"]), F.lit("warn")) if actions else F.lit("warn")
        replacement = F.when(F.lit(False), F.lit(None).cast("string"))
        for a in native:
            replacement = replacement.when(action == a, _native[a](s, context))
        if from_python is not None:
            replacement = replacement.otherwise(from_python[i])
        return F.struct(
            s["entity_type"].alias("entity_type"), s["text"].alias("original"), s["start"].alias("start"), s["end"].alias("end"), action.alias("action"),
            replacement.alias("replacement"), s["confidence"].alias("confidence"),
        )

    return F.transform(spans, one).cast(VIOLATIONS)


def every_python_replacement(action: str, context: ActionContext) -> Column | None:
    """As python_replacements, for one action on all types; nothing if it is an expression."""
    if action not in _python:
        return None
    fn = _python[action]

    @F.pandas_udf("array<string>")
    def replace(types: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [fn(k, x, context) for k, x in zip(t, v, strict=True)] for t, v in zip(types, texts, strict=True)])

    return replace


def every_action(spans: Column, action: str, salt: str, from_python: Column | None = None) -> Column:
    """One action for all types, whatever they are called."""
    context = ActionContext(salt)

    def one(s: Column, i: Column) -> Column:
        replacement = _native[action](s, context) if from_python is None else from_python[i]
        return F.struct(
            s["entity_type"].alias("entity_type"), s["text"].alias("original"), s["start"].alias("start"), s["end"].alias("end"), F.lit(action).alias("action"),
            replacement.alias("replacement"), s["confidence"].alias("confidence"),
        )

    return F.transform(spans, one).cast(VIOLATIONS)


def parts_of(text: str, violations: str) -> str:
    """The pieces of a text that sanitised() needs, null where nothing is replaced."""
    return f"if(exists({violations}, v -> v.replacement IS NOT NULL), {pieces_of(text)}, NULL)"


def sanitised(text: str, violations: str, pieces: str) -> str:
    """The text with its replacements, put together piece by piece."""
    ends = f"slice(concat(array(0), transform({violations}, v -> v.end)), 1, size({violations}))"
    changed = f"zip_with({violations}, {ends}, (v, e) -> concat({part(text, pieces, 'e', 'v.start - e')}, coalesce(v.replacement, v.original)))"
    rest = f"substring({text}, element_at({violations}, -1).end + 1)"
    return f"if({pieces} IS NULL, {text}, concat(array_join({changed}, ''), {rest}))"
