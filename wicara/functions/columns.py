"""Small Column helpers shared by the text functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand the result to ``body``.

    Inlined expressions are re-evaluated at every reference (and per element inside array
    lambdas), so anything with a regex in it is bound here first.
    """
    return F.transform(F.array(value), body).getItem(0)


def bind(df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Append ``value`` as a column that later steps read instead of re-computing.

    The optimizer copies the expression of a plain column into every filter on it, so an expensive
    one would run several times per row; it does not look through a generator. Rows failing
    ``keep`` are left out.
    """
    items = F.array(value)
    return df.select(
        *[c for c in df.columns if c != name],
        F.explode(items if keep is None else F.filter(items, keep)).alias(name),
    )


def constant(value: object, kind: str) -> Column:
    """Nested constant as one expression; the optimizer folds it into a literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def string_array(values: Iterable[str]) -> Column:
    return constant(list(values), "array<string>")


def words(text: Column | str) -> Column:
    """Tokens of a space-separated text; blank and null texts have none."""
    return F.filter(
        F.split(F.coalesce(as_col(text), F.lit("")), " "), lambda w: w != F.lit("")
    )


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: Iterable[str]) -> str:
    # Long value lists travel as one SQL text instead of one call per literal.
    return f"w IN ({', '.join(_sql(v) for v in values)})"


def keep_words(tokens: Column, values: Iterable[str]) -> Column:
    """Tokens found in ``values``, by hashed lookup."""
    return F.call_function("filter", tokens, F.expr(f"w -> {_listed(values)}"))


def drop_words(tokens: Column, values: Iterable[str]) -> Column:
    """Tokens not found in ``values``."""
    return F.call_function("filter", tokens, F.expr(f"w -> NOT {_listed(values)}"))


def word_positions(tokens: Column, values: Iterable[str]) -> Column:
    """1-based positions of the tokens found in ``values``."""
    marked = F.call_function(
        "transform", tokens, F.expr(f"(w, i) -> CASE WHEN {_listed(values)} THEN i + 1 END")
    )
    return F.filter(marked, lambda position: position.isNotNull())


def replace_words(tokens: Column, mapping: Mapping[str, str]) -> Column:
    """Replace whole tokens once, without chaining replacements."""
    if not mapping:
        return tokens
    pairs = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in mapping.items())
    # The hashed membership test spares unmapped tokens the linear map lookup.
    replaced = f"CASE WHEN {_listed(mapping)} THEN try_element_at(map({pairs}), w) ELSE w END"
    return F.call_function("transform", tokens, F.expr(f"w -> {replaced}"))
