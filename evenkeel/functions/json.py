"""JSON text helpers: extraction, payload bundling, tolerant path lookup."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from evenkeel.functions.equality import trim_blanks


def json_path(*steps: str | int) -> str:
    """A JSON path from names and indexes."""
    out = "$"
    for step in steps:
        out += f"[{step}]" if isinstance(step, int) else f"['{step}']"
    return out


def json_get(col: Column, key: str | int) -> Column:
    """``col ->> key`` or ``col ->> index``: text, or null where it is missing."""
    return F.try_variant_get(F.try_parse_json(col), json_path(key), "string") if isinstance(key, int) \
        else F.get_json_object(col, json_path(key))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` many times in ``body`` while it is written, and computed, once."""
    return F.transform(F.array(value), body)[0]


def bundle_payload(col: Column, blank: str | None = "{}") -> Column:
    """Bring a payload to a JSON array text.

    Arrays stay byte for byte, an object or scalar is wrapped, text that is not
    JSON becomes one quoted item. One level of string-encoded JSON is unwrapped.
    A blank payload reads as ``blank``; with ``blank=None`` it gives null.
    """
    def unwrapped(text: Column) -> Column:
        inner = F.when(text.startswith('"') & text.endswith('"'),
                       F.try_variant_get(F.try_parse_json(text), "$", "string"))
        return F.when(text == "", F.lit(blank)).otherwise(F.coalesce(trim_blanks(inner), text))

    def bundled(text: Column) -> Column:
        other = let(F.try_parse_json(text), lambda parsed: F.when(
            parsed.isNotNull() & (text != ""), F.concat(F.lit("["), F.to_json(parsed), F.lit("]"))).otherwise(
            F.concat(F.lit('["'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"]'))))
        return (F.when(text.startswith("[") & text.endswith("]"), text)
                .when(text.startswith("{") & text.endswith("}"), F.concat(F.lit("["), text, F.lit("]")))
                .when(text.isNotNull(), other))

    return let(let(trim_blanks(F.coalesce(col, F.lit(""))), unwrapped), bundled)


def name_variants(name: str) -> list[str]:
    """The name itself, in snake case and in camel case."""
    snake = re.sub(r"([a-z])([A-Z]+)", r"\1_\2", name).lower()
    head, *tail = name.split("_")
    camel = head + "".join(part[:1].upper() + part[1:] for part in tail)
    return list(dict.fromkeys([name, snake, camel]))
