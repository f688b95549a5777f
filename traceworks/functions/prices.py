"""Token prices and cost arithmetic.

Costs are summed as whole nano-dollars, so a total does not depend on the
order in which partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per million (input, output) tokens. Exact model names of
# the audit log.
AUDIT_PRICES = {
    "claude-3-5-sonnet-20241022": (3.00, 15.00),
    "claude-3-5-sonnet-20241022-v2:0": (3.00, 15.00),
    "anthropic.claude-3-5-sonnet-20241022-v2:0": (3.00, 15.00),
    "claude-3-haiku-20240307": (0.25, 1.25),
    "gpt-4o": (5.00, 15.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4-turbo": (10.0, 30.00),
    "llama3.1": (0.00, 0.00),
    "llama3": (0.00, 0.00),
    "mistral": (0.00, 0.00),
}
AUDIT_DEFAULT = (5.0, 15.0)

# Exact model names of the cost controller.
CONTROL_PRICES = {
    "claude-3-5-sonnet-20241022": (3.00, 15.00),
    "claude-3-5-haiku-20241022": (0.80, 4.00),
    "claude-3-haiku-20240307": (0.25, 1.25),
    "claude-3-opus-20240229": (15.0, 75.0),
    "anthropic.claude-3-5-sonnet-20241022-v2:0": (3.00, 15.00),
    "anthropic.claude-3-haiku-20240307-v1:0": (0.25, 1.25),
    "gpt-4o": (5.00, 15.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4-turbo": (10.0, 30.0),
    "llama3.1": (0.00, 0.00),
    "llama3": (0.00, 0.00),
    "mistral": (0.00, 0.00),
    "phi3": (0.00, 0.00),
}
CONTROL_DEFAULT = (5.0, 15.0)

# Model-name prefixes of the daily guard; the longest one wins.
GUARD_PREFIX_PRICES = {
    "gemini-2.5-flash-lite": (0.10, 0.40),
    "gemini-2.5-flash": (0.15, 0.60),
    "gemini-2.0-flash": (0.10, 0.40),
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-1.5-pro": (3.50, 10.50),
    "gpt-5.1": (2.00, 8.00),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-3.5": (0.50, 1.50),
    "o3-mini": (1.10, 4.40),
    "o3": (10.00, 40.00),
    "anthropic.claude-3-5-sonnet": (3.00, 15.00),
    "anthropic.claude-3-haiku": (0.25, 1.25),
    "anthropic.claude": (3.00, 15.00),
    "claude": (3.00, 15.00),
}
GUARD_DEFAULT = (10.00, 30.00)

# The cheaper model to move to.
FALLBACKS = {
    "claude-3-5-sonnet-20241022": "claude-3-haiku-20240307",
    "claude-3-opus-20240229": "claude-3-5-sonnet-20241022",
    "anthropic.claude-3-5-sonnet-20241022-v2:0": "anthropic.claude-3-haiku-20240307-v1:0",
    "gpt-4o": "gpt-4o-mini",
    "gpt-4-turbo": "gpt-4o-mini",
}


def _nanos(rate: float) -> int:
    """Nano-dollars per token."""
    return round(rate * 1000)


def _rate(pair: tuple[float, float]) -> Column:
    return F.struct(F.lit(_nanos(pair[0])).alias("inp"), F.lit(_nanos(pair[1])).alias("out"))


def exact_rate(model: Column, prices: dict = AUDIT_PRICES, default=AUDIT_DEFAULT) -> Column:
    """Rates by exact name: struct(inp, out) in nano-dollars per token."""
    table = F.create_map(*[x for name, pair in prices.items() for x in (F.lit(name), _rate(pair))])
    return F.coalesce(F.try_element_at(table, model), _rate(default))


def prefix_rate(model: Column, prices: dict = GUARD_PREFIX_PRICES, default=GUARD_DEFAULT) -> Column:
    """Rates by the longest matching prefix of the lower-cased name."""
    name = F.lower(F.coalesce(model, F.lit("")))
    chain = F
    for prefix in sorted(prices, key=len, reverse=True):
        chain = chain.when(name.startswith(prefix), _rate(prices[prefix]))
    return chain.otherwise(_rate(default))


def cost_nanos(rate: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in.cast("bigint") * rate["inp"] + tokens_out.cast("bigint") * rate["out"]).cast("bigint")


def usd(nanos: Column, digits: int = 6) -> Column:
    """Dollars rounded half up in whole units, so ties do not depend on floats."""
    unit = 10 ** (9 - digits)
    if unit == 1:
        return nanos / F.lit(1e9)
    return F.floor((nanos + unit // 2) / F.lit(unit)) / F.lit(float(10 ** digits))


def half_up(value: Column, digits: int) -> Column:
    """Rounding by plain arithmetic, so that ties fall the same way everywhere."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def estimated_tokens(text: Column) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(text) / 4)


def fallback_model(model: Column) -> Column:
    pairs = [F.lit(x) for kv in FALLBACKS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), model)
