"""What a request body asked of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settings_sent(body: Column, levels: dict[str, str] | None = None) -> Column:
    """``max_tokens, reasoning, reasoning_level, temperature, top_p`` as sent; ``levels`` maps an effort to the lab's name
    for it.  A request with thinking has the fixed temperature 1 unless it says otherwise."""
    get = lambda p: F.get_json_object(body, f"$.{p}")
    thinking, effort, plain = get("thinking"), get("reasoning.effort"), get("reasoning_effort")
    kind = F.when(get("thinking.type") == "adaptive", "adaptive").otherwise(F.concat(F.lit("budget="), get("thinking.budget_tokens")))
    reasoning = F.when(thinking.isNotNull(), kind).when(effort.isNotNull(), F.concat(F.lit("effort="), effort)).when(get("reasoning").isNotNull(), "enabled").when(plain.isNotNull(), F.concat(F.lit("effort="), plain))
    names = F.create_map(*(F.lit(x) for pair in (levels or {"": ""}).items() for x in pair))
    level = F.when(thinking.isNull() & effort.isNotNull(), F.coalesce(F.try_element_at(names, effort), effort))
    temperature = F.coalesce(get("temperature").try_cast("double"), F.when(thinking.isNotNull(), 1.0))
    return F.struct(get("max_tokens").try_cast("bigint").alias("max_tokens"), reasoning.alias("reasoning"), level.alias("reasoning_level"), temperature.alias("temperature"), get("top_p").try_cast("double").alias("top_p"))
