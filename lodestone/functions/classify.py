"""Classifiers: ordered rules to ``struct(value, rule)``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocab


def _pair(value, rule) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(as_col(value).alias("value"), as_col(rule).alias("rule"))


def first_rule(rules, text: Column, default) -> Column:
    low, out = F.lower(text), None
    for pattern, value, rule in rules:
        hit = low.rlike(pattern)
        out = F.when(hit, _pair(value, rule)) if out is None else out.when(hit, _pair(value, rule))
    return out.otherwise(_pair(default, None))


def joined(*natives: Column) -> Column:
    """The non-empty natives with `` | `` between."""
    return F.nullif(F.concat_ws(" | ", *(F.nullif(n, F.lit("")) for n in natives)), F.lit(""))


def structure(*natives: Column) -> Column:
    text = joined(*natives)
    code = F.regexp_extract(text, r"(?<!\d)(10[1-5])(?!\d)", 1)
    return (
        F.when(text.isNull(), _pair(None, None))
        .when(code != "", _pair(code, "bps-code"))
        .when(F.lower(text).rlike(vocab.BUNDLE), _pair("1-4", "kw:low-density-bundle"))
        .otherwise(first_rule(vocab.STRUCTURE_RULES, text, None))
    )


def work(*natives: Column) -> Column:
    text = joined(*natives)
    return F.when(text.isNull(), _pair("UNKNOWN", None)).otherwise(first_rule(vocab.WORK_RULES, text, "UNKNOWN"))


def kind(*natives: Column, default: str | None = None) -> Column:
    codes = F.create_map(*(F.lit(x) for x in chain.from_iterable(vocab.KIND_CODES.items())))
    coded = F.coalesce(*(F.try_element_at(codes, F.upper(F.trim(n))) for n in natives))
    text = joined(*natives)
    out = F.when(coded.isNotNull(), _pair(coded, "code"))
    if default:
        return out.otherwise(_pair(default, "source-declared"))
    return out.when(text.isNull(), _pair("UNKNOWN", None)).otherwise(first_rule(vocab.KIND_RULES, text, "UNKNOWN"))


def refine(structure_type: Column, units: Column, work_class: Column) -> Column:
    """Sharpen a class by a new building's own count; never into five or more."""
    live = (work_class == "NEW") & (units > 0)
    bundle = F.when(units == 1, "101").when(units == 2, "103").otherwise("104")
    down = F.when(units >= 3, "104").when(units == 2, "103").otherwise("101")
    return (
        F.when(live & (structure_type == "1-4"), _pair(bundle, "refine:bundle-by-units"))
        .when(live & (structure_type == "105") & (units <= 4), _pair(down, "refine:multifamily-down"))
        .otherwise(_pair(structure_type, None))
    )


def imply_units(structure_type: Column, work_class: Column, rule: Column, controlled: Column) -> Column:
    """``struct(units, rule)``: a count that the class names by definition, or why not."""
    implied = F.when(structure_type.isin("101", "102"), 1).when(structure_type == "103", 2)
    out = lambda n, r: F.struct(n.cast("int").alias("units"), r.alias("rule"))
    none = F.lit(None)
    return (
        F.when(~controlled, out(none, F.lit("refused:uncontrolled-field")))
        .when(F.coalesce(work_class != "NEW", F.lit(True)), out(none, F.lit("refused:not-new")))
        .when(F.coalesce(~rule.isin(*vocab.IMPLY_RULES), F.lit(True)), out(none, F.lit("refused:rule-not-determinate")))
        .when(implied.isNull(), out(none, F.lit("refused:class-not-determinate")))
        .otherwise(out(implied, F.concat(F.lit("imply:"), implied.cast("string"), F.lit("-from-"), structure_type)))
    )


def units_from_text(text: Column) -> Column:
    low = F.lower(text)
    n = F.regexp_extract(low, r"(\d+)\s*unit", 1).try_cast("int")
    out = lambda v, r: F.struct(v.cast("int").alias("units"), F.lit(r).cast("string").alias("rule"))
    return (
        F.when(low.rlike(r">\s*\d+\s*unit|\d+\s*\+\s*unit|or more"), out(F.lit(None), "refused:open-ended"))
        .when(n.isNotNull(), out(n, "units:exact-from-text"))
        .otherwise(out(F.lit(None), None))
    )


def failure_mode(outcome: Column, recall_min: Column, precision_min: Column) -> Column:
    """How a draw failed, from its outcome and its worst page."""
    return (
        F.when((recall_min == 1) & (precision_min == 1), "perfect")
        .when(outcome == "not_attempted", "not_attempted")
        .when(outcome == "infra_error", "infra_error")
        .when(outcome.isin("raised", "no_code", "refused"), "loud")
        .when(F.coalesce(recall_min, F.lit(0.0)) == 0, "silent_empty")
        .otherwise("silent_partial")
    )


def stop_kind(stop: Column, tokens: Column, cap: Column) -> Column:
    """Whether a reply was cut: a stated cap, a natural end, a full reply, or a host that hung up below the cap."""
    return F.when(stop == "max_tokens", "truncated").when(stop.isin("end_turn", "stop", "tool_use"), "natural").when(tokens >= cap, "truncated").when(stop.isNull(), "host_cut").otherwise("natural")


def bps_column(structure_type: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(vocab.BPS_COLUMNS.items())))
    return F.try_element_at(pairs, structure_type)
