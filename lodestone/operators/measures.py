"""Tables of counts, verdicts, selections and folds over draws, ledgers, pages and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats


# ---- tables
def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def wide_counts(rows: DataFrame, key: str, column: str, values: dict[str, str]) -> DataFrame:
    """One column for each value, zero where it does not occur; ``values`` maps values to names."""
    wide = rows.groupBy(key).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.select(key, *(F.coalesce(v, F.lit(0)).alias(name) for v, name in values.items()))


def share(flag: Column) -> Column:
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def first_in_group(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__r = 1").drop("__r")


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Least and greatest value, and for each share the value of rank ``min(n, floor(share * n) + 1)``, by a window: no
    group is gathered."""
    w = Window.partitionBy(group)
    ranked = rows.select(group, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.least("n", F.floor(F.col("n") * F.lit(p)) + 1), F.col(value)))
    return ranked.groupBy(group).agg(F.min(value).alias("low"), *(at(p).alias(name) for name, p in shares.items()), F.max(value).alias("high"))


def ranked(rows: DataFrame, group: str, value: str, places: dict[str, Column]) -> DataFrame:
    """Values of a group at the given places (from 0) of its order, by a window: ``n`` is the number of its values, nulls
    apart, and no group is gathered."""
    w = Window.partitionBy(group)
    d = rows.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return d.groupBy(group).agg(*(F.max(F.when(F.col("r") == at.cast("bigint"), F.col(value))).alias(name) for name, at in places.items()))


def floor_90() -> Column:
    return F.floor(0.9 * (F.col("n") - 1))


def clipped_90() -> Column:
    return F.least(F.col("n") - 1, F.floor(0.9 * F.col("n")))


def upper_half() -> Column:
    return F.floor(F.col("n") / 2)


# ---- names and keys
def with_short_names(rows: DataFrame, names: DataFrame, column: str = "model") -> DataFrame:
    """``short`` of a registry of names (``name, short``), else the name itself."""
    return rows.join(names.select(F.col("name").alias("__n"), F.col("short").alias("__s")), F.col(column) == F.col("__n"), "left").withColumn("short", F.coalesce("__s", column)).drop("__n", "__s")


def cell_key(target: Column, model: Column, effort: Column | None = None, *conditions: Column) -> Column:
    """``target|model[@effort][|condition...]``; what is null is left out, so a baseline has no condition."""
    whole = model if effort is None else F.concat(model, F.coalesce(F.concat(F.lit("@"), effort), F.lit("")))
    return F.concat_ws("|", target, whole, *conditions)


# ---- predicates
def near_miss(recall_mean: Column, recall_min: Column, precision_min: Column) -> Column:
    """Imperfect, but with hardly a row missing and none invented."""
    return ~((recall_min == 1) & (precision_min == 1)) & (recall_mean >= 0.98) & (precision_min == 1)


def stream_end(stop_reason: Column, tokens: Column, cap: int) -> Column:
    silent = stop_reason.isNull()
    return F.when(stop_reason == "max_tokens", "at-cap").when(silent & (tokens == 0), "silent").when(silent, "cut").when(tokens >= cap, "full").otherwise("ended")


HINTS = {"date": ("date", "issued", "urgent"), "unit": ("unit", "dwelling", "low", "medium")}


def field_hint(name: Column, otherwise: str = "worktype") -> Column:
    """What a field's name hints at; the first kind with a hint wins."""
    low, out = F.lower(name), None
    for kind, hints in HINTS.items():
        found = F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h))
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise(otherwise)


def drop_reason(body: Column, url: Column, verdict: Column, n_paths: Column, least_size: int, least_paths: int) -> Column:
    """Why a page is not trusted, the first reason that holds; null if it is."""
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "no body")
        .when(verdict == "rejected", "rejected")
        .when(F.length(body) < least_size, "too small")
        .when(F.contains(url, F.lit("#")), "fragment")
        .when(n_paths < least_paths, "too few paths")
    )


def failed_kind(tokens: Column, seconds: Column, stop_reason: Column) -> Column:
    return F.when(tokens == 0, "no usage").when(seconds > 80, "timeout").when(stop_reason.isNull(), "host cut").otherwise("api error")


def outcome(called: Column, has_code: Column, accepted: Column, ran: Column) -> Column:
    """The first step of a draw that failed, in the order in which they are made."""
    return F.when(~called, "infra_error").when(~has_code, "no_code").when(~accepted, "refused").when(~ran, "raised").otherwise("scored")


def field_verdict(failed: Column, ids_perfect: Column, disagreements: Column) -> Column:
    return F.when(~failed, (ids_perfect & (disagreements == 0)).cast("int"))


# ---- pages and scores
def check_rows(rows: DataFrame, page: str, id_: str, date: str, values: list[str], expected: int) -> DataFrame:
    """Checks that need no reference: as many rows as expected, identifiers there and unique, values free of markup, and
    nine in ten dates that look like dates."""
    clean = None
    for v in values:
        fine = F.col(v).isNull() | ~F.col(v).rlike(r"<\s*/?\s*[a-zA-Z][^>]*>")
        clean = fine if clean is None else clean & fine
    looks = F.col(date).rlike(r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{2,4}")
    dated = F.col(date).isNotNull() & (F.col(date) != "")
    return rows.groupBy(page).agg(
        (F.count("*") == expected).alias("rows"),
        ((F.count_if(F.coalesce(F.trim(id_), F.lit("")) == "") == 0) & (F.count_distinct(id_) == F.count("*"))).alias("ids"),
        (F.count_if(~clean) == 0).alias("clean"),
        (F.count_if(dated & looks) >= 0.9 * F.count_if(dated)).alias("dates"),
    )


def expected_rows(rows: DataFrame, portal: str, page: str, width: str) -> DataFrame:
    """Rows of the portal's commonest width on each page; of widths that are equally common the smaller."""
    common = counts(rows, portal, width)
    mode = first_in_group(common, portal, F.desc("n"), F.col(width)).select(portal, F.col(width).alias("__w"))
    return rows.join(mode, portal).groupBy(portal, page).agg(F.count_if(F.col(width) == F.col("__w")).alias("expected"))


def empty_fields(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(group).agg(*((F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")) == 0).alias(f"{f}_empty") for f in fields))


# ---- templates
def shared_marks(pages: DataFrame) -> DataFrame:
    """Marks that pages of more than one jurisdiction have."""
    return pages.where("mark != ''").groupBy("mark").agg(F.count_distinct("jurisdiction").alias("jurisdictions")).where("jurisdictions > 1")


def vendor_crosstab(pages: DataFrame) -> DataFrame:
    d = pages.where("mark != ''").groupBy("vendor").agg(F.count_distinct("jurisdiction").alias("jurisdictions"), F.count_distinct("mark").alias("templates"))
    return d.where("jurisdictions >= 2").withColumn("verdict", F.when(F.col("templates") == 1, "one template").when(F.col("templates") < F.col("jurisdictions"), "some shared").otherwise("no exact reuse"))


# ---- money
def pick(rows: DataFrame, metric: str, **where: str) -> DataFrame:
    """Values of one metric of a long table."""
    d = rows.where(F.col("metric") == metric)
    for column, value in where.items():
        d = d.where(F.col(column) == value)
    return d


def without_excluded(draws: DataFrame, excluded: DataFrame) -> DataFrame:
    return draws.join(F.broadcast(excluded), ["cell", "draw"], "left_anti")  # a list that people keep


def price_ratio(ledger: DataFrame, prices: DataFrame, group: str) -> DataFrame:
    """Median of what was billed to the list price."""
    j = ledger.join(F.broadcast(prices), F.col("model") == F.col("price_model"))
    return j.groupBy(group).agg(F.round(F.median(F.col("usd") / F.col("per_token")), 9).alias("ratio"))


def projections(ledger: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """Calls and spend by model under each cut of the seconds that a call may take."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(m).alias("most")) for c, m in cuts.items())))
    return ledger.select("*", each.alias("s")).where("seconds < s.most").groupBy("s.cut", "model").agg(F.count("*").alias("calls"), F.round(F.sum("usd"), 4).alias("usd"))


def admitted(ledger: DataFrame, key: str, ceiling: float) -> DataFrame:
    """Calls that a budget lets through, in order: a call is refused if its worst case would pass the ceiling, and a refused
    one spends nothing, so a cheaper one may follow.  A fold over a key's calls in order, as each decision needs the last:
    a session's calls, which are few, meet in one row."""
    calls = ledger.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_id", "worst", "usd"))).alias("calls"))
    begin = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<struct<row_id:bigint,spent:double>>").alias("let"))

    def step(s: Column, c: Column) -> Column:
        now = s["spent"] + c["usd"]
        taken = F.struct(now.alias("spent"), F.concat(s["let"], F.array(F.struct(c["row_id"].cast("bigint").alias("row_id"), now.alias("spent")))).alias("let"))
        return F.when(s["spent"] + c["worst"] <= ceiling, taken).otherwise(s)

    return calls.select(key, F.explode(F.aggregate("calls", begin, step)["let"]).alias("x")).select(key, "x.row_id", "x.spent")


# ---- estimators over pairs of cells
def contrasts(draws: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """Difference of the success rates of two values of ``column``, by model."""
    at = lambda v, x: F.sum(F.when(F.col(column) == v, x).otherwise(0))
    d = draws.groupBy("model").agg(at(first, F.col("perfect")).alias("k1"), at(first, F.lit(1)).alias("n1"), at(second, F.col("perfect")).alias("k2"), at(second, F.lit(1)).alias("n2")).where("n1 > 0 and n2 > 0")
    x = stats.newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return d.select("model", *(F.round(x[f], 9).alias(f) for f in ("d", "lo", "hi")))


def cost_intervals(draws: DataFrame) -> DataFrame:
    """Cost of a success by model, between the bounds that the interval of its rate gives."""
    d = draws.groupBy("model").agg(F.count("*").alias("n"), F.sum("perfect").alias("k"), F.avg("usd").alias("c"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return d.select("model", F.try_divide(F.col("c"), w["hi"]).alias("low"), F.when(w["lo"] > 0, F.col("c") / w["lo"]).alias("high"), F.try_divide(F.col("c") * F.col("n"), "k").alias("point"))


def reversals(costs: DataFrame) -> DataFrame:
    """Pairs of models whose cost intervals do not meet; over models, of which there are few."""
    a, b = costs.alias("a"), costs.alias("b")
    return a.join(b, F.col("a.low") > F.col("b.high")).select(F.col("a.model").alias("dear"), F.col("b.model").alias("cheap"), F.round(F.col("a.point") / F.col("b.point"), 6).alias("ratio"))


def stop_chance(cells: DataFrame, first: int = 10) -> DataFrame:
    """Chance that the first draws are unanimous, and how many draws are to be expected."""
    p = F.col("k") / F.col("n")
    stop = F.pow(p, F.lit(first)) + F.pow(1 - p, F.lit(first))
    return cells.where("n > 0").select("cell", F.round(stop, 9).alias("p_stop"), F.round(first + first * (1 - stop), 9).alias("draws"))


# ---- folds
def budget_stop(turns: DataFrame, group: str, order: str, cost: Column, most: int) -> DataFrame:
    """The first turn at which what was spent passes the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("__s", F.sum(cost).over(w)).where(F.col("__s") > most).groupBy(group).agg(F.min(order).alias("stop"))


def as_of(log: DataFrame, keys: list[str], order: str, moment: Column, superseded: Column | None = None) -> DataFrame:
    """What was known at a moment: superseded rows go first whatever their time, then the latest row of each key."""
    d = log if superseded is None else log.where(~superseded)
    return d.where(F.col("observed_at") < moment).groupBy(*keys).agg(F.max(order).alias(order))


def pessimistic(rows: DataFrame, group: str, confidence: str) -> DataFrame:
    """A source is as sure as its least sure mapping."""
    return rows.groupBy(group).agg(F.min(confidence).alias("worst"), F.max(confidence).alias("best"))


def live_links(offices: DataFrame, links: DataFrame, workable: DataFrame) -> DataFrame:
    """Live links of each office, and whether it is on the worklist."""
    n = counts(links.where("live"), "office")
    d = offices.join(n, "office", "left").join(workable.select("office").distinct().withColumn("w", F.lit(True)), "office", "left")
    return d.select("office", F.coalesce("n", F.lit(0)).alias("live"), F.coalesce("w", F.lit(False)).alias("worklist"))


def backward_steps(log: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """How often an entity's milestones go back, in the order they were seen."""
    rank = F.create_map(*(x for m, r in ranks.items() for x in (F.lit(m), F.lit(r))))
    seen = log.select("entity", "seq", F.coalesce(F.try_element_at(rank, F.col("milestone")), F.lit(len(ranks) + 1)).alias("rk"))
    back = seen.withColumn("back", F.col("rk") < F.lag("rk").over(Window.partitionBy("entity").orderBy("seq")))
    return back.where("back").groupBy("entity").agg(F.count("*").alias("alarms"))


def best_of_k(draws: DataFrame, key: str, k: int) -> DataFrame:
    """Success rate and mean spend of best-of-k over each cell's stored draws (``accepted, perfect, usd``), exactly: draws are
    looked at in random order and paid for until the first that is accepted, or ``k``."""
    accepted, flag = F.col("accepted"), lambda c: F.coalesce(c, F.lit(False))
    d = draws.groupBy(key).agg(
        F.count("*").cast("int").alias("n"),
        F.count_if(~flag(accepted)).cast("int").alias("rejected"),
        F.count_if(flag(accepted) & (F.col("perfect") == 1)).alias("good"),
        F.sum(F.when(flag(accepted), F.col("usd")).otherwise(0.0)).alias("usd_accepted"),
        F.sum(F.when(~flag(accepted), F.col("usd")).otherwise(0.0)).alias("usd_rejected"),
    )
    n, rejected, most = F.col("n"), F.col("rejected"), F.lit(k)
    spend = (F.col("usd_accepted") * stats.looked_at(rejected, n, most) + F.col("usd_rejected") * stats.looked_at(rejected - 1, n, most)) / n
    return d.select(key, F.least(n, most).alias("k"), F.round(F.col("good") * stats.kept_chance(n, rejected, most), 9).alias("success"), F.round(spend, 6).alias("usd"))
