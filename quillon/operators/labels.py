"""Forward returns: bought ``lag`` bars after the signal, sold ``horizon`` bars later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import by_asset, div

LABEL_COLUMNS = ["date", "asset_id", "market", "horizon", "execution_lag", "forward_return", "entry_date", "exit_date"]


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), lag: int = 1) -> DataFrame:
    """One row per signal bar and horizon; rows without a sale are left out. Bars are counted per asset."""
    at = by_asset()
    entry, entry_date = F.lead("adj_close", lag).over(at), F.lead("date", lag).over(at)
    cases = [F.struct(F.lit(h).alias("horizon"), F.lead("adj_close", lag + h).over(at).alias("exit"), F.lead("date", lag + h).over(at).alias("exit_date")) for h in horizons]
    rows = bars.select("date", "asset_id", "market", entry.alias("entry"), entry_date.alias("entry_date"), F.array(*cases).alias("cases"))
    rows = rows.select("date", "asset_id", "market", "entry", "entry_date", F.inline("cases"))
    rows = rows.withColumns({"forward_return": div("exit", "entry") - 1, "execution_lag": F.lit(lag)})
    return rows.where("forward_return is not null and entry_date is not null and exit_date is not null").select(*LABEL_COLUMNS)


def labelled(rows: DataFrame, factors: list[str], horizons: tuple[int, ...], lag: int = 1, suffix: str = "", keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Factors in long form with the labels of forward_returns(), as a join of the two on date, asset and market gives them.

    ``rows`` are bars that carry ``factors`` as columns. Entries and exits are leads of the same rows, so nothing is joined;
    what the cross-sections need is dealt by date and market as one narrow row a bar, and put into long form after that.
    keep: further columns. parts: partitions of the cross-sections (see windows.deal).
    """
    at = by_asset()
    ends = {f"__exit_{h}": F.struct(F.lead("adj_close", lag + h).over(at).alias("price"), F.lead("date", lag + h).over(at).alias("date")) for h in horizons}
    rows = rows.withColumns({"__entry": F.lead("adj_close", lag).over(at), "entry_date": F.lead("date", lag).over(at)} | ends)
    cases = {f"__r_{h}": F.when(F.col(f"__exit_{h}.date").isNotNull() & F.col("entry_date").isNotNull(), div(F.col(f"__exit_{h}.price"), "__entry") - 1) for h in horizons}
    whole = F.col("date").isNotNull() & F.col("asset_id").isNotNull() & F.col("market").isNotNull()
    narrow = w.deal(rows.where(whole).select("date", "asset_id", "market", *keep, *[F.col(f).cast("double").alias(f) for f in factors], *[c.alias(n) for n, c in cases.items()]), parts)
    every = F.array(*[F.struct(F.lit(f + suffix).alias("factor_name"), F.col(f).alias("factor_value"), F.lit(h).alias("horizon"), F.lit(lag).alias("execution_lag"), F.col(f"__r_{h}").alias("forward_return")) for f in factors for h in horizons])
    return narrow.select("date", "asset_id", "market", *keep, F.inline(every)).where("factor_value is not null and forward_return is not null")


def sessions(bars: DataFrame, key: str = "market") -> DataFrame:
    """(market, date, session): the market's dates, numbered from 1; or those of another key."""
    days = bars.select(key, "date").distinct()
    return days.withColumn("session", F.row_number().over(Window.partitionBy(key).orderBy("date")))


def aligned_labels(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """Labels whose entry and exit are the market's own sessions, so that gaps of an asset do not stretch the horizon."""
    days = sessions(bars)
    on = lambda name: days.select("market", F.col("date").alias(name), F.col("session").alias(f"{name}_session"))
    joined = labels.join(on("date"), ["market", "date"]).join(on("entry_date"), ["market", "entry_date"]).join(on("exit_date"), ["market", "exit_date"])
    good = (F.col("entry_date_session") == F.col("date_session") + F.col("execution_lag")) & (F.col("exit_date_session") == F.col("entry_date_session") + F.col("horizon"))
    return joined.where(good).select(*LABEL_COLUMNS)
