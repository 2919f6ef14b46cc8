"""Schemas of the raw tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

RAW = {
    "raw_alpaca_equity_ohlcv": "bar_id long, timestamp timestamp, symbol string, open double, high double, low double, close double, volume long, vwap double, trade_count long, ingested_at timestamp",
    "raw_fd_fundamentals": "fund_id long, report_date timestamp, symbol string, fiscal_period string, period string, currency string, revenue double, cost_of_revenue double, gross_profit double, operating_expense double, operating_income double, interest_expense double, ebit double, net_income double, net_income_common_stock double, eps double, eps_diluted double, weighted_average_shares double, weighted_average_shares_diluted double, dividends_per_share double, ingested_at timestamp",
    "raw_fd_insider_trades": "trade_id long, filed_at timestamp, symbol string, insider_name string, insider_title string, transaction_type string, shares double, price_per_share double, total_value double, shares_owned_after double, filing_date timestamp, transaction_date timestamp, is_board_director boolean, shares_owned_before double, security_title string, issuer string, ingested_at timestamp",
}
#: Fields of a bar message and the columns they become; field names differ in case alone, so messages are read as maps.
BAR_COLUMNS = {"S": "symbol", "t": "timestamp", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "trade_count"}


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
