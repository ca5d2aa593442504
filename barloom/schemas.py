"""Explicit schemas of the stored tables. All measures are doubles; there is no decimal type."""

from __future__ import annotations

BARS = "code string, day date, open double, high double, low double, close double, volume double, amount double, turnover double"
# a vendor bar file carries every number as text
RAW_BARS = "code string, day string, open string, high string, low string, close string, volume string, amount string, turnover string"
MONEY_FLOW = (
    "code string, day date, main_net1 double, main_net5 double, mac_main_net1 double, mac_main_net5 double, "
    "mac_retail_net1 double, northbound double, sector_net double, concept_net double, data_as_of timestamp, source string"
)
QUOTE = (
    "code string, name string, open double, pre_close double, price double, high double, low double, volume double, "
    "amount double, quote_date string, quote_time string"
)

# fixed values: version tags of derived tables
FEATURE_VERSION = "daily_v3_qfq"
