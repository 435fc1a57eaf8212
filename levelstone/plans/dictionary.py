"""What the variables are: (name, kind, missing when)."""

from ..operators.variables import STATE_COLUMNS

VARIABLES = [
    ("source_row_number", "key", "never"),
    ("trading_index", "key", "never"),
    ("trade_date", "key", "the date can't be read"),
    *[(f"{c}_price", "price", "blank or not a number") for c in ("open", "high", "low", "close")],
    ("volume_kg_raw", "volume", "blank or not a number"),
    ("nearest_level", "level", "the close is missing"),
    ("signed_distance", "level", "the close is missing"),
    ("distance_to_level", "level", "the close is missing"),
    *[(f"near_{k}", "state", "the distance is missing") for k in (2, 3, 5, 10)],
    ("side", "state", "the distance is missing"),
    ("side_near_5", "state", "never"),
    ("prev_close_price", "return", "first record"),
    ("log_return", "return", "first record, or a price that isn't positive"),
    ("abs_log_return", "return", "first record, or a price that isn't positive"),
    ("parkinson_valid_input", "range", "never"),
    ("parkinson_variance", "range", "high or low isn't valid"),
    ("parkinson_volatility", "range", "high or low isn't valid"),
    ("volume_valid_for_log", "volume", "never"),
    ("log_volume", "volume", "no trading"),
    ("volume_history_count_20d_lagged", "volume", "never"),
    ("normal_log_volume_20d_lagged", "volume", "fewer than 20 records with trading before"),
    ("abnormal_volume_20d", "volume", "the volume or its baseline is missing"),
    *[(f"{c}_lag1", "state of the record before", "first record") for c in STATE_COLUMNS],
    ("variable_construction_flags", "quality", "never"),
]
