"""Readers and writers."""

from scarpline.sources.readers import (  # noqa: F401
    available_scenarios, normalise, read_climate_grid, read_daily_weather, read_dem, read_events,
    read_soil_tables,
)
from scarpline.sources.writers import (  # noqa: F401
    save_analysis, save_collected, save_forecast, save_predictions, write_table,
)
