"""Readers and stage sinks."""

from .io import (combine_series, read_articles, read_panel, read_rates, read_stage, read_timeseries,  # noqa: F401
                 write_stage)
