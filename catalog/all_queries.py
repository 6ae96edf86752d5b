"""Imports every query module so that all queries are registered."""

from catalog import nights_queries  # noqa: F401
from catalog import window_queries  # noqa: F401
from catalog import spectral_queries  # noqa: F401
from catalog import stage_queries  # noqa: F401
from catalog import aggregate_queries  # noqa: F401
from catalog import daily_queries  # noqa: F401
from catalog import ingest_queries  # noqa: F401
from catalog import model_queries  # noqa: F401
from catalog import held_out_queries  # noqa: F401
from catalog import stream_queries  # noqa: F401
from catalog import surface_queries  # noqa: F401
