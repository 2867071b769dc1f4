"""Imports every query module, which fills the registry."""

from fluxloom.queries import feature_queries  # noqa: F401
from fluxloom.queries import scalar_queries  # noqa: F401
from fluxloom.queries import event_queries  # noqa: F401
from fluxloom.queries import model_queries  # noqa: F401
from fluxloom.queries import run_queries  # noqa: F401
