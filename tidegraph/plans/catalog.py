"""All named queries; importing the modules registers them."""

from . import graphs, series, tabular  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
