"""glossweave: annotation consensus, span evaluation and corpus preparation on Spark DataFrames."""

from glossweave.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
