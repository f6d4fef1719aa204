"""Rating analytics and recommendation on Spark DataFrames."""

from rateweave.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
