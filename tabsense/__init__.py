"""tabsense: automated table analysis as distributed Spark DataFrame operators.

Every public operator takes a DataFrame (plus parameters) and returns a
DataFrame.  Nothing is collected to the driver except bounded summaries
(one row per column, one row per cluster, ...).
"""

from tabsense.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
