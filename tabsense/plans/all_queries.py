"""Import every query module so that the registry is complete."""

from tabsense.plans import q_profile  # noqa: F401
from tabsense.plans import q_cleaning  # noqa: F401
from tabsense.plans import q_import  # noqa: F401
from tabsense.plans import q_features  # noqa: F401
from tabsense.plans import q_plot  # noqa: F401
from tabsense.plans import q_models  # noqa: F401
from tabsense.plans import q_report  # noqa: F401
