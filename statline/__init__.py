"""Season-level reports for bat-and-ball sports, as Spark DataFrame jobs."""

from statline.plans.fielding_win_shares import FieldingWinShares
from statline.plans.range_by_age import range_by_age
from statline.plans.standard_pitching import standard_pitching
from statline.sources.tables import Tables

__all__ = ["FieldingWinShares", "Tables", "range_by_age", "standard_pitching"]
