"""Web and e-commerce behaviour analytics as Spark DataFrame operators."""

from clickloom.config import AnalyticsConfig, FunnelStage, SeasonPeriod

__all__ = ["AnalyticsConfig", "FunnelStage", "SeasonPeriod"]
