"""anbar: stock-movement analytics and forecasting as Spark DataFrame jobs."""

from anbar.config import Config

__all__ = ["Config"]
