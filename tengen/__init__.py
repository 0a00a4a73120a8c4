"""Tournament analytics for Go (weiqi) as PySpark DataFrame jobs."""
