"""Analytics for life-science and imaging tables on Spark: DataFrame to DataFrame, Column to Column."""
