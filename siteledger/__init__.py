"""siteledger: margin analytics for contractor portfolios, as Spark DataFrame jobs."""
