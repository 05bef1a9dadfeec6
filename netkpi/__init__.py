"""Mobile-network counter reports to KPI tables, as Spark DataFrame jobs."""
