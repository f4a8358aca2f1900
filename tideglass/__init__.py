"""tideglass: relationship-risk analytics over event tables, written as Spark DataFrame and SQL jobs."""
