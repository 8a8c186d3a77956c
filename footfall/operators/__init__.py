"""DataFrame -> DataFrame steps. None runs a Spark job or collects to the driver."""
