"""Query suites registered by the driver contract."""
