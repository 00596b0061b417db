"""DataFrame operators: detection, governance, reporting, metrics."""
