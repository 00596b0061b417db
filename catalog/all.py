"""Imports every query module."""

import catalog.detection  # noqa: F401
import catalog.extensions  # noqa: F401
import catalog.pipeline  # noqa: F401
import catalog.reporting  # noqa: F401
import catalog.sources  # noqa: F401
import catalog.streams  # noqa: F401
