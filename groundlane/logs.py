"""The run's text log."""

from __future__ import annotations

import logging
from pathlib import Path


def to_file_and_console(log_file: str, level: str = "INFO") -> logging.Logger:
    """Appends all messages from a level on to a file and shows them; an unknown level means INFO. Earlier handlers end."""
    Path(log_file).parent.mkdir(parents=True, exist_ok=True)
    known = logging.getLevelNamesMapping()
    handlers = [logging.FileHandler(log_file, mode="a"), logging.StreamHandler()]
    logging.basicConfig(level=known.get(level.upper(), logging.INFO), format="%(asctime)s - %(levelname)s - %(message)s", handlers=handlers, force=True)
    return logging.getLogger()
