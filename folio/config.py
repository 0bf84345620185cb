"""Settings: frozen options, and a YAML tree with dotted lookup."""

from __future__ import annotations

import copy
import logging
import sys
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class TextOptions:
    """Options of the text pipeline; ``of`` takes them from a tree of settings."""

    similarity_threshold: float = 0.8
    remove_bounding_boxes: bool = True
    aggressive_ocr_correction: bool = False
    max_chunk_length: int = 512
    chunk_overlap: int = 50
    merge_page_breaks: bool = True
    fix_duplicate: bool = False

    @classmethod
    def of(cls, config: Config) -> TextOptions:
        known = {name: config.get(f"text_processing.{name}") for name in cls.__dataclass_fields__}
        return cls(**{name: value for name, value in known.items() if value is not None})


#: Settings and folders that hold where no file gives others.
DEFAULTS: dict[str, Any] = {
    "ocr": {"model_name": None},
    "text_processing": {"similarity_threshold": 0.8, "max_chunk_length": 512, "chunk_overlap": 50},
    "labelling": {"model_path": None, "batch_size": 8, "confidence_threshold": 0.5, "max_length": 512},
    "paths": {"raw_data": "data/raw", "processed_data": "data/processed", "models": "models", "outputs": "outputs", "logs": "logs"},
}


class Config:
    """A tree of settings; a missing file means the defaults."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.tree = self._loaded(path) if path and Path(path).exists() else copy.deepcopy(DEFAULTS)

    @staticmethod
    def _loaded(path: str) -> dict[str, Any]:
        import yaml

        return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}

    def get(self, key: str, default: Any = None) -> Any:
        """Value at a dotted key; absent and null values give the default."""
        at: Any = self.tree
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
            if at is None:
                return default
        return at

    def save(self, path: str | None = None) -> None:
        import yaml

        target = path or self.path
        if not target:
            raise ValueError("no path to save to")
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        Path(target).write_text(yaml.safe_dump(self.tree, sort_keys=False, allow_unicode=True), encoding="utf-8")


def setup_logging(folder: str = "logs", level: int = logging.INFO) -> logging.Logger:
    """Log on the driver to a time-stamped file and to standard output."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("folio")
    log.setLevel(level)
    log.handlers.clear()
    for handler in (logging.FileHandler(f"{folder}/folio-{datetime.now():%Y-%m-%dT%H-%M-%S}.log", encoding="utf-8"), logging.StreamHandler(sys.stdout)):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-7s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log
