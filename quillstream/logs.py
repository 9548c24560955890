"""Driver-side logging as text or JSON lines."""

from __future__ import annotations

import json
import logging


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in record.__dict__.items() if k in ("script_id", "page_index", "stage")}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out)


def configure(level: str = "INFO", kind: str = "text", path: str | None = None) -> logging.Logger:
    """The package's logger, writing to a file or to standard error; calling it again replaces its handler."""
    log = logging.getLogger("quillstream")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonLines() if kind == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.addHandler(handler)
    log.setLevel(level)
    return log
