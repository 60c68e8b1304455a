"""Control files of a running crawl: stop, pause and tune. They are looked at between levels."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from linkloom.plans.config import CrawlConfig


class Control:
    """What the files named in a config ask for. The tune file's content at the start is the baseline."""

    def __init__(self, config: CrawlConfig, sleep: Callable[[float], None] = time.sleep):
        self.config, self.sleep, self.stopped = config, sleep, False
        self.last = self._tune_text()

    def _tune_text(self) -> str | None:
        if not self.config.tune_file or not os.path.exists(self.config.tune_file):
            return None
        with open(self.config.tune_file, encoding="utf-8") as f:
            return f.read()

    def wait(self) -> bool:
        """False once the stop file exists; waits while the pause file does."""
        there = lambda name: bool(name) and os.path.exists(name)
        while not there(self.config.stop_file):
            if not there(self.config.pause_file):
                return True
            self.sleep(0.4)
        self.stopped = True
        return False

    def tuned(self, config: CrawlConfig) -> CrawlConfig:
        """The config with the pacing of a tune file that has changed."""
        text = self._tune_text()
        if text is None or text == self.last:
            return config
        self.last = text
        return config.tuned(text)

    def exit_code(self) -> int:
        """130 after a stop, else 0."""
        return 130 if self.stopped else 0
