"""The engine's error: a stable code, a message, and details for programs."""

from __future__ import annotations


class LoomError(ValueError):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details
