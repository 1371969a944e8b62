"""Errors with a code and, where there is one, a way out."""

from __future__ import annotations

#: The codes.
CODES = ("NO_INDEX", "EMPTY_DIR", "UNSUPPORTED_TYPE", "CORRUPT_MANIFEST", "INVALID_MODE", "GENERAL_ERROR")


class EngineError(Exception):
    def __init__(self, code: str, message: str, suggestion: str = ""):
        super().__init__(message)
        assert code in CODES
        self.code, self.message, self.suggestion = code, message, suggestion

    def as_dict(self) -> dict[str, str]:
        return {"error": self.message, "code": self.code, "suggestion": self.suggestion}
