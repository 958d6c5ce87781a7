"""Errors with stable codes; messages never hold values."""


class SealError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
