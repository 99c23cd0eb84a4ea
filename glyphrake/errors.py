"""Errors of this package."""


class InvalidTextError(ValueError):
    """A text that can't be indexed."""

    def __init__(self, why: str):
        super().__init__(f"invalid text: {why}")


class InvalidPatternError(ValueError):
    """A pattern that the searched corpus gives no meaning to."""

    def __init__(self, why: str):
        super().__init__(f"invalid pattern: {why}")
