"""What can be wrong with a filter."""


class FilterError(ValueError):
    """kind is one of syntax, regex, integer, date, hex, hex_length, ipv4; at is the place in the text, if known."""

    def __init__(self, kind: str, message: str, at: int | None = None):
        super().__init__(f"{message} (at {at})" if at is not None else message)
        self.kind, self.at = kind, at
