"""A compact filter language over the access log, compiled to Catalyst expressions.

    status 400 .. 500 & uri /api/ *
    (method POST | method PUT) & !(loc DE) & time -15m ..
"""

from hitlore.filterlang.ast import from_json, to_json
from hitlore.filterlang.columns import compile_filter, where
from hitlore.filterlang.errors import FilterError
from hitlore.filterlang.parser import parse

__all__ = ["FilterError", "compile_filter", "from_json", "parse", "to_json", "where"]
