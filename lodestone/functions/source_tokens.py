"""Digest of C-family code without comments and white space."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a literal is one token, so comment marks inside it mean nothing; an open comment or literal runs to the end
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\\\r?\n|//(?:\\\r?\n|[^\n])*|/\*[\s\S]*?(?:\*/|\Z))
      |(?:u8|[uUL])?R"(?P<tag>[^\s()\\]{0,16})\([\s\S]*?(?:\)(?P=tag)"|\Z)
      |(?:u8|[uUL])?"(?:\\[\s\S]|[^"\\])*(?:"|\Z) |(?:u8|[uUL])?'(?:\\[\s\S]|[^'\\])*(?:'|\Z)
      |[A-Za-z_$][\w$]* |\.?\d(?:[eEpP][+-]|['\w.])*
      |<<=|>>=|\.\.\.|->\*|<=>|\#\#|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[\s\S]""",
    re.X,
)


def source_tokens(code: str) -> list[str]:
    """Tokens of the code, literals whole, without comments, white space and joined lines."""
    return [m.group() for m in _TOKEN.finditer(code) if m.lastgroup != "skip" and not m.group("skip")]


@F.pandas_udf(T.StringType())
def _digest(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else hashlib.sha256("\x1f".join(source_tokens(c)).encode("utf-8", "surrogatepass")).hexdigest())


def source_digest(code: Column) -> Column:
    """SHA-256 of the tokens joined by U+001F; null for null. Code that differs in layout or comments only has one digest."""
    return _digest(code)
