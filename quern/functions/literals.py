"""Values as SQL text. A plan that is given as text takes one call to the JVM where columns take one for each operator."""

from __future__ import annotations


def text_sql(text: str) -> str:
    """``text`` as a constant expression, whatever the session's rule for backslashes and quotes; it folds to a literal that scans can push."""
    if text.isascii() and text.isalnum():
        return f"'{text}'"
    return f"CAST(X'{text.encode().hex()}' AS STRING)"


def double_sql(value: float) -> str:
    return f"{float(value)!r}D"
