"""Scalar expressions as SQL text that Spark and other engines read alike."""


def div(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"(({a}) / nullif({b}, 0))"


def ratio(a: str, b: str) -> str:
    """a / b where b is above 0, else null."""
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / nullif({b}, 0) END)"


def flag(condition: str) -> str:
    """1 where the condition holds, else 0."""
    return f"(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


def when(condition: str, value: str) -> str:
    """The value where the condition holds, else 0."""
    return f"(CASE WHEN {condition} THEN {value} ELSE 0.0 END)"
