"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs)."""

from sigframe.functions.columns import (  # noqa: F401
    hash_fold,
    normal_two_sided_p,
    round_doubles,
    safe_div,
    sanitize_name,
)
