"""Small helpers to write Spark SQL expression text.

Large row-local expressions (the HTML features) are written as Spark SQL
text and handed to ``F.expr`` once: building the same tree through the
Column API costs hundreds of JVM round trips per function, seconds per plan.
"""

from __future__ import annotations

import itertools

_counter = itertools.count()


def q(s: str) -> str:
    """Spark SQL string literal for ``s`` (backslash escapes, control chars as \\uXXXX)."""
    out = []
    for ch in s:
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ord(ch) < 0x20 or ch in "  \u0085":
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def fresh(prefix: str = "v") -> str:
    """A lambda variable name unique within the process."""
    return f"_{prefix}{next(_counter)}"


def bind(expr: str, fn) -> str:
    """Evaluate ``expr`` once per row and use it as a variable inside ``fn(name)``.

    (Catalyst would otherwise inline a projected value into every lambda use.)
    """
    v = fresh("b")
    return f"transform(array({expr}), {v} -> {fn(v)})[0]"


def lam(fn, n: int = 1, prefix: str = "x") -> str:
    names = [fresh(prefix) for _ in range(n)]
    head = names[0] if n == 1 else "(" + ", ".join(names) + ")"
    return f"{head} -> {fn(*names)}"
