"""Plan text through the public ``DataFrame.explain``.

After an action has run the DataFrame, the adaptive plan printed is the
final one (``isFinalPlan=true``); ``final_plan`` keeps only that part.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "simple") -> str:
    """What ``df.explain(mode=mode)`` prints, as a string."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def final_plan(df: DataFrame) -> str:
    """The executed physical plan without AQE's initial plans.

    Every adaptive plan (the query's and each subquery's) prints a
    ``+- == Initial Plan ==`` subtree after its final one; each such subtree
    is dropped, up to the next line at its own depth or shallower.
    """
    out, skip_from = [], None
    for line in plan_text(df).splitlines():
        body = line.lstrip(" :|")
        depth = len(line) - len(body)
        if skip_from is not None:
            if depth > skip_from or not body:
                continue
            skip_from = None
        if body.startswith("+- == Initial Plan =="):
            skip_from = depth
            continue
        out.append(line)
    return "\n".join(out)
