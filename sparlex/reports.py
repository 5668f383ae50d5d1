"""Reports of small results: markdown tables with what produced them."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def markdown_table(df: DataFrame, most: int = MOST_ROWS) -> str:
    """A result as a markdown table; more rows than a report holds are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])


def report(title: str, sections: dict[str, DataFrame], settings: dict | None = None) -> str:
    stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
    head = [f"# {title}", f"Made {stamp}.", "", "```json", json.dumps(settings or {}, sort_keys=True), "```"]
    return "\n".join(head + [f"\n## {name}\n\n{markdown_table(df)}" for name, df in sections.items()]) + "\n"
