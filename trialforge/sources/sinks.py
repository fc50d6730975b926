"""Sinks of small results: CSV, Markdown, tables for a terminal, pages with charts, timeline JSON, Chrome traces."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report is read by people; more rows than this are no report.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """One file with a header, doubles rounded; for aggregates, not for facts."""
    out = df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("too many rows for a report")
    return rows


def shown(v, digits: int = 3) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, title: str, digits: int = 3) -> str:
    """A table in Markdown."""
    rows, show = report_rows(df), lambda v: shown(v, digits)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows), ""])


def write_timeline_json(lanes: DataFrame, path: str) -> None:
    """One JSON line per run: its lanes and their events."""
    lanes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("agent_id", "agent_role", "trace_ids"))).alias("lanes")).write.mode("overwrite").json(path)


def write_chrome(events: DataFrame, path: str) -> None:
    """Events as JSON lines, which trace viewers take within [ and ]."""
    events.select(F.to_json(F.struct("name", "ph", "ts", "dur", "pid", "tid")).alias("value")).write.mode("overwrite").text(path)


def chrome_document(events: DataFrame) -> str:
    """The events of one run as a document."""
    return json.dumps({"traceEvents": [r.asDict() for r in report_rows(events)]})


def console_table(df: DataFrame, title: str, digits: int = 3) -> str:
    """A table for a terminal: columns as wide as their longest value, numbers to the right."""
    rows = [[shown(v, digits) for v in r] for r in report_rows(df)]
    width = [max(map(len, column)) for column in zip(df.columns, *rows, strict=True)]
    right = [t not in ("string", "boolean") for _, t in df.dtypes]
    line = lambda r: " | ".join(v.rjust(w) if k else v.ljust(w) for v, w, k in zip(r, width, right, strict=True)).rstrip()
    return "\n".join([title, line(df.columns), "-+-".join("-" * w for w in width), *map(line, rows), ""])


WIDE, HIGH, EDGE = 720, 440, 60


def _page(title: str, body: list[str]) -> str:
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><svg xmlns="http://www.w3.org/2000/svg" width="{WIDE}" height="{HIGH}" font-family="sans-serif" font-size="11"><text x="{EDGE}" y="20" font-size="14">{escape(title)}</text>{"".join(body)}</svg>'


def _scale(values: list[float], low: float, high: float):
    a, b = min(values, default=0.0), max(values, default=1.0)
    return lambda v: low + (high - low) * ((v - a) / (b - a) if b > a else 0.5)


def _text(x: float, y: float, what, **more: str) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}"{"".join(f" {k}={chr(34)}{v}{chr(34)}" for k, v in more.items())}>{escape(str(what))}</text>'


def _axes(x: str, y: str, xs: list[float], ys: list[float]) -> list[str]:
    out = [f'<path d="M{EDGE} 40V{HIGH - EDGE}H{WIDE - 20}" fill="none" stroke="#444"/>', _text(WIDE / 2, HIGH - 15, x), _text(8, 34, y)]
    px, py = _scale(xs, EDGE, WIDE - 20), _scale(ys, HIGH - EDGE, 40)
    for v in sorted({min(xs, default=0.0), max(xs, default=0.0)}) if xs else ():
        out.append(_text(px(v), HIGH - EDGE + 16, shown(float(v))))
    return out + [_text(8, py(v) + 4, shown(float(v))) for v in sorted({min(ys, default=0.0), max(ys, default=0.0)}) if ys]


def scatter_page(df: DataFrame, x: str, y: str, label: str, title: str, marked: str | None = None) -> str:
    """A page with a point for each row that has both values; rows where `marked` holds (a frontier) are joined by a line."""
    rows = [r for r in report_rows(df) if r[x] is not None and r[y] is not None]
    xs, ys = [r[x] for r in rows], [r[y] for r in rows]
    px, py = _scale(xs, EDGE, WIDE - 20), _scale(ys, HIGH - EDGE, 40)
    body = _axes(x, y, xs, ys)
    if marked and (line := sorted((r[x], r[y]) for r in rows if r[marked])):
        body.append('<polyline fill="none" stroke="#c33" points="' + " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in line) + '"/>')
    for r in rows:
        body += [f'<circle cx="{px(r[x]):.1f}" cy="{py(r[y]):.1f}" r="4" fill="{"#c33" if marked and r[marked] else "#36c"}"/>', _text(px(r[x]) + 6, py(r[y]) - 6, r[label])]
    return _page(title, body)


def heatmap_page(df: DataFrame, row: str, title: str) -> str:
    """A page with a cell for each row and each other column, darker for larger values; nulls are blank."""
    rows, columns = sorted(report_rows(df), key=lambda r: str(r[row])), [c for c in df.columns if c != row]
    values = [r[c] for r in rows for c in columns if r[c] is not None]
    shade, w, h = _scale(values, 0.1, 0.9), (WIDE - 2 * EDGE - 60) / max(1, len(columns)), (HIGH - 80) / max(1, len(rows))
    body = [_text(EDGE + 60 + k * w + 4, 50, c) for k, c in enumerate(columns)]
    for i, r in enumerate(rows):
        body.append(_text(8, 60 + (i + 0.6) * h, r[row]))
        for k, c in enumerate(columns):
            if r[c] is not None:
                body += [f'<rect x="{EDGE + 60 + k * w:.1f}" y="{60 + i * h:.1f}" width="{w - 2:.1f}" height="{h - 2:.1f}" fill="#36c" fill-opacity="{shade(r[c]):.2f}"/>', _text(EDGE + 64 + k * w, 60 + (i + 0.6) * h, shown(float(r[c]), 2))]
    return _page(title, body)


def boxplot_page(df: DataFrame, label: str, title: str, parts: tuple[str, ...] = ("low", "q25", "median", "q75", "high")) -> str:
    """A page with a box for each row, from five columns: both ends, both quartiles, the median."""
    rows = sorted(report_rows(df), key=lambda r: str(r[label]))
    ys = [r[c] for r in rows for c in parts if r[c] is not None]
    py, step = _scale(ys, HIGH - EDGE, 40), (WIDE - EDGE - 20) / max(1, len(rows))
    body = _axes(label, "", [], ys)
    for i, r in enumerate(rows):
        if any(r[c] is None for c in parts):
            continue
        a, b, c, d, e = (py(r[p]) for p in parts)
        x, w = EDGE + (i + 0.2) * step, 0.6 * step
        body += [f'<path d="M{x + w / 2:.1f} {a:.1f}V{b:.1f}M{x + w / 2:.1f} {d:.1f}V{e:.1f}M{x:.1f} {c:.1f}h{w:.1f}" stroke="#36c"/>', f'<rect x="{x:.1f}" y="{d:.1f}" width="{w:.1f}" height="{b - d:.1f}" fill="none" stroke="#36c"/>', _text(x, HIGH - EDGE + 16, r[label])]
    return _page(title, body)
