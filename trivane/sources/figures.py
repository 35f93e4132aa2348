"""Figures of small result tables as SVG text: bars, heat maps and dots with intervals. The tables come from the engine; a
figure of more marks than MARKS is an error, as nobody could read it."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = 500
ROW, LEFT, WIDE = 22, 180, 400


def _rows(df: DataFrame, *order: str) -> list[dict]:
    got = [r.asDict() for r in df.orderBy(*order).limit(MARKS + 1).collect()]
    if len(got) > MARKS:
        raise ValueError(f"more than {MARKS} marks")
    return got


def _svg(width: int, height: int, marks: list[str]) -> str:
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', *marks, "</svg>"])


def _text(x: float, y: float, text, anchor: str = "start") -> str:
    return f'<text x="{x:g}" y="{y:g}" text-anchor="{anchor}">{escape(str(text))}</text>'


def bars(df: DataFrame, label: str, value: str) -> str:
    """A horizontal bar for each row, the largest first; null values have a label and no bar."""
    rows = _rows(df.select(label, value), F.desc_nulls_last(value), label)
    top = max((abs(r[value]) for r in rows if r[value] is not None), default=0) or 1
    marks = []
    for k, r in enumerate(rows):
        y = k * ROW
        marks.append(_text(LEFT - 6, y + 15, r[label], "end"))
        if r[value] is not None:
            marks.append(f'<rect x="{LEFT}" y="{y + 3}" width="{abs(r[value]) / top * WIDE:g}" height="{ROW - 6}" fill="#4477aa" data-value="{r[value]:.12g}"/>')
    return _svg(LEFT + WIDE + 10, max(1, len(rows)) * ROW, marks)


def heatmap(df: DataFrame, row: str, column: str, value: str) -> str:
    """A cell for each row and column, darker for larger values; missing ones stay white."""
    cells = _rows(df.select(row, column, value), row, column)
    rows, columns = ([*dict.fromkeys(sorted(str(c[k]) for c in cells))] for k in (row, column))
    known = [c[value] for c in cells if c[value] is not None]
    low, span = (min(known), (max(known) - min(known)) or 1) if known else (0, 1)
    marks = [_text(LEFT - 6, ROW * (k + 1) + 15, r, "end") for k, r in enumerate(rows)] + [_text(LEFT + 60 * k + 30, 15, c, "middle") for k, c in enumerate(columns)]
    for c in cells:
        x, y = LEFT + 60 * columns.index(str(c[column])), ROW * (rows.index(str(c[row])) + 1)
        if c[value] is not None:
            marks.append(f'<rect x="{x}" y="{y}" width="60" height="{ROW}" fill="#4477aa" fill-opacity="{0.1 + 0.9 * (c[value] - low) / span:.3f}" data-value="{c[value]:.12g}"/>')
    return _svg(LEFT + 60 * len(columns), ROW * (len(rows) + 1), marks)


def dots(df: DataFrame, label: str, value: str, low: str, high: str) -> str:
    """A dot and its interval for each row, by label; the scale holds all intervals."""
    rows = _rows(df.select(label, value, low, high), label)
    ends = [x for r in rows for x in (r[value], r[low], r[high]) if x is not None]
    least, span = (min(ends), (max(ends) - min(ends)) or 1) if ends else (0, 1)
    at = lambda v: LEFT + (v - least) / span * WIDE
    marks = []
    for k, r in enumerate(rows):
        y = k * ROW + ROW / 2
        marks.append(_text(LEFT - 6, y + 4, r[label], "end"))
        if r[low] is not None and r[high] is not None:
            marks.append(f'<line x1="{at(r[low]):g}" x2="{at(r[high]):g}" y1="{y:g}" y2="{y:g}" stroke="#4477aa"/>')
        if r[value] is not None:
            marks.append(f'<circle cx="{at(r[value]):g}" cy="{y:g}" r="4" fill="#4477aa" data-value="{r[value]:.12g}"/>')
    return _svg(LEFT + WIDE + 10, max(1, len(rows)) * ROW, marks)
