"""Charts of small result tables as SVG text: histograms, and an observed line over the band of its null.

Rows are those of a binned table or of a band, some dozens; the engine bins, a chart only draws.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

WIDTH, HEIGHT, LEFT, TOP, BOTTOM = 760, 430, 64, 40, 48


def _frame(title: str, x_label: str, y_label: str, most: float, body: list[str]) -> str:
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">', f'<text x="{WIDTH / 2}" y="20" text-anchor="middle" font-size="14">{escape(title)}</text>']
    for i in range(5):
        y = HEIGHT - BOTTOM - (HEIGHT - TOP - BOTTOM) * i / 4
        lines += [f'<line x1="{LEFT}" x2="{WIDTH - 10}" y1="{y:.1f}" y2="{y:.1f}" stroke="#ddd"/>', f'<text x="{LEFT - 6}" y="{y + 4:.1f}" text-anchor="end">{most * i / 4:.4g}</text>']
    axis = [f'<text x="{(LEFT + WIDTH) / 2}" y="{HEIGHT - 10}" text-anchor="middle">{escape(x_label)}</text>', f'<text x="14" y="{HEIGHT / 2}" text-anchor="middle" transform="rotate(-90 14 {HEIGHT / 2})">{escape(y_label)}</text>']
    return "\n".join([*lines, *body, *axis, "</svg>"]) + "\n"


def _scale(n: int, most: float):
    step = (WIDTH - 10 - LEFT) / max(1, n)
    return step, lambda i: LEFT + step * (i + 0.5), lambda v: HEIGHT - BOTTOM - (HEIGHT - TOP - BOTTOM) * (v or 0) / (most or 1)


def histogram(df: DataFrame, label: str, value: str, title: str, x_label: str = "", y_label: str = "", mark: float | None = None) -> str:
    """Bars of ``value`` by ``label``, in the order of the rows; ``mark`` is a place among them, such as an observed value."""
    rows = [(str(r[label]), float(r[value] or 0)) for r in df.toLocalIterator()]
    most = max([v for _, v in rows], default=0) * 1.05
    step, x, y = _scale(len(rows), most)
    body = [f'<rect x="{x(i) - step * 0.45:.1f}" y="{y(v):.1f}" width="{step * 0.9:.1f}" height="{HEIGHT - BOTTOM - y(v):.1f}" fill="#7a9cc6"/>' for i, (_, v) in enumerate(rows)]
    body += [f'<text x="{x(i):.1f}" y="{HEIGHT - BOTTOM + 14}" text-anchor="middle">{escape(t)}</text>' for i, (t, _) in enumerate(rows) if i % max(1, len(rows) // 12) == 0]
    if mark is not None:
        body.append(f'<line x1="{x(mark - 0.5):.1f}" x2="{x(mark - 0.5):.1f}" y1="{TOP}" y2="{HEIGHT - BOTTOM}" stroke="#c0392b" stroke-width="2"/>')
    return _frame(title, x_label, y_label, most, body)


def null_band(df: DataFrame, title: str, x_label: str = "", y_label: str = "", label: str = "bin") -> str:
    """The observed line over the median and the 95 % band of its null, from ``bin_band`` or any band table."""
    rows = sorted(([r[label], *(float(r[c] or 0) for c in ("empirical", "null_median", "null_p2_5", "null_p97_5"))] for r in df.toLocalIterator()), key=lambda r: r[0])
    most = max([v for r in rows for v in r[1:]], default=0) * 1.05
    _, x, y = _scale(len(rows), most)
    line = lambda k: " ".join(f"{x(i):.1f},{y(r[k]):.1f}" for i, r in enumerate(rows))
    back = " ".join(f"{x(i):.1f},{y(rows[i][3]):.1f}" for i in reversed(range(len(rows))))
    body = [f'<polygon points="{line(4)} {back}" fill="#ccc"/>', f'<polyline points="{line(2)}" fill="none" stroke="#555" stroke-dasharray="5 3"/>', f'<polyline points="{line(1)}" fill="none" stroke="#c0392b" stroke-width="2"/>']
    body += [f'<text x="{x(i):.1f}" y="{HEIGHT - BOTTOM + 14}" text-anchor="middle">{escape(str(r[0]))}</text>' for i, r in enumerate(rows) if i % max(1, len(rows) // 12) == 0]
    return _frame(title, x_label, y_label, most, body)
