"""Plots of reports as SVG, drawn from what Spark has binned: the driver gets bins, never rows."""

from __future__ import annotations

from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram and of a course along frames, at most; size of a plot.
BINS, STEPS = 24, 200
WIDTH, HEIGHT, MARGIN = 640, 320, 48


def histogram(long: DataFrame, bins: int = BINS) -> DataFrame:
    """(metric, bin, low, high, n) of the finite values of rows (metric, value): bins of one width from the least to the largest value of
    the metric, which is in the last one. A metric with one value has one bin."""
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).select("metric", "value")
    bounds = rows.groupBy(F.col("metric").alias("m")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    both = rows.join(bounds, F.col("metric") == F.col("m"))
    place = F.when(F.col("most") > F.col("least"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("least")) / (F.col("most") - F.col("least")) * bins))).otherwise(0)
    counted = both.groupBy("metric", place.cast("int").alias("bin"), "least", "most").agg(F.count("*").alias("n"))
    step = (F.col("most") - F.col("least")) / bins
    return counted.select("metric", "bin", (F.col("least") + F.col("bin") * step).alias("low"), (F.col("least") + (F.col("bin") + 1) * step).alias("high"), "n")


def course(long: DataFrame, n_frames: int, steps: int = STEPS) -> DataFrame:
    """(metric, step, first, low, mean, high, n) of rows (k from 0, metric, value): means and bounds of runs of frames, `steps` at most."""
    run = max(1, -(-n_frames // steps))
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    out = rows.groupBy("metric", F.floor(F.col("k") / run).cast("int").alias("step"))
    return out.agg(F.min("k").alias("first"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.count("*").alias("n"))


def _frame(title: str, body: list[str], below: str, left: str, right: str, top: str) -> str:
    x0, x1, y0, y1 = MARGIN, WIDTH - MARGIN, HEIGHT - MARGIN, MARGIN
    texts = [(WIDTH / 2, MARGIN / 2, "middle", title), (x0, y0 + 18, "start", left), (x1, y0 + 18, "end", right), (x0 - 6, y0, "end", below), (x0 - 6, y1 + 4, "end", top)]
    labels = "".join(f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{a}">{escape(t)}</text>' for x, y, a, t in texts)
    axes = f'<path d="M{x0} {y1}V{y0}H{x1}" fill="none" stroke="#444"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="12" data-title={quoteattr(title)}>{axes}{"".join(body)}{labels}</svg>'


def draw_histogram(metric: str, bins: list[dict]) -> str:
    """Bars of the bins of one metric; each bar carries its bin and count."""
    bins = sorted(bins, key=lambda b: b["bin"])
    most, total = max((b["n"] for b in bins), default=1), max((b["bin"] for b in bins), default=0) + 1
    wide = (WIDTH - 2 * MARGIN) / total
    bars = []
    for b in bins:
        tall = (HEIGHT - 2 * MARGIN) * b["n"] / most
        bars.append(
            f'<rect x="{MARGIN + b["bin"] * wide:.2f}" y="{HEIGHT - MARGIN - tall:.2f}" width="{max(0.5, wide - 1):.2f}" height="{tall:.2f}" fill="#3b6fb6" data-bin="{b["bin"]}" data-n="{b["n"]}">'
            f'<title>{b["low"]:.4g} to {b["high"]:.4g}: {b["n"]}</title></rect>'
        )
    return _frame(metric, bars, "0", f'{bins[0]["low"]:.4g}' if bins else "", f'{bins[-1]["high"]:.4g}' if bins else "", str(most))


def draw_course(metric: str, steps: list[dict]) -> str:
    """The means of runs of frames as a line, in a band from the least to the largest value."""
    steps = sorted(steps, key=lambda s: s["step"])
    low, high = min((s["low"] for s in steps), default=0.0), max((s["high"] for s in steps), default=1.0)
    last = max((s["step"] for s in steps), default=0) or 1
    x = lambda s: MARGIN + (WIDTH - 2 * MARGIN) * s["step"] / last
    y = lambda v: HEIGHT - MARGIN - (HEIGHT - 2 * MARGIN) * (v - low) / ((high - low) or 1)
    line = lambda points: " ".join(f"{a:.2f},{b:.2f}" for a, b in points)
    band = line([(x(s), y(s["high"])) for s in steps] + [(x(s), y(s["low"])) for s in reversed(steps)])
    dots = [f'<circle cx="{x(s):.2f}" cy="{y(s["mean"]):.2f}" r="1.5" fill="#3b6fb6" data-first="{s["first"]}" data-n="{s["n"]}" data-mean="{s["mean"]!r}"/>' for s in steps]
    body = [f'<polygon points="{band}" fill="#cfdcf0"/>', f'<polyline points="{line([(x(s), y(s["mean"])) for s in steps])}" fill="none" stroke="#3b6fb6"/>', *dots]
    return _frame(metric, body, f"{low:.4g}", f'frame {steps[0]["first"]}' if steps else "", f'frame {steps[-1]["first"]}' if steps else "", f"{high:.4g}")


def counts_of(svg: str) -> dict[int, int]:
    """The bins and counts that a histogram's bars carry."""
    return {int(r.get("data-bin")): int(r.get("data-n")) for r in ET.fromstring(svg).iter("{http://www.w3.org/2000/svg}rect")}
