"""Results in words, from tables of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import levels as L


def _rows(df: DataFrame, key: str) -> dict:
    return {r[key]: r for r in df.toLocalIterator()}


def _place(r) -> str:
    return f"{r.empirical} against a null median of {r.null_median} (95 % band {r.null_p2_5} to {r.null_p97_5}), p = {r.two_sided_p}"


def occupancy(bands: DataFrame, bins: DataFrame) -> str:
    """The verdict on round levels, from ``null_band`` and ``bin_band``."""
    stats, of = _rows(bands, "statistic"), _rows(bins, "bin")
    outside = [k for k, r in stats.items() if r.outside_band]
    if outside:
        head = f"Outside the null's 95 % band: {', '.join(sorted(outside))}. A walk with the same returns doesn't fully explain the distances; another null and other data have to confirm it."
    else:
        head = "Every statistic lies inside the null's 95 % band. A walk with the same returns keeps these distances by itself, so no avoidance of levels can be claimed."
    low = sum(1 for i in range(L.MAIN_THRESHOLD) if i in of and of[i].below_band)
    parts = [head, f"Mean distance: {_place(stats['mean_distance'])}."]
    if 0 in of:
        parts.append(f"Bin {of[0].label}: {of[0].empirical} against {of[0].null_median} ({of[0].null_p2_5} to {of[0].null_p97_5}).")
    return "\n\n".join([*parts, f"Of the {L.MAIN_THRESHOLD} bins next to a level, {low} lie under the band."])


def proximity(bands: DataFrame, threshold: int = L.MAIN_THRESHOLD) -> str:
    """The verdict on volatility after near days, from ``near_far_band``."""
    r = _rows(bands, "threshold")[threshold]
    if r.empirical is None:
        return f"No day lies on both sides of the threshold {threshold}: there is no comparison."
    way = "higher" if r.empirical > 0 else "lower" if r.empirical < 0 else "the same"
    verdict = "more than the null allows" if r.outside_band else "which the null allows"
    return f"After {r.days_near} days within {threshold} of a level, the outcome is {way}, {verdict}: {_place(r)}."


def sensitivity(variants: DataFrame) -> str:
    """Where the observed share falls as the null is built in other ways."""
    rows = list(variants.toLocalIterator())
    out = [r.variant for r in rows if not 2.5 <= r.empirical_percentile <= 97.5]
    head = f"The observed share leaves the band in {len(out)} of {len(rows)} variants: {', '.join(out)}." if out else f"The observed share stays inside the band in all {len(rows)} variants."
    return head + " Percentiles: " + ", ".join(f"{r.variant} {r.empirical_percentile}" for r in rows) + "."
