"""Decisions on one observation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ACCEPTED_STATUSES = ("draft", "queued", "sent", "unrouted")
LOCAL_DAMAGE = ("pothole_cavity", "failed_patch")
DAMAGE_TYPES = ("pothole_cavity", "failed_patch", "surface_breakup", "rut_or_depression", "other_road_damage")
POSITIVE_LABELS = ("pothole", *DAMAGE_TYPES, "reportable")
NEGATIVE_LABELS = ("not_pothole", "not_reportable", "none")


#: Measured fields of a sighting.
MEASURED = ("lat", "lng", "source_offset_s", "captured_at", "gps_accuracy", "speed_mps", "heading")


def finite_or_null(value: Column) -> Column:
    """A number, or null where it is none or not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def decision(reportable: Column, damage_type: Column, on_surface: Column, assessment: Column, quality: Column, temporal: Column, edge: Column, depth: Column) -> Column:
    """accept, review or reject; what is missing counts as not shown."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rejected = ~yes(reportable) | yes(damage_type == "none") | ~yes(on_surface) | yes(assessment == "absent")
    unsure = yes(quality == "unusable") | yes(temporal == "inconsistent") | ~yes(assessment.isin("clear", "probable")) | ~(yes(edge) | yes(depth))
    return F.when(rejected, "reject").when(unsure, "review").otherwise("accept")


def status(verdict: Column, covered: Column) -> Column:
    """The status a new report gets."""
    return F.when((verdict == "accept") & covered, "draft").when(verdict == "accept", "unrouted").when(verdict == "review", "review").otherwise("rejected")


def is_accepted(verdict: Column, state: Column) -> Column:
    """Whether a stored report counts as accepted."""
    return F.coalesce(verdict == "accept", F.lit(False)) | F.coalesce(state.isin(*ACCEPTED_STATUSES), F.lit(False))


def compatible_damage(a: Column, b: Column) -> Column:
    """Whether two damage types can be one event."""
    return F.coalesce((a == b) | (a.isin(*LOCAL_DAMAGE) & b.isin(*LOCAL_DAMAGE)), F.lit(False))


def size_conflict(a: Column, b: Column) -> Column:
    """Whether one is small and the other large."""
    return F.coalesce(((a == "small") & (b == "large")) | ((a == "large") & (b == "small")), F.lit(False))


def binary_label(label: Column) -> Column:
    """true, false, or null for labels that say neither."""
    return F.when(label.isin(*POSITIVE_LABELS), F.lit(True)).when(label.isin(*NEGATIVE_LABELS), F.lit(False))


def entry_mode(mode: Column, source: Column) -> Column:
    """The given mode if it is known, else drive for dashcam sources and manual for others."""
    guess = F.when(F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("dashcam")), "drive").otherwise("manual")
    return F.when(mode.isin("manual", "drive"), mode).otherwise(guess)


def allowed_or(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A setting if it is among those allowed, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def accuracy_gate(accuracy: Column, enforce: Column, most: float = 30) -> Column:
    """Whether a position is precise enough; without enforcement any is."""
    good = accuracy.isNotNull() & ~F.isnan(accuracy) & accuracy.between(0, most)
    return ~F.coalesce(enforce, F.lit(True)) | F.coalesce(good, F.lit(False))


def place_match(fields: Column, aliases: Column) -> Column:
    """Whether some place field is given and every given one is an alias."""
    given = F.filter(fields, lambda x: x.isNotNull() & (x != ""))
    return (F.size(given) > 0) & F.forall(given, lambda x: F.array_contains(aliases, x))


def in_state(country: Column, state: Column, aliases: Column) -> Column:
    """Whether a geocoded place lies in a state of the country: its name is one of the aliases, by authority keys."""
    return F.coalesce((F.lower(F.trim(country)) == "in") & F.array_contains(aliases, state), F.lit(False))


def prefix_decision(text: Column) -> Column:
    """The decision that an unfinished JSON answer already settles; null while it is open.

    Only closed values count. An answer that says it is not reportable is rejected at once.
    """
    said = lambda name, values: F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*({values})', 1), F.lit(""))
    flag = lambda name: said(name, "true|false")
    word = lambda name, values: F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*"({values})"', 1), F.lit(""))
    reportable = flag("reportable")
    parts = {
        "assessment": word("assessment", "clear|probable|uncertain|absent"),
        "quality": word("image_quality", "usable|limited|unusable"),
        "damage": word("damage_type", "|".join((*DAMAGE_TYPES, "none"))),
        "surface": flag("on_drivable_surface"),
        "edge": flag("has_broken_edge_or_rim"),
        "depth": flag("has_depth_or_surface_loss"),
        "temporal": word("temporal_consistency", "consistent|single_view|inconsistent|not_applicable"),
    }
    known = F.lit(True)
    for p in parts.values():
        known = known & p.isNotNull()
    full = decision(F.lit(True), parts["damage"], parts["surface"] == "true", parts["assessment"], parts["quality"], parts["temporal"], parts["edge"] == "true", parts["depth"] == "true")
    return F.when(reportable == "false", "reject").when((reportable == "true") & known, full)


def frame_score(sharpness: Column, luminance: Column, clipped: Column) -> Column:
    """How usable a frame is: sharp, of middle brightness, not clipped; -100 for an unusable exposure."""
    unusable = (clipped > 0.70) | (luminance < 18) | (luminance > 238)
    return F.when(unusable, F.lit(-100.0)).otherwise(sharpness - F.abs(luminance - 115) * 0.055 - clipped * 45)


def low_light_lift(mean: Column, bright_share: Column) -> Column:
    """By how much a dark frame is brightened; 1 where it is not."""
    lift = F.least(F.lit(1.65), F.greatest(F.lit(1.15), F.lit(85.0) / F.greatest(F.lit(35.0), mean)))
    return F.when((mean < 72) & (bright_share < 0.08), lift).otherwise(F.lit(1.0))
