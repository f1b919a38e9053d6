"""Shot semantics on four axes and the older single label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axis labels, in the order of a model's outputs.
PHASES = ("SERVE", "RETURN", "RALLY", "UNKNOWN")
CONTACT_MODES = ("GROUNDSTROKE", "VOLLEY", "OVERHEAD", "UNKNOWN")
STROKE_SIDES = ("FOREHAND", "BACKHAND", "TWO_HANDED_BACKHAND", "UNKNOWN")
INTENTS = ("DINK", "DROP", "DRIVE", "LOB", "RESET", "SPEEDUP", "OTHER", "UNKNOWN")
AXES = ("phase", "contact_mode", "stroke_side", "intent")


def axes_from_legacy(df: DataFrame, label: str, anchored: str) -> DataFrame:
    """Add the four axes that an old label supports; nothing else is claimed."""
    old = F.upper(F.col(label))
    phase = F.when(old.isin("SERVE", "RETURN"), old).when(F.col(anchored), "RALLY").otherwise("UNKNOWN")
    mode = F.when(old.isin("VOLLEY", "OVERHEAD"), old).otherwise("UNKNOWN")
    intent = F.when(old.isin("DINK", "DROP", "DRIVE", "OTHER"), old).otherwise("UNKNOWN")
    return df.withColumns({"phase": phase, "contact_mode": mode, "stroke_side": F.lit("UNKNOWN"), "intent": intent})


def legacy_from_axes(phase: Column, mode: Column, intent: Column) -> Column:
    """Old label of four axes: phase first, then overhead, intent, volley, other."""
    return (
        F.when(phase.isin("SERVE", "RETURN"), phase)
        .when(mode == "OVERHEAD", "OVERHEAD")
        .when(intent.isin("DINK", "DROP", "DRIVE"), intent)
        .when(mode == "VOLLEY", "VOLLEY")
        .when((phase == "RALLY") & (mode != "UNKNOWN") & (intent == "OTHER"), "OTHER")
        .otherwise("UNKNOWN")
    )
