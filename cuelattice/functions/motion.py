"""Transition and text-animation state at a clip-local time, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelattice.functions.scalars import clamp, ease_in_cubic, ease_out_back, ease_out_bounce, ease_out_cubic

NEUTRAL = {"alpha": 1.0, "dx": 0.0, "dy": 0.0, "scale": 1.0, "scale_x": 1.0, "rotation": 0.0, "reveal": 1.0}


def transition_state(local: Column, duration: Column, in_type: Column, in_ms: Column, out_type: Column, out_ms: Column) -> Column:
    """Struct ``(type, phase, progress, opacity)``; the incoming side wins while it runs."""
    left = duration - local
    entering = (in_type != "none") & (in_ms > 0) & (local < in_ms)
    leaving = (out_type != "none") & (out_ms > 0) & (left <= out_ms)
    p_in, p_out = clamp(local / in_ms, 0.0, 1.0), clamp(1 - left / out_ms, 0.0, 1.0)
    part = lambda t, phase, p, o: F.struct(t.alias("type"), F.lit(phase).alias("phase"), p.alias("progress"), o.alias("opacity"))
    return F.when(entering, part(in_type, "in", p_in, p_in)).when(leaving, part(out_type, "out", p_out, 1 - p_out)).otherwise(
        part(F.lit("none"), "none", F.lit(1.0), F.lit(1.0)))


def _side(kind: Column, progress: Column, entering: bool) -> dict[str, Column]:
    """What one animation side contributes: factors for alpha and scales, offsets for the rest."""
    settled = progress if entering else 1 - progress
    eased = ease_out_cubic(settled) if entering else 1 - ease_in_cubic(1 - settled)
    slide = 1 - eased
    one, zero = F.lit(1.0), F.lit(0.0)
    fading = kind.isin("fade", "slide-up", "slide-down", "slide-left", "slide-right", "spin")
    quick = F.when(kind == "zoom", 2.5).when(kind == "bounce", 3.0).when(kind == "flip-3d", 2.0)
    return {
        "alpha": F.when(fading, eased).when(quick.isNotNull(), clamp(settled * quick, 0.0, 1.0)).otherwise(one),
        "dy": F.when(kind == "slide-up", slide * 0.12).when(kind == "slide-down", slide * -0.12).otherwise(zero),
        "dx": F.when(kind == "slide-left", slide * 0.14).when(kind == "slide-right", slide * -0.14).otherwise(zero),
        "scale": F.when(kind == "zoom", 0.25 + 0.75 * (ease_out_back(settled) if entering else eased))
        .when(kind == "bounce", F.greatest(F.lit(0.05), ease_out_bounce(settled) if entering else eased))
        .when(kind == "spin", 0.2 + 0.8 * eased).otherwise(one),
        "scale_x": F.when(kind == "flip-3d", F.greatest(F.lit(0.02), F.cos(slide * F.pi() / 2))).otherwise(one),
        "rotation": F.when(kind == "spin", slide * (-180.0 if entering else 180.0)).otherwise(zero),
        "reveal": F.when(kind == "typewriter", clamp(settled, 0.0, 1.0)).otherwise(one),
    }


def text_effect(local: Column, duration: Column, in_type: Column, in_ms: Column, out_type: Column, out_ms: Column) -> Column:
    """Struct of alpha, offsets, scales, rotation and reveal; null while no animation runs."""
    left = duration - local
    enter = (in_type != "none") & (in_ms > 0) & (local < in_ms)
    leave = (out_type != "none") & (out_ms > 0) & (left <= out_ms)
    a = _side(F.when(enter, in_type).otherwise("none"), clamp(local / in_ms, 0.0, 1.0), True)
    b = _side(F.when(leave, out_type).otherwise("none"), clamp(1 - left / out_ms, 0.0, 1.0), False)
    joined = {n: (a[n] * b[n] if n in ("alpha", "scale", "scale_x") else F.least(a[n], b[n]) if n == "reveal" else a[n] + b[n]) for n in NEUTRAL}
    joined["alpha"] = clamp(joined["alpha"], 0.0, 1.0)
    return F.when(enter | leave, F.struct(*[v.alias(n) for n, v in joined.items()]))


def frame_times(video_ms: str, offset_ms: str, length_ms: str, count: str) -> Column:
    """Even sample times of a source range, kept clear of the last frame."""
    guard = f"least(50.0D, greatest(1.0D, {video_ms} * 0.005D))"
    last = f"greatest(0.0D, {video_ms} - {guard})"
    start = f"least({last}, greatest(0.0D, {offset_ms}))"
    end = f"least({last}, greatest({start}, {start} + greatest(0.0D, {length_ms})))"
    n = f"greatest(1, CAST(floor({count}) AS INT))"
    even = f"transform(sequence(0, {n} - 1), i -> {start} + ({end} - {start}) * i / ({n} - 1))"
    return F.expr(f"IF({video_ms} <= 0, array(), IF({n} = 1 OR {end} <= {start}, array({start}), {even}))")
