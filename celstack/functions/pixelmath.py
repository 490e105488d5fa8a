"""Exact 8-bit channel arithmetic as SQL expression text over non-negative integers."""

from __future__ import annotations


def scale_u8(a: str, m: str) -> str:
    """Coverage product in 0..255 fixed point, rounded by adding 127."""
    return f"(({a}) * ({m}) + 127) div 255"


def clean_alpha(a: str, floor: int) -> str:
    """Remove a noise floor and stretch the rest to 0..255, adding half before truncating."""
    span = 255 - floor
    return f"((greatest({a}, {floor}) - {floor}) * 255 + {span // 2}) div {span}"


def ramp(v: str, low: int, high: int) -> str:
    """0 at or below ``low``, 255 at or above ``high``, half-even linear between."""
    return (
        f"case when {v} <= {low} then 0 when {v} >= {high} then 255"
        f" else cast(bround((({v}) - {low}) * 255 / {high - low}) as int) end"
    )


def luma_601(r: str, g: str, b: str) -> str:
    """16-bit fixed-point luma; the weights sum to 65536 (fixed values)."""
    return f"shiftright(({r}) * 19595 + ({g}) * 38470 + ({b}) * 7471 + 32768, 16)"


def multiply_u8(a: str, b: str) -> str:
    """Product of two 8-bit samples divided by 255 with the (t + (t >> 8)) >> 8 correction."""
    t = f"(({a}) * ({b}) + 128)"
    return f"shiftright(shiftright({t}, 8) + {t}, 8)"


def edge_ramp(x: str, y: str, w: str, h: str) -> str:
    """Coverage rising from the nearest edge; distances are doubled to stay integral."""
    d = f"least(2 * {x} + 1, 2 * ({w} - {x}) - 1, 2 * {y} + 1, 2 * ({h} - {y}) - 1)"
    return f"least(255, (255 * {d} + 2) div 4)"
