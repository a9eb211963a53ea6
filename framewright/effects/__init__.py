"""Effects by name and parameters, their presets, and the kernels that run them on frames in plane form."""

from .presets import PRESETS, preset
from .registry import EFFECTS, Effect, apply_effects, combination, effect, effect_or_default, effect_pixels

__all__ = ["EFFECTS", "PRESETS", "Effect", "apply_effects", "combination", "effect", "effect_or_default", "effect_pixels", "preset"]
