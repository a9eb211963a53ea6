"""Effects by name, colour schemes and presets; kernels against the definitions that fix them."""

import json

import numpy as np
import pytest

from framewright.effects import EFFECTS, PRESETS, combination, effect, effect_or_default, preset
from framewright.effects.presets import COLUMN_CHOICES, GLASS, OIL, columns, glass, oil, presets
from framewright.operators import planes as K


def frame(width=32, height=20, seed=1):
    rng = np.random.default_rng(seed)
    half = lambda: rng.integers(0, 256, (-(-height // 2), -(-width // 2))).repeat(2, 0).repeat(2, 1)[:height, :width]
    return rng.integers(0, 256, (height, width)), half(), half()


def test_names_and_errors():
    assert len(EFFECTS) == 10 and PRESETS == 36
    for name, params in (("no_such", {}), ("convolve3x3", {"coefficients": [1, 2]}), ("permute_color", {"red": "RED", "green": "PINK", "blue": "RED"}), ("edge", {"type": "fixed", "minColor": [0, 0, 0]})):
        with pytest.raises(ValueError):
            effect(name, params)
        assert effect_or_default(name, params).name == "edge_luminance"
    with pytest.raises(KeyError):
        effect("permute_color", {"red": "RED"})


def test_old_and_new_names_of_colours():
    planes = frame()
    new = effect("edge", {"colors": {"type": "fixed", "minColor": [1, 2, 3], "maxColor": [9, 8, 7]}})
    old = effect("edge", {"type": "fixed", "minEdgeColor": [1, 2, 3], "maxEdgeColor": [9, 8, 7]})
    assert (new.kernel(planes, 0) == old.kernel(planes, 0)).all()
    with pytest.raises(ValueError):  # a grid gradient doesn't know the old name
        effect("edge", {"type": "grid_gradient", "minEdgeColor": [0, 0, 0], "grid": [[[0] * 12]]})
    plain = effect("edge", {"type": "unknown"}).kernel(planes, 0)
    assert (plain == np.stack([K.edge(planes[0])] * 3)).all()  # black to white


def test_metadata_makes_the_effect_again():
    planes = frame()
    for one in presets({"minCharWidth": 4}):
        told = one.metadata()
        again = effect(told["name"], told["params"])
        assert json.loads(told["params"]) == json.loads(again.metadata()["params"])
        assert (one.kernel(planes, 4321) == again.kernel(planes, 4321)).all()


def test_preferences():
    assert [columns({"numColumns": n}) for n in (80, 81)] == [80, 120] and 120 in COLUMN_CHOICES
    assert preset(24, {"pixelChars.BLACK_ON_WHITE": "ab"}).params["pixelChars"] == "ab"
    assert preset(29, {"matrixTextColor": 0x112233}).params["textColor"] == 0x112233
    own = preset(34, {"custom1": {"type": "SOLID", "topLeft": (9, 9, 9)}})
    assert own.name == "solid_color" and own.params["grid"][0][0][:6] == [9, 9, 9, 0, 0, 255]
    assert preset(34, {"custom1": "damaged"}).name == "edge" and preset(35).name == "solid_color"
    assert preset(10, in_grid=True).params["colors"]["pixelsPerCell"] == 20


def test_kernels_keep_their_properties():
    y, u, v = frame()
    flat = np.full_like(y, 77)
    assert not K.edge(flat).any()
    assert (K.convolve3x3(y, (0, 0, 0, 0, 1, 0, 0, 0, 0)) == y).all()
    once = K.permute((y, u, v), ("GREEN", "BLUE", "RED"), False)
    assert (once == K.rgb_trunc(y, u, v)[[1, 2, 0]]).all()
    assert all((a == b).all() for a, b in zip(K.resized((y, u, v), 32, 20), (y, u, v)))
    small = K.resized((flat, u, v), 7, 5)
    assert (small[0] == 77).all() and all(p.shape == (5, 7) for p in small)
    assert (effect("cartoon", {"blurRadius": 3}).kernel((flat, np.full_like(y, 128), np.full_like(y, 128)), 0) == 85).all()


def test_oil_and_glass_variants():
    planes = frame(48, 30)
    made = [oil(n).kernel(planes, 0) for n in OIL] + [glass(n).kernel(planes, 0) for n in GLASS]
    assert all(m.shape == (3, 30, 48) and 0 <= m.min() and m.max() <= 255 for m in made)
    wide = frame(1440, 4)
    assert effect("oil_painting", {"brushSize": 2}).kernel(wide, 0).shape == (3, 2, 720)  # made smaller first


def test_combination_places_tiles():
    low = [effect("solid_color", {"type": "fixed", "minColor": [k, k, k], "maxColor": [k, k, k]}) for k in range(1, 6)]
    planes = frame()
    tiles = lambda **how: combination(low, (4, 2), **how)(planes, 0)[0, ::2, ::4]
    assert tiles().tolist() == [[1, 2, 3], [4, 5, 0], [0, 0, 0]]
    assert tiles(x_flipped=True).tolist() == [[3, 2, 1], [0, 5, 4], [0, 0, 0]]
    assert tiles(portrait=True).tolist() == [[3, 0, 0], [2, 5, 0], [1, 4, 0]]


def test_pixels_of_effects_by_one_worker(spark):
    """As the pictures of apply_effects(), by one Python step and not two."""
    from framewright.effects import apply_effects, effect, effect_pixels

    frames = spark.createDataFrame([(f, 137 * f, 4, 3, bytearray(range(f, f + 12)), bytearray(b"abcd"), bytearray(b"efgh")) for f in range(3)], "frame_id long, ms long, width int, height int, yp binary, up binary, vp binary")
    kernels = {2: effect("edge_luminance").kernel, 5: effect("cartoon").kernel}
    found = effect_pixels(frames, kernels)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {tuple(r[:4]): tuple(r[4:]) for r in found.collect()}
    want = {(r["effect"], r["frame_id"], k % 4, k // 4): tuple(bytes(r["rgb"])[3 * k : 3 * k + 3]) for r in apply_effects(frames, kernels).collect() for k in range(12)}
    assert got == want and len(got) == 72
