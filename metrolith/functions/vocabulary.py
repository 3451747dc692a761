"""The token vocabulary: fixed values, as the data format has them."""

from __future__ import annotations

#: Fixed values.
PAD, SOS, EOS, FRAME_START, FRAME_END = 0, 1, 2, 3, 4
TS_BASE, TS_COUNT = 5, 3000
LANE_BASE, LANE_COUNT = 3005, 8
TOUCH_BASE, TOUCH_COUNT = 3013, 33
NOTE_TAP, NOTE_TOUCH, NOTE_HOLD, NOTE_SLIDE = 3046, 3047, 3048, 3049
SEGMENT_START, SEGMENT_END = 3050, 3051
SHAPE_BASE, SHAPE_COUNT = 3052, 11
IS_BREAK, IS_EX, IS_FIREWORK, IS_CW, IS_CCW, IS_FORCE_STAR, IS_FAKE_ROTATE, IS_SLIDE_BREAK, IS_NO_HEAD = range(3063, 3072)
VOCABULARY = 3072

#: Touch areas in the order of their tokens: four rings of eight and the centre.
AREAS = [f"A{i}" for i in range(1, 9)] + [f"B{i}" for i in range(1, 9)] + ["C"] + [f"D{i}" for i in range(1, 9)] + [f"E{i}" for i in range(1, 9)]
#: Slide shapes in the order of their tokens, each with the way it is written.
SHAPES = ["Line", "Circle", "V", "GrandV", "P", "Q", "PP", "QQ", "S", "Z", "Wifi"]
SHAPE_OF = {"-": "Line", ">": "Circle", "<": "Circle", "^": "Circle", "v": "V", "V": "GrandV", "p": "P", "q": "Q", "pp": "PP", "qq": "QQ", "s": "S", "z": "Z", "w": "Wifi"}
#: Lanes from start to end that each shape may span, modulo eight; the others span any.
SPANS = {"Line": (2, 3, 4, 5, 6), "S": (4,), "Z": (4,), "Wifi": (4,), "V": (1, 2, 3, 4, 5, 6, 7), "GrandV": (1, 2, 3, 4, 5, 6, 7)}

#: Centiseconds in which a lane or area rests after a hold, and between two presses.
RELEASE_CS, PRESS_GAP_CS = 5, 3
MAX_NOTES, MAX_PRESSES = 33, 2

#: Default windows: frames of features a second and in a window; seconds of the prefix's start, the target's start and end.
FEATURE_HZ, FEATURE_FRAMES = 75, 2612
PREFIX_START, TARGET_START, TARGET_END = 6.0, 12.0, 22.0
TRAIN_STRIDE, INFER_STRIDE = 1.0, 10.0
