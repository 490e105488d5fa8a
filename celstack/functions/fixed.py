"""Fixed values that results depend on: registries, orders, limits. Stated as plain text, in natural order."""

from __future__ import annotations

# Ontology slots: (slot, parent, side, cardinality, applicability).
SLOTS = (
    ("character", None, None, "exactly_one", "required"),
    ("background", None, None, "zero_or_one", "optional"),
    ("face.base", "character", None, "exactly_one", "required"),
    ("eye.left", "face.base", "left", "exactly_one", "required"),
    ("eye.right", "face.base", "right", "exactly_one", "required"),
    ("brow.left", "face.base", "left", "zero_or_one", "conditional"),
    ("brow.right", "face.base", "right", "zero_or_one", "conditional"),
    ("mouth", "face.base", None, "exactly_one", "required"),
    ("hair.front", "character", None, "zero_or_many", "conditional"),
    ("hair.side", "character", None, "zero_or_many", "conditional"),
    ("hair.back", "character", None, "zero_or_many", "conditional"),
    ("neck", "character", None, "zero_or_one", "conditional"),
    ("torso", "character", None, "exactly_one", "required"),
    ("clothing", "torso", None, "zero_or_many", "conditional"),
    ("accessory.front", "character", None, "zero_or_many", "optional"),
    ("accessory.back", "character", None, "zero_or_many", "optional"),
)

# Draw order per slot; lower values sit further back.
DRAW_ORDER = {
    "background": 0, "accessory.back": 10, "hair.back": 20, "character": 30, "torso": 40, "clothing": 50, "neck": 60,
    "face.base": 70, "brow.right": 80, "brow.left": 81, "eye.right": 90, "eye.left": 91, "mouth": 100, "hair.side": 110,
    "hair.front": 120, "accessory.front": 130,
}

DISPLAY_NAMES = {
    "background": "Background", "character": "Character Base", "face.base": "Face Base", "eye.left": "Eye (character left)",
    "eye.right": "Eye (character right)", "brow.left": "Brow (character left)", "brow.right": "Brow (character right)",
    "mouth": "Mouth", "hair.front": "Hair Front", "hair.side": "Hair Side", "hair.back": "Hair Back", "neck": "Neck",
    "torso": "Torso", "clothing": "Clothing", "accessory.front": "Accessory Front", "accessory.back": "Accessory Back",
}

# Parameters: (id, capability, low, high, neutral, tracking); every parameter has the manual role.
PARAMETERS = (
    ("head.yaw", "candidate_mandatory", -15.0, 15.0, 0.0, True),
    ("head.pitch", "candidate_mandatory", -10.0, 10.0, 0.0, True),
    ("eye.left.open", "candidate_mandatory", 0.0, 1.0, 1.0, True),
    ("eye.right.open", "candidate_mandatory", 0.0, 1.0, 1.0, True),
    ("eye.gaze.x", "candidate_optional", -1.0, 1.0, 0.0, True),
    ("eye.gaze.y", "candidate_optional", -1.0, 1.0, 0.0, True),
    ("mouth.open", "candidate_mandatory", 0.0, 1.0, 0.0, True),
    ("mouth.form", "candidate_optional", -1.0, 1.0, 0.0, True),
    ("body.lean", "research_optional", -1.0, 1.0, 0.0, False),
    ("breath", "research_optional", 0.0, 1.0, 0.0, False),
)

HEAD_SLOTS = ("face.base", "hair.front", "hair.back", "eye.left", "eye.right", "brow.left", "brow.right", "mouth", "neck")
# Slots that each parameter may move.
PARAMETER_SLOTS = {
    "head.yaw": HEAD_SLOTS,
    "head.pitch": HEAD_SLOTS,
    "eye.left.open": ("eye.left",),
    "eye.right.open": ("eye.right",),
    "eye.gaze.x": ("eye.left", "eye.right"),
    "eye.gaze.y": ("eye.left", "eye.right"),
    "mouth.open": ("mouth",),
    "mouth.form": ("mouth",),
    "body.lean": ("torso", "character"),
    "breath": ("torso",),
}

# Reveal margin in pixels per slot; other slots use the default.
REVEAL_MARGINS = {"eye.left": 10, "eye.right": 10, "mouth": 12, "face.base": 16, "neck": 20, "torso": 24, "hair.back": 28, "character": 24}
DEFAULT_REVEAL_MARGIN = 24

# Mesh columns and rows per slot; other slots use the default.
GRID_DENSITY = {
    "eye.left": (4, 3), "eye.right": (4, 3), "brow.left": (4, 2), "brow.right": (4, 2), "mouth": (4, 3), "face.base": (6, 6),
    "neck": (3, 3), "torso": (6, 6), "hair.front": (5, 4), "hair.back": (5, 5), "hair.side": (4, 4), "character": (6, 8),
}
DEFAULT_DENSITY = (4, 4)

# Model parts, back to front in visible priority.
PART_PRIORITY = (
    "back hair", "tail", "wings", "neck", "topwear", "bottomwear", "legwear", "footwear", "face", "ears", "eyewhite", "irides",
    "eyebrow", "nose", "mouth", "eyelash", "front hair", "headwear", "neckwear", "handwear", "eyewear", "earwear", "objects",
)
EYE_PARTS = ("eyewhite", "irides", "eyelash")
# Parts whose union forms each slot.
SLOT_PARTS = {
    "character": PART_PRIORITY, "background": (), "face.base": ("face",), "eye.left": EYE_PARTS, "eye.right": EYE_PARTS,
    "brow.left": ("eyebrow",), "brow.right": ("eyebrow",), "mouth": ("mouth",), "hair.front": ("front hair",), "hair.side": (),
    "hair.back": ("back hair",), "neck": ("neck",), "torso": ("topwear", "bottomwear", "legwear"),
    "clothing": ("topwear", "bottomwear", "legwear", "footwear"),
    "accessory.front": ("headwear", "neckwear", "handwear", "eyewear", "earwear", "objects"), "accessory.back": ("tail", "wings"),
}

STAGE_ORDER = (
    "INGEST_SCAN_NORMALIZE", "VALIDATE", "DECOMPOSE", "PLAN_AND_BOUNDED_COMPLETE", "SYNTHESIZE_LAYERS", "MESH_AND_MINIMAL_RIG",
    "VERIFY_PROJECT", "COMPILE_PREVIEW", "EXPORT_PACKAGE", "EXPORT_PSD", "VERIFY_EXPORTS",
)

# Most specific artifact role first; strictest sensitivity first.
ROLE_PRIORITY = ("source", "layer_texture", "generated_mask", "visible_mask", "mesh_vertices", "mesh_indices", "mesh_delta",
                 "override_mask", "preview", "evidence")
SENSITIVITY_PRIORITY = ("user_content", "derived_user_content", "non_sensitive")
# (declared role, role it may also serve)
INTERCHANGEABLE_ROLES = (("source", "layer_texture"),)
MEDIA_EXTENSIONS = {"image/png": "png", "application/octet-stream": "bin", "application/json": "json"}

# Frame sequence: parameter order, tick ranges at scale 1000 and the fixed frames.
SEQUENCE_PARAMETERS = (("head.yaw", -15000, 15000), ("head.pitch", -10000, 10000), ("eye.left.open", 0, 1000),
                       ("eye.right.open", 0, 1000), ("mouth.open", 0, 1000))
MANDATORY_FRAMES = (
    ("neutral", (0, 0, 1000, 1000, 0)),
    ("yaw.min", (-15000, 0, 1000, 1000, 0)),
    ("yaw.max", (15000, 0, 1000, 1000, 0)),
    ("pitch.min", (0, -10000, 1000, 1000, 0)),
    ("pitch.max", (0, 10000, 1000, 1000, 0)),
    ("eye.left.closed", (0, 0, 0, 1000, 0)),
    ("eye.right.closed", (0, 0, 1000, 0, 0)),
    ("eyes.closed", (0, 0, 0, 0, 0)),
    ("mouth.max", (0, 0, 1000, 1000, 1000)),
    ("yaw.min-pitch.min", (-15000, -10000, 1000, 1000, 0)),
    ("yaw.max-eyes.closed", (15000, 0, 0, 0, 0)),
    ("yaw.min-pitch.max-mouth.max", (-15000, 10000, 1000, 1000, 1000)),
)

# Cut-out patches: (id, parameter, character side, percent box).
PATCHES = (
    ("head", None, "not-applicable", (20, 5, 80, 60)),
    ("eye.screen-left", "eye.right.open", "right", (27, 25, 47, 40)),
    ("eye.screen-right", "eye.left.open", "left", (53, 25, 73, 40)),
    ("mouth", "mouth.open", "not-applicable", (40, 42, 60, 56)),
)

# Required member names of an acceptance bundle besides the per-frame images.
BUNDLE_REPORTS = ("candidate-report.json", "comparator-report.json", "paired-outcomes.json", "paired-statistics.json",
                  "structural-preflight.psd", "psd-readback.json")
FRAME_COUNT = 37

# Parts that do not move with the head.
STATIC_PARTS = ("tail", "wings", "neck", "neckwear", "topwear", "handwear", "bottomwear", "legwear", "footwear", "objects")
FEATURE_PARTS = ("eye", "eyebrow", "nose", "mouth")

# Motion bindings of a part draft: (binding, parameter, motion group, side or None for every side).
PART_BINDINGS = (
    ("binding.head-yaw", "head.yaw", None, None),
    ("binding.head-pitch", "head.pitch", None, None),
    ("binding.eye-left-open", "eye.left.open", "eye", "left"),
    ("binding.eye-right-open", "eye.right.open", "eye", "right"),
    ("binding.mouth-open", "mouth.open", "mouth", None),
)

# Layout ratios of a half-body figure, in this order: each measure may use the subject box (x, y, width, height) and those before it.
LAYOUT_MEASURES = (
    ("head_h", "height * 0.42D"), ("head_w", "width * 0.58D"), ("head_x", "x + (width - head_w) / 2.0D"), ("head_y", "cast(y as double)"),
    ("face_y", "head_y + head_h * 0.22D"), ("face_h", "head_h * 0.62D"), ("face_x", "head_x + head_w * 0.16D"), ("face_w", "head_w * 0.68D"),
    ("eye_y", "face_y + face_h * 0.30D"), ("eye_h", "face_h * 0.20D"), ("eye_w", "face_w * 0.30D"), ("brow_y", "eye_y - face_h * 0.16D"),
    ("brow_h", "face_h * 0.12D"), ("mouth_y", "face_y + face_h * 0.70D"), ("mouth_h", "face_h * 0.18D"), ("mouth_w", "face_w * 0.34D"),
    ("neck_y", "head_y + head_h * 0.92D"), ("torso_y", "y + height * 0.46D"), ("mid", "face_x + face_w / 2.0D"),
)

# Slot boxes of that layout: (slot, character side, x, y, width, height).
LAYOUT_BOXES = (
    ("character", "none", "x", "y", "width", "height"),
    ("hair.back", "none", "head_x - head_w * 0.12D", "head_y", "head_w * 1.24D", "head_h * 1.15D"),
    ("torso", "none", "x", "torso_y", "width", "y + height - torso_y"),
    ("neck", "none", "mid - face_w * 0.30D", "neck_y", "face_w * 0.60D", "head_h * 0.18D"),
    ("face.base", "center", "face_x", "face_y", "face_w", "face_h"),
    ("brow.right", "right", "face_x + face_w * 0.10D", "brow_y", "eye_w", "brow_h"),
    ("brow.left", "left", "mid + face_w * 0.10D", "brow_y", "eye_w", "brow_h"),
    ("eye.right", "right", "face_x + face_w * 0.10D", "eye_y", "eye_w", "eye_h"),
    ("eye.left", "left", "mid + face_w * 0.10D", "eye_y", "eye_w", "eye_h"),
    ("mouth", "center", "mid - mouth_w / 2.0D", "mouth_y", "mouth_w", "mouth_h"),
    ("hair.front", "none", "head_x", "head_y", "head_w", "head_h * 0.34D"),
)

# Displacement per parameter as (dx, dy) in terms of the vertex (x, y), its layer box (bx, by, w, h) and centre (cx, cy).
DISPLACEMENTS = {
    "head.yaw": ("n * w * 0.06D * (1.0D - least(1.0D, abs(y - cy) / (h / 2.0D)) * 0.35D)", "0.0D"),
    "head.pitch": ("0.0D", "-n * h * 0.05D * (1.0D - least(1.0D, abs(x - cx) / (w / 2.0D)) * 0.25D)"),
    "eye.left.open": ("0.0D", "(cy - y) * pull"),
    "eye.right.open": ("0.0D", "(cy - y) * pull"),
    "mouth.open": ("0.0D", "(cy - y) * pull"),
    "eye.gaze.x": ("n * w * 0.10D", "0.0D"),
    "eye.gaze.y": ("0.0D", "-n * h * 0.10D"),
    "mouth.form": ("(x - cx) / (w / 2.0D) * n * w * 0.06D", "0.0D"),
    "body.lean": ("n * w * 0.05D * greatest(0.0D, 1.0D - (y - by) / h)", "0.0D"),
    "breath": ("0.0D", "-n * h * 0.012D * greatest(0.0D, 1.0D - (y - by) / h)"),
}
