"""Fixed values and table layouts of a manifest."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, StringType, StructType

# Fixed values.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
WALK_EXTENSIONS = (".png", ".bmp", ".jpg", ".jpeg", ".tif", ".tiff")
SYSTEM_FILES = ("Thumbs.db", "desktop.ini", ".DS_Store")
SPLITS = ("train", "val", "test")
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}
LIGHTS = ("natural", "indoor", "outdoor")
REASONS = ("hidden/system", "unsupported extension")
NOTE = "normalized from folder '{}'"
# Classes by index, genus and species.
CLASSES = (
    "Eucalyptus camaldulensis",
    "Eucalyptus cladocalyx",
    "Eucalyptus deglupta",
    "Eucalyptus diversicolor",
    "Eucalyptus grandis",
    "Eucalyptus microcorys",
    "Eucalyptus saligna",
    "Syzygium hemisphericum",
)
# Other spellings of a species, and other names.
MISSPELT = {"camandulensis": "camaldulensis", "daglupta": "deglupta"}
SYNONYMS = {"syzygiumchanlos": "Syzygium hemisphericum", "syzygiumhemisphericumsyzygiumchanlos": "Syzygium hemisphericum"}
# Columns of an annotation sheet, whose header is its second row.
ANNOTATION = {
    "Science name": "class_name_raw",
    "Sample ID": "sample_id",
    "Originin": "source_institution",
    "Humidity state": "humidity_state",
    "Collectors": "collectors",
    "Captured place": "captured_place",
    "Light conditions": "annotation_light_condition",
    "Images Refs": "image_refs",
    "Unnamed: 18": "qc_notes",
}
# Columns of a manifest and of a split, in order.
METADATA_COLUMNS = (
    "image_id",
    "relative_path",
    "raw_path",
    "original_filename",
    "top_level_folder",
    "class_name",
    "class_index",
    "width",
    "height",
    "file_extension",
    "sha256",
    "phash",
    "group_id",
    "specimen_key",
    "light_condition",
    "parsed_group_id",
    "legacy_parsed_group_id",
    "notes",
)
REQUIRED_METADATA = ("image_id", "relative_path", "class_name", "class_index")
SPLIT_COLUMNS = ("image_id", "relative_path", "class_name", "class_index", "split")
SPLIT_OPTIONAL = ("group_id", "specimen_key", "light_condition", "parsed_group_id", "phash_component", "constraint_component", "sha256", "phash")
PATH_KEYS = ("raw_path", "absolute_path", "image_path", "path", "source_path")
INTEGERS = ("class_index", "width", "height")


def strings(columns) -> StructType:
    """A schema of text columns, with the integer columns of a manifest as integers: keys are never inferred to be numbers."""
    out = StructType()
    for c in columns:
        out = out.add(c, IntegerType() if c in INTEGERS else StringType())
    return out


METADATA = strings(METADATA_COLUMNS)
SKIPPED = strings(("path", "reason", "kind"))
UNREADABLE = strings(("path", "relative_path", "class_name", "error"))
CLASS_NOTES = strings(("top_level_folder", "class_name", "note"))
