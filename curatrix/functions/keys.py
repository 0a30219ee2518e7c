"""Column expressions for paths, group keys and class names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import CLASSES, EXTENSIONS, MISSPELT, NOTE, REASONS, SPLIT_ALIASES, SYNONYMS, SYSTEM_FILES

# Patterns that define what a key is. A number at a name's front; what separates words; a copy number in
# brackets at a stem's end; dots at its end; four digits and the last number after them.
FRONT_NUMBER = r"(?U)^\s*\d+\s*[._-]*\s*"
BETWEEN_WORDS = "[^a-z0-9]+"
COPY_NUMBER = r"(?U)\s*\.?\s*\(\d+\)\s*$"
END_DOTS = r"[. ]+$"
SPECIMEN = r"(?U)(\d{4}).*?(\d+)(?:\D*)$"


@F.pandas_udf(StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    plain = lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return texts.map(plain)


def ascii_key(text: Column, unaccent: bool = True) -> Column:
    """Lower-case words of ASCII letters and digits: accents dropped, a leading number dropped, "&" read as "and".

    Only texts with other characters than ASCII's go to Python; without `unaccent` the expression stays in the JVM."""
    plain = F.coalesce(_unaccented(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    t = F.lower(plain if unaccent else text)
    t = F.regexp_replace(t, FRONT_NUMBER, "")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), BETWEEN_WORDS, " "))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def class_aliases() -> dict[str, str]:
    """Class names by compact key: genus or its initial, then any spelling of the species."""
    out = dict(SYNONYMS)
    for name in CLASSES:
        genus, species = name.lower().split()
        for spelling in (species, *(m for m, right in MISSPELT.items() if right == species)):
            out[genus + spelling] = out[genus[0] + spelling] = name
    return out


def normalise_class(folder: Column, unaccent: bool = True) -> Column:
    """struct(name, note) of a folder's class; name is null if there is none.

    A key that is no alias is searched for a species; its genus must fit, by name or by a single letter."""
    key = ascii_key(folder, unaccent)
    compact = F.replace(key, F.lit(" "), F.lit(""))
    alias = F.try_element_at(_literal_map(class_aliases()), compact)
    syzygium = key.contains("syzygium") | key.rlike(r"\bs\b")
    by_token = F.lit(None).cast("string")
    spellings = [(s, name) for name in CLASSES for s in (name.split()[1], *(m for m, right in MISSPELT.items() if right == name.split()[1]))]
    for spelling, name in reversed(spellings):
        fits = key.contains(spelling)
        if name.startswith("Eucalyptus"):
            fits = fits & ~syzygium
        by_token = F.when(fits, F.lit(name)).otherwise(by_token)
    told = F.replace(F.lit(NOTE), F.lit("{}"), folder)
    exact = F.replace(F.lower(alias), F.lit(" "), F.lit("")) == compact
    return F.struct(F.coalesce(alias, by_token).alias("name"), F.when(exact, "").when(alias.isNotNull() | by_token.isNotNull(), told).alias("note"))


def class_index(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(k))]), name)


def normalise_split(split: Column) -> Column:
    """train, val or test for the known spellings, else null."""
    return F.try_element_at(_literal_map(SPLIT_ALIASES), F.lower(F.trim(split.cast("string"))))


# ---------------------------------------------------------------- paths


def posix(path: Column) -> Column:
    """A path without doubled separators, "." parts and a closing separator."""
    p = F.regexp_replace(path, "/+", "/")
    p = F.regexp_replace(p, r"(^|(?<=/))\./", "")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"(?<=.)/\.?$", ""))


def parts(path: Column) -> Column:
    return F.split(posix(path), "/")


def path_key(path: Column) -> Column:
    """A path without any dots and separators at its front."""
    return F.regexp_replace(posix(path), r"^[./]+", "")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty for names that only begin or end with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def below_class(path: Column) -> Column:
    """A path without its first part; a path of one part as it is."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 2, 1 << 20), "/")).otherwise(F.element_at(p, 1))


def is_hidden(path: Column) -> Column:
    p = parts(path)
    return F.exists(p, lambda x: x.startswith(".") & ~x.isin(".", "..")) | F.element_at(p, -1).isin(*SYSTEM_FILES)


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS) & ~is_hidden(path)


def skip_reason(path: Column) -> Column:
    """Why a file is no image, or null."""
    return F.when(is_hidden(path), REASONS[0]).when(~extension(path).isin(*EXTENSIONS), REASONS[1])


# ---------------------------------------------------------------- groups


def group_stem(name: Column) -> Column:
    """A file stem without a copy number in brackets and closing dots; as it was if nothing else is there."""
    plain = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    short = F.regexp_replace(plain, COPY_NUMBER, "")
    short = F.trim(F.regexp_replace(short, END_DOTS, ""))
    return F.when(short != "", short).otherwise(plain)


def specimen_key(group: Column) -> Column:
    """"3284.11" for the first four digits and the last number after them, without its leading zeros; other texts as they are.

    Keys are text from end to end, so 3358.1 and 3358.10 stay apart."""
    number = F.regexp_replace(F.regexp_extract(group, SPECIMEN, 2), "^0+(?=[0-9])", "")
    return F.when(group.rlike(SPECIMEN), F.concat_ws(".", F.regexp_extract(group, SPECIMEN, 1), number)).otherwise(group)


def sample_id(value: Column) -> Column:
    return specimen_key(F.replace(F.trim(value), F.lit(","), F.lit(".")))


def parsed_group(path: Column, class_name: Column) -> Column:
    """class::folders below the class, or class::group stem for files right below it."""
    p = parts(path)
    inside = F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), "/")
    return F.concat(class_name, F.lit("::"), F.when(F.size(p) >= 3, inside).otherwise(group_stem(stem(path))))


def group_id(path: Column) -> Column:
    """The first folder below the class, or the group stem."""
    p = parts(path)
    return F.when(F.size(p) >= 3, F.element_at(p, 2)).otherwise(group_stem(stem(path)))


def light(path: Column, unaccent: bool = True) -> Column:
    key = ascii_key(posix(path), unaccent)
    return F.when(key.contains("indoor"), "indoor").when(key.contains("outdoor"), "outdoor").otherwise("natural")


def filename_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


# Old folder names that differ from the class name.
LEGACY_FOLDERS = {"Eucalyptus camaldulensis": "Eucalyptus_camandulensis", "Eucalyptus deglupta": "Eucalyptus_daglupta"}


def class_folder(name: Column, style: str) -> Column:
    """canonical: as it is; underscore: spaces as underscores; legacy: so too, with the old spellings of two classes."""
    if style == "canonical":
        return name
    under = F.replace(name, F.lit(" "), F.lit("_"))
    if style == "underscore":
        return under
    if style == "legacy":
        return F.coalesce(F.try_element_at(_literal_map(LEGACY_FOLDERS), name), under)
    raise ValueError(f"unknown folder style: {style}")


def latex(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))
