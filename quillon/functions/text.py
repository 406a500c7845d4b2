"""Scalar functions of texts, labels, prompts and byte tokens; all are JVM expressions."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it and the four separators that Python adds.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def slug(text: Column, fallback: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), fallback)


def instrument_label(name: Column, is_drum: Column, gm_name: Column, program: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.when(is_drum, F.lit("drums")), gm_name, F.concat(F.lit("program_"), program.cast("string")))


def prompt_metadata(markers: Column, has_lyrics: Column, numbers: Column, has_pedals: Column, has_bends: Column) -> Column:
    """At most three markers, lyrics, six control numbers (and a plus), pedals, bends."""
    shown = F.array_join(F.transform(F.slice(numbers, 1, 6), lambda n: F.concat(F.lit("cc"), n.cast("string"))), ", ")
    controls = F.when(F.size(numbers) > 0, F.concat(F.lit("controls: "), shown, F.when(F.size(numbers) > 6, F.lit(" +")).otherwise(F.lit(""))))
    parts = F.array(
        F.when(F.size(markers) > 0, F.concat(F.lit("markers: "), F.array_join(F.slice(markers, 1, 3), ", "))),
        F.when(has_lyrics, F.lit("lyrics: present")),
        controls,
        F.when(has_pedals, F.lit("pedals: present")),
        F.when(has_bends, F.lit("pitch bends: present")),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | ")


def augment(caption: Column, metadata: Column) -> Column:
    """Caption and metadata joined; either may be empty."""
    return F.concat_ws(" | ", F.nullif(caption, F.lit("")), F.nullif(metadata, F.lit("")))


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes as integers; an empty text gives an empty array."""
    b = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # one character for each byte
    return F.when(F.octet_length(text) > 0, F.transform(F.split(b, ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def truncate(ids: Column, most: int | None) -> Column:
    return ids if most is None else F.slice(ids, 1, most)


#: The characters of one byte each that together are one whole UTF-8 character.
_WHOLE = (
    r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def byte_text(ids: Column) -> Column:
    """Integers to text: cut to 0..255, read as UTF-8, bytes that are part of no whole
    character left out; null gives null."""
    one = F.array_join(F.transform(ids, lambda x: F.char(F.greatest(F.lit(0), F.least(F.lit(255), x)))), "")
    whole = F.regexp_replace(one, f"(?s)({_WHOLE})|.", "$1")
    return F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")


def strip(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def add_track_prompt(instrument: Column, extra: Column) -> Column:
    """The prompt that asks for a track; a blank ``extra`` adds nothing."""
    return F.concat_ws(" | ", F.concat(F.lit("add track: "), strip(instrument)), F.nullif(strip(extra), F.lit("")))


def encoder(path: str | None):
    """A function from text to ids by a vocabulary file of the tokenizers library (Arrow
    batches); without a file or the library byte tokens, with a warning.  The file must be
    readable on every executor.  Null gives null."""
    try:
        import tokenizers
    except ImportError:
        tokenizers = None
    if path is None or tokenizers is None:
        warnings.warn("no sub-word vocabulary: text is encoded as bytes", stacklevel=2)
        return byte_tokens
    loaded = []

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return text.map(lambda t: None if t is None else loaded[0].encode(t, add_special_tokens=False).ids)

    return ids
