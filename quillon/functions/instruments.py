"""Program numbers and instrument names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The General MIDI instrument of each program number, from 0.
NAMES = """
acoustic_grand_piano bright_acoustic_piano electric_grand_piano honky_tonk_piano
electric_piano_1 electric_piano_2 harpsichord clavinet
celesta glockenspiel music_box vibraphone marimba xylophone tubular_bells dulcimer
drawbar_organ percussive_organ rock_organ church_organ reed_organ accordion harmonica tango_accordion
guitar_nylon guitar_steel guitar_jazz guitar_clean
guitar_muted overdriven_guitar distortion_guitar guitar_harmonics
acoustic_bass electric_bass_finger electric_bass_pick fretless_bass
slap_bass_1 slap_bass_2 synth_bass_1 synth_bass_2
violin viola cello contrabass tremolo_strings pizzicato_strings orchestral_harp timpani
string_ensemble_1 string_ensemble_2 synth_strings_1 synth_strings_2
choir_aahs voice_oohs synth_choir orchestra_hit
trumpet trombone tuba muted_trumpet french_horn brass_section synth_brass_1 synth_brass_2
soprano_sax alto_sax tenor_sax baritone_sax oboe english_horn bassoon clarinet
piccolo flute recorder pan_flute blown_bottle shakuhachi whistle ocarina
lead_square lead_sawtooth lead_calliope lead_chiff lead_charang lead_voice lead_fifths lead_bass_lead
pad_new_age pad_warm pad_polysynth pad_choir pad_bowed pad_metallic pad_halo pad_sweep
fx_rain fx_soundtrack fx_crystal fx_atmosphere fx_brightness fx_goblins fx_echoes fx_sci_fi
sitar banjo shamisen koto kalimba bagpipe fiddle shanai
tinkle_bell agogo steel_drums woodblock taiko_drum melodic_tom synth_drum reverse_cymbal
guitar_fret_noise breath_noise seashore bird_tweet telephone_ring helicopter applause gunshot
""".split()


def gm_name(program: Column) -> Column:
    """The name of a program; null outside 0 to 127."""
    return F.when(program.between(0, len(NAMES) - 1), F.element_at(F.array(*map(F.lit, NAMES)), (program + 1).cast("int")))


def resolve(slug: Column) -> Column:
    """(program, is_drum, name) of a slug, white space at the ends and case aside; ``drums``
    is program 0; null for a blank or unknown slug."""
    key = F.lower(F.regexp_replace(slug, r"^(?U)\s+|(?U)\s+$", ""))
    place = F.array_position(F.array(*map(F.lit, NAMES)), key)
    drums = F.struct(F.lit(0).alias("program"), F.lit(True).alias("is_drum"), F.lit("drums").alias("name"))
    found = F.struct((place - 1).cast("int").alias("program"), F.lit(False).alias("is_drum"), key.alias("name"))
    return F.when(key == "drums", drums).when(place > 0, found)
