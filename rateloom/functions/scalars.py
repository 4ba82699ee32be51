"""Scalar column functions of the note domain: names, tokens, grids, decibels. All stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note names of the twelve pitch classes, and the semitones of the letters.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
LETTER_SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up on the scaled double: the same on any engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)


def note_name(pitch: Column) -> Column:
    """Scientific name of a MIDI pitch; 60 is C4."""
    names = F.array(*map(F.lit, NOTE_NAMES))
    return F.concat(F.get(names, F.pmod(pitch, F.lit(12)).cast("int")), (F.floor(pitch / 12) - 1).cast("int").cast("string"))


def named_pitch(name: Column) -> Column:
    """Pitch of `C4`, `Bb2`, `f#3`; null where the text is no note or the pitch lies outside 0..127."""
    letter = F.upper(F.regexp_extract(name, r"^([A-Ga-g])([#b]?)(-?\d+)$", 1))
    accidental = F.regexp_extract(name, r"^([A-Ga-g])([#b]?)(-?\d+)$", 2)
    octave = F.regexp_extract(name, r"^([A-Ga-g])([#b]?)(-?\d+)$", 3)
    base = F.element_at(F.create_map(*(F.lit(x) for pair in LETTER_SEMITONES.items() for x in pair)), F.nullif(letter, F.lit("")))
    shift = F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)
    pitch = (F.nullif(octave, F.lit("")).try_cast("int") + 1) * 12 + base + shift
    return F.when(pitch.between(0, 127), pitch)


def pitch_label(pitch: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad(pitch.cast("string"), 3, "0"), F.lit("_"), note_name(pitch))


def labeled_pitch(label: Column) -> Column:
    return F.regexp_extract(label, r"^p(\d+)_", 1).cast("int")


def first_token(text: Column, kind: str) -> Column:
    """Number of the first `<kind><number>` among the tokens that underscores separate, or null."""
    found = F.regexp_extract(text, rf"(?:^|_){kind}(\d+)(?:_|\.|$)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def controller_buckets(averages: Column, quantum: float) -> Column:
    """A map of controller averages as a sorted array of (controller, bucket): an identity that can be grouped by."""
    pairs = F.transform(F.map_entries(averages), lambda e: F.struct(e["key"].alias("cc"), F.floor(e["value"] / quantum).cast("int").alias("bucket")))
    return F.array_sort(pairs)


def semitone_ratio(semitones: Column) -> Column:
    return F.pow(F.lit(2.0), semitones / 12)


def midi_to_freq(pitch: Column) -> Column:
    return F.lit(440.0) * semitone_ratio(pitch - 69)


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def gain_to_db(gain: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(gain, F.lit(1e-12)))


def seconds_to_frames(seconds: Column, rate: float) -> Column:
    return F.greatest(F.lit(0), F.bround(seconds * rate, 0)).cast("long")


def bucket_edge(duration: Column, ratio: float) -> Column:
    """Edge of the geometric grid, anchored at 1, at or above a duration; a ratio of 1 or less changes nothing."""
    if ratio <= 1:
        return duration
    step = F.ceil(F.ln(duration) / math.log(ratio) - 1e-9)
    return F.when(duration > 0, F.pow(F.lit(float(ratio)), step))


def grid_cost(bytes_: Column, budget: int, resolution: int | None) -> Column:
    """Steps of the byte grid that a size takes."""
    grain = 1 if not resolution else max(1, -(-budget // resolution))
    return F.ceil(bytes_ / grain).cast("long")


def kib_to_bytes(kib: Column) -> Column:
    return F.ceil(kib * 1024).cast("long")


def bytes_to_kib(bytes_: Column) -> Column:
    return bytes_ / F.lit(1024.0)


def resampled_frames(frames: Column, rate: int, target: int) -> Column:
    """Frames that a signal has at another rate, ties to the even count."""
    if rate <= 0 or target <= 0:
        raise ValueError(f"rates must be above zero, not {rate} and {target}")
    return F.bround(frames * target / F.lit(float(rate)), 0).cast("long")


def headroom_peak(headroom_db: Column) -> Column:
    """Full scale, lowered by the headroom."""
    return db_to_gain(-headroom_db)


def decay_level(mean_db: Column, slope_db: Column, mean_s: Column, moment_s: Column) -> Column:
    """Gain that a decay line reads at a moment."""
    return db_to_gain(mean_db + slope_db * (moment_s - mean_s))


def energy_weight(mean_energy: Column, exponent: float) -> Column:
    return F.pow(mean_energy, F.lit(float(exponent)))


def discarded_octaves(reach_hz: Column, edge_hz: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log2(reach_hz / edge_hz))


def event_rows(duration_s: Column, row_s: float, most: int) -> Column:
    return F.least(F.greatest(F.ceil(duration_s / row_s), F.lit(1)), F.lit(most)).cast("int")


def zone_label(zone: Column, pitch: Column) -> Column:
    return F.concat(F.lit("zone"), F.lpad(zone.cast("string"), 2, "0"), F.lit("_rep"), F.lpad(pitch.cast("string"), 3, "0"), F.lit("_"), note_name(pitch))
