"""Notes from recognized facts: a chain of joins per measure, in fixed order, and the order in which notes are written.

Facts (all with page and measure): notes (key, staff, logical_x, pitch, is_filled, accidental, dot_count), stems (key, staff, logical_x,
direction, attached_note_keys), beams (id, level, stem_keys), flags (stem_key, denominator), arcs (id, note_keys, stem_keys)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = ["page", "measure"]


def pitch(notes: DataFrame) -> DataFrame:
    """step, octave, alter from text like F#4; a sign of its own wins over the text, a bad text is an error."""
    pattern = "^([A-Ga-g])([#b])?(-?[0-9]+)$"
    part = lambda k: F.regexp_extract("pitch", pattern, k)
    own = F.when(F.col("accidental") == "sharp", 1).when(F.col("accidental") == "flat", -1).when(F.col("accidental") == "natural", 0).when(F.col("accidental") == "double-sharp", 2).when(F.col("accidental") == "double-flat", -2)
    checked = F.when(F.col("pitch").rlike(pattern), F.upper(part(1))).otherwise(F.raise_error(F.concat(F.lit("bad pitch: "), F.coalesce("pitch", F.lit("null")))).cast("string"))
    return notes.withColumns({"step": checked, "octave": part(3).try_cast("int"), "alter": F.coalesce(own, F.when(part(2) == "#", 1).when(part(2) == "b", -1).otherwise(0))})


def stem_of(notes: DataFrame, stems: DataFrame, reach: float = 1.5, margin: float = 0.25) -> DataFrame:
    """notes with stem and direction: the first stem that lists the note, else the nearest loose one of its staff within ``reach``, unless the next is as near within ``margin``."""
    listed = stems.select(*M, F.col("key").alias("stem"), F.explode("attached_note_keys").alias("key")).groupBy(*M, "key").agg(F.min("stem").alias("listed"))
    loose = stems.where("size(attached_note_keys) = 0").select(*M, "staff", F.col("key").alias("loose"), F.col("logical_x").alias("sx"))
    rest = notes.join(listed, [*M, "key"], "left_anti").join(loose, [*M, "staff"]).withColumn("d", F.abs(F.col("logical_x") - F.col("sx"))).where(F.col("d") <= reach)
    w = Window.partitionBy(*M, "key").orderBy("d", "loose")
    near = rest.withColumns({"n": F.row_number().over(w), "gap": F.lead("d").over(w) - F.col("d")}).where((F.col("n") == 1) & (F.coalesce("gap", F.lit(1e9)) >= margin)).select(*M, "key", "loose")
    keyed = notes.join(listed, [*M, "key"], "left").join(near, [*M, "key"], "left").withColumn("stem", F.coalesce("listed", "loose")).drop("listed", "loose")
    return keyed.join(stems.select(*M, F.col("key").alias("stem"), "direction"), [*M, "stem"], "left")


def chords(notes: DataFrame, reach: float = 2.0) -> DataFrame:
    """chord_key, is_chord, dots: per staff and fill, in x order, a free note opens a group with all free notes within ``reach`` of every member whose stem fits; two or more with one stem
    at most are a chord. The first is the root, dots are the most of any, the stem is shared."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields) + ", chord_key string, is_chord boolean, dots int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["logical_x", "key"], kind="stable", na_position="last").reset_index(drop=True)
        x, stem = g["logical_x"].tolist(), [s if isinstance(s, str) else None for s in g["stem"]]
        chord, member, dots = [None] * len(g), [False] * len(g), [int(d) if d == d and d is not None else 0 for d in g["dot_count"]]
        direction = g["direction"].tolist()
        free = [i for i in range(len(g)) if x[i] is not None and x[i] == x[i]]
        while free:
            group, held = [free[0]], stem[free[0]]
            for i in free[1:]:
                if all(abs(x[i] - x[j]) <= reach for j in group) and (held is None or stem[i] is None or stem[i] == held):
                    group.append(i)
                    held = held or stem[i]
            free = [i for i in free if i not in group]
            if len(group) > 1:
                with_stem = next((i for i in group if stem[i]), None)
                for k, i in enumerate(group):
                    chord[i], member[i], dots[i] = g["key"][group[0]], k > 0, max(dots[j] for j in group)
                    if with_stem is not None:
                        stem[i], direction[i] = stem[with_stem], direction[with_stem]
        return g.assign(stem=stem, direction=direction, chord_key=chord, is_chord=member, dots=dots)

    return notes.groupBy(*M, "staff", "is_filled").applyInPandas(run, schema)


def voice(notes: DataFrame, reach: float = 2.0) -> DataFrame:
    """2 for stems down where the staff has both directions and their x ranges overlap, else 1; null without a stem."""
    w = Window.partitionBy(*M, "staff")
    side = lambda d: F.when(F.col("direction") == d, F.col("logical_x"))
    up0, up1, down0, down1 = F.min(side("up")).over(w), F.max(side("up")).over(w), F.min(side("down")).over(w), F.max(side("down")).over(w)
    both = (up0 - reach <= down1) & (down0 - reach <= up1)
    return notes.withColumn("voice", F.when(F.col("direction").isNull(), None).when(F.coalesce(both, F.lit(False)) & (F.col("direction") == "down"), 2).otherwise(1).cast("int"))


def beam_marks(beams: DataFrame, notes: DataFrame) -> DataFrame:
    """page, measure, stem, beams: (level, position) by level. The position follows the rank of the stem's mean x in its beam."""
    x = notes.where("stem is not null").groupBy(*M, "stem").agg(F.avg("logical_x").alias("x"))
    each = beams.select(*M, F.col("id").alias("beam"), "level", F.explode("stem_keys").alias("stem")).join(x, [*M, "stem"], "left")
    n = F.row_number().over(Window.partitionBy(*M, "beam").orderBy(F.col("x").asc_nulls_last(), "stem"))
    of = F.count("*").over(Window.partitionBy(*M, "beam"))
    each = each.withColumn("position", F.when(n == 1, "begin").when(n == of, "end").otherwise("continue"))
    return each.groupBy(*M, "stem").agg(F.sort_array(F.collect_list(F.struct("level", "position"))).alias("beams"), F.max("level").alias("max_level"))


def duration(notes: DataFrame, marks: DataFrame, flags: DataFrame) -> DataFrame:
    """type and denominator: the most of the stem's flags, else 4 * 2^level of its beams, else quarter, half or whole by stem and fill."""
    f = flags.groupBy(*M, F.col("stem_key").alias("stem")).agg(F.max("denominator").alias("flag"))
    n = notes.join(marks, [*M, "stem"], "left").join(f, [*M, "stem"], "left")
    d = F.coalesce("flag", F.when(F.col("max_level") > 0, F.lit(4) * F.pow(F.lit(2), F.col("max_level")).cast("int")), F.when(F.col("is_filled"), 4).when(F.col("stem").isNotNull(), 2).otherwise(1))
    return n.withColumn("denominator", d).withColumn("type", note_type(F.col("denominator"))).drop("flag", "max_level")


def note_type(denominator: Column) -> Column:
    out = F.when(denominator == 1, "whole").when(denominator == 2, "half").when(denominator == 4, "quarter").when(denominator == 8, "eighth")
    for d, name in ((16, "16th"), (32, "32nd"), (64, "64th"), (128, "128th")):
        out = out.when(denominator == d, name)
    return out


def slurs(arcs: DataFrame, notes: DataFrame) -> DataFrame:
    """page, measure, number, start, stop: of an arc's notes and the notes on its stems the leftmost and the rightmost, of two at least with an x."""
    own = arcs.select(*M, "id", F.explode("note_keys").alias("key"))
    by_stem = arcs.select(*M, "id", F.explode("stem_keys").alias("stem")).join(notes.select(*M, "stem", "key"), [*M, "stem"]).select(*M, "id", "key")
    ends = own.unionByName(by_stem).distinct().join(notes.select(*M, "key", "logical_x").where("logical_x is not null"), [*M, "key"])
    s = ends.groupBy(*M, "id").agg(F.count("*").alias("n"), F.min_by("key", F.struct("logical_x", "key")).alias("start"), F.max_by("key", F.struct("logical_x", "key")).alias("stop")).where("n >= 2")
    return s.select(*M, F.row_number().over(Window.partitionBy(*M).orderBy("id")).alias("number"), "start", "stop")


def measures(*facts: DataFrame) -> DataFrame:
    """All measures that any fact names."""
    out = facts[0].select(*M)
    for f in facts[1:]:
        out = out.unionByName(f.select(*M))
    return out.distinct()


def facts_from_objects(heads: DataFrame, stem_heads: DataFrame, stems: DataFrame, accidentals: DataFrame, dots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adapter: recognized objects as keyed notes and stems; the first accidental counts, dots are counted."""
    a = accidentals.groupBy("page", F.col("head").alias("id")).agg(F.min_by("label", "id").alias("accidental"))
    d = dots.groupBy("page", F.col("target").alias("id")).agg(F.count("*").cast("int").alias("dot_count"))
    n = heads.join(a, ["page", "id"], "left").join(d, ["page", "id"], "left")
    notes = n.select(*M, F.concat(F.lit("note:"), "id").alias("key"), F.col("part").alias("staff"), F.col("lx").alias("logical_x"), F.concat("step", "octave").alias("pitch"), F.col("filled").alias("is_filled"), "accidental", F.coalesce("dot_count", F.lit(0)).alias("dot_count"))
    keys = stem_heads.groupBy(*M, F.col("stem").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("note:"), "head"))).alias("attached_note_keys"))
    s = stems.join(keys, [*M, "id"], "left")
    return notes, s.select(*M, F.concat(F.lit("stem:"), "id").alias("key"), F.col("part").alias("staff"), ((F.col("left") + F.col("right")) / 2).alias("logical_x"), "direction", F.coalesce("attached_note_keys", F.array().cast("array<string>")).alias("attached_note_keys"))


def build(notes: DataFrame, stems: DataFrame, beams: DataFrame, flags: DataFrame, arcs: DataFrame) -> DataFrame:
    """The rules in order: pitch, stem, chord, voice, beam, duration, slur; then the notes in their final order."""
    n = voice(chords(stem_of(pitch(notes), stems)))
    n = duration(n, beam_marks(beams, n), flags)
    s = slurs(arcs, n)
    marks = s.select(*M, F.col("start").alias("key"), F.struct("number", F.lit("start").alias("type")).alias("s")).unionByName(s.select(*M, F.col("stop").alias("key"), F.struct("number", F.lit("stop").alias("type")).alias("s")))
    n = n.join(marks.groupBy(*M, "key").agg(F.sort_array(F.collect_list("s")).alias("slurs")), [*M, "key"], "left")
    order = Window.partitionBy(*M).orderBy(F.col("logical_x").asc_nulls_last(), "staff", "octave", "step", "key")
    return n.withColumn("place", F.row_number().over(order))


def ticks(denominator: Column, dots: Column, whole: int = 128) -> Column:
    """Integer ticks; one dot 3/2, two or more 7/4."""
    base = F.floor(F.lit(whole) / denominator)
    return F.when(dots <= 0, base).when(dots == 1, F.floor(base * 3 / 2)).otherwise(F.floor(base * 7 / 4)).cast("int")


def written_order(score: DataFrame, divisions: int = 32) -> DataFrame:
    """Notes with the tick at which they start and their place in the written measure: voices one after the other, groups of a chord by least x,
    a backup of the voice's whole duration (backup, on its last row) between voices."""
    v = score.withColumns({"v": F.coalesce("voice", F.lit(1)), "group": F.coalesce("chord_key", "key"), "t": ticks(F.col("denominator"), F.col("dots"), divisions * 4)})
    g = v.groupBy(*M, "v", "group").agg(F.min("logical_x").alias("gx"), F.max("t").alias("gt"))
    run = Window.partitionBy(*M, "v").orderBy(F.col("gx").asc_nulls_last(), "group")
    g = g.withColumn("onset", F.coalesce(F.sum("gt").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("gt").over(Window.partitionBy(*M, "v"))
    g = g.withColumn("voice_ticks", total)
    rows = v.join(g, [*M, "v", "group"])
    order = Window.partitionBy(*M).orderBy("v", F.col("gx").asc_nulls_last(), "group", "is_chord", "place")
    last = F.row_number().over(Window.partitionBy(*M, "v").orderBy(F.col("gx").desc_nulls_first(), F.desc("group"), F.desc("is_chord"), F.desc("place"))) == 1
    return rows.withColumns({"written": F.row_number().over(order), "backup": F.when(last, F.col("voice_ticks"))}).drop("gx", "gt")
