"""Quantities recorded in different units, brought to common units.

A *source* is a way of writing a quantity (here: a unit word at a place, such
as ``heading:lakh``).  Every source is tied to others by entities recorded in
both.  For each pair the robust scale (median log ratio) and offset are
estimated, the scale is snapped to a known conversion, and scales are
propagated through the graph of sources from an anchor source whose unit is
the common one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, with_small

#: Factors between the units in use and the common unit.
CONVERSIONS = (0.01, 1.0, 1e2, 1e3, 1e5, 1e6, 1e7, 1e9, 1e12)

#: Unit word -> factor, for words too rare to be estimated.
READINGS = (
    ("hundredth", r"^(p|¢|pence|penny|cents?)$", 0.01),
    ("thousand", r"^(k|thousands?|'?000s?|tsd|tausend)$", 1e3),
    ("lakh", r"^(lakhs?|lacs?)$", 1e5),
    ("million", r"^(m|mm|mn|mio|millions?)$", 1e6),
    ("crore", r"^(cr|crores?)$", 1e7),
    ("billion", r"^(b|bn|mrd|billions?|milliards?)$", 1e9),
    ("trillion", r"^(tn|trillions?)$", 1e12),
)

_WORDS = r"(?:crores?|lakhs?|lacs?|trillions?|billions?|milliards?|millions?|thousands?|tausend|pence|penny|cents?|mio|mrd|bn|mn|mm|tn|cr)"
_STATED = r"(?i)(?<![a-z0-9])(" + _WORDS + r")(?![a-z])|(?<=[£€$₹¥])(m|k|b)(?![a-z])|(?<![0-9.,])(000s?)(?![0-9])|(¢)"
_INLINE = r"(?i)(?<![a-z])(" + _WORDS + r"|p|k|m|b)(?![a-z])|(¢)"


def unit_word(text: Column, inline: bool = False) -> Column:
    """First unit word stated in a text, in lower case; null when there is none.

    ``inline`` reads the rest of a number cell, where single letters count.
    """
    word = F.lower(F.regexp_extract(text, _INLINE if inline else _STATED, 0))
    return F.when(word != "", word)


def read_number(raw: Column, max_decimals: int = 2) -> Column:
    """Signed number written with any thousands and decimal marks; null when unreadable.

    The last mark is decimal only when at most ``max_decimals`` digits follow
    it and it occurs once; otherwise every mark groups digits.
    """
    flat = F.regexp_replace(raw, r"[\s   ]+", " ")
    core = F.regexp_extract(flat, r"[0-9](?:[0-9.,'’ ]*[0-9])?", 0)
    core = F.regexp_replace(core, r"['’ ]", "")
    decimals = r"^([0-9.,]*[0-9])[.,]([0-9]{1," + str(max_decimals) + r"})$"
    whole = F.regexp_replace(F.when(core.rlike(decimals), F.regexp_extract(core, decimals, 1)).otherwise(core), r"[.,]", "")
    part = F.regexp_extract(core, decimals, 2)
    value = F.when(whole != "", F.concat(whole, F.lit("."), F.when(part != "", part).otherwise("0"))).try_cast("double")
    negative = flat.rlike(r"\(\s*[^()]*[0-9][^()]*\)|[-−–]\s*[£€$₹]?\s*[0-9]")
    return F.when(negative, -value).otherwise(value)


def known_scale(word: Column) -> Column:
    """Factor that a unit word is known to mean; null for an unknown word."""
    out = F.lit(None).cast("double")
    for _, pattern, factor in reversed(READINGS):
        out = F.when(word.rlike(pattern), F.lit(factor)).otherwise(out)
    return out


def snap(scale: Column, conversions: tuple[float, ...] = CONVERSIONS, within: float = 0.05) -> Column:
    """The known conversion within a relative distance of ``scale``, else null."""
    out = F.lit(None).cast("double")
    for c in conversions:
        out = F.when(F.abs(F.log10(scale) - F.lit(math.log10(c))) <= math.log10(1 + within), F.lit(float(c))).otherwise(out)
    return out


def pairwise_scales(links: DataFrame, min_links: int = 5, min_agreement: float = 0.5) -> DataFrame:
    """Robust scale and offset of source pairs.

    ``links`` has one row per entity recorded in two sources: ``a, b, va, vb``.
    Returns ``a, b, scale, offset, links, agreement``: the snapped median of
    vb/va, the median of vb - scale*va (0 when it is under 1 % of the median
    of vb, as rounding leaves it), and the share of links within 1 % of the
    scale.  Pairs with few links or little agreement are left out.  The
    log ratios are counted in bins of 1/200 decade first, so that a pair with
    a third of all links stays small.
    """
    usable = links.where((F.col("va") * F.col("vb")) > 0)
    ratio = F.log10(F.col("vb") / F.col("va"))
    bins = usable.groupBy("a", "b", F.round(ratio * 200).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("mid")
    )
    mode = bins.groupBy("a", "b").agg(
        F.sum("n").cast("bigint").alias("links"),
        F.expr("percentile(mid, 0.5, n)").alias("median"),
        F.max_by("mid", F.struct("n", -F.abs("mid"))).alias("mode"),
        F.sort_array(F.collect_list(F.struct("mid", "n"))).alias("bins"),
    )
    scale = F.coalesce(snap(F.pow(F.lit(10.0), "median")), snap(F.pow(F.lit(10.0), "mode")))
    close = F.expr("aggregate(bins, 0L, (s, x) -> s + if(abs(x.mid - log10(scale)) <= 0.005, x.n, 0L))")
    out = mode.withColumn("scale", scale).where("scale IS NOT NULL")
    out = out.withColumn("agreement", close / F.col("links")).where((F.col("links") >= min_links) & (F.col("agreement") >= min_agreement))
    offset = (
        usable.join(F.broadcast(out.select("a", "b", "scale")), ["a", "b"])
        .groupBy("a", "b")
        .agg(F.percentile_approx(F.col("vb") - F.col("scale") * F.col("va"), 0.5).alias("shift"), F.percentile_approx(F.abs("vb"), 0.5).alias("level"))
        .select("a", "b", F.when(F.abs("shift") > 0.01 * F.col("level"), F.col("shift")).otherwise(0.0).alias("offset"))
    )
    return out.join(offset, ["a", "b"]).select("a", "b", "scale", "offset", "links", "agreement")


def propagate(edges: DataFrame, anchor: str, conversions: tuple[float, ...] = CONVERSIONS, max_sources: int = 100_000) -> dict[str, tuple[float, float]]:
    """Scale and offset, into the anchor's unit, of every source that the graph ties to the anchor.

    Sources are spellings of units; their number doesn't grow with the rows,
    and the bound is checked.  The strongest edges are followed first.
    """
    rows = edges.select("a", "b", "scale", "offset", "links", "agreement").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} pairs of sources")
    known = {anchor: (1.0, 0.0)}
    todo = sorted(rows, key=lambda r: (-r.links * r.agreement, r.a, r.b))
    moved = True
    while moved:
        moved = False
        for r in todo:
            # b = scale * a + offset
            for here, there, factor, shift in ((r.a, r.b, r.scale, r.offset), (r.b, r.a, 1 / r.scale, -r.offset / r.scale)):
                if there in known and here not in known:
                    scale, offset = known[there]
                    known[here] = (min(conversions, key=lambda c: abs(math.log10(c) - math.log10(scale * factor))), scale * shift + offset)
                    moved = True
            if moved:
                break
    return known


def common_units(candidates: DataFrame, notes: DataFrame, min_links: int = 5) -> DataFrame:
    """Every candidate row with its value in the common unit.

    Adds ``number``, ``unit_place``, ``unit`` and ``common_value`` to
    ``candidate_id`` and ``normalized_value``.  The unit is the nearest one
    stated: in the number cell, in the label before it, in the page heading
    (not for per-share figures; not for share counts when it excepts shares),
    in the report's note (money only), else as written.  Its scale is the one
    estimated from the rows that carry a stored value, by way of the source
    graph; units too rare for an estimate take their known reading.  Rows
    whose number can't be read keep a null value; null texts state no unit; a
    report without a note has none, and of several notes the first unit word
    in the alphabet counts.  An offset is applied where it is more than one
    per cent of the source's median value.
    """
    raw = F.col("raw_number")
    per_share = F.lower("kpi").like("eps%")
    shares = F.lower("kpi").like("shares%")
    rest = F.regexp_replace(raw, r"[0-9][0-9.,'’\s   ]*", "#")
    at = F.instr(F.col("snippet"), raw)
    label = F.when(at > 0, F.expr("substring(snippet, 1, instr(snippet, raw_number) - 1)"))
    heading = F.when(per_share | (shares & F.lower("page_heading").rlike(r"(except|excluding|other than)( for)?( the)?( number of)? shares?\b")), None).otherwise(F.col("page_heading"))
    money_note = notes.where(F.col("report_name").isNotNull()).select("report_name", unit_word(F.col("units_note")).alias("note_unit"))
    money_note = durable(money_note.where("note_unit IS NOT NULL").groupBy("report_name").agg(F.min("note_unit").alias("note_unit")))
    named = lambda place, word: F.concat(F.lit(place), word)
    own = F.coalesce(named("inline:", unit_word(rest, inline=True)), named("label:", unit_word(label)), named("heading:", unit_word(heading)))
    read = candidates.select("candidate_id", "normalized_value", F.when(per_share | shares, None).otherwise(F.col("report_name")).alias("report_name"), read_number(raw).alias("number"), own.alias("source"))
    read = durable(read)
    # only rows that state no unit themselves look for a note
    looks = F.col("source").isNull() & F.col("report_name").isNotNull()
    columns = ["candidate_id", "normalized_value", "number"]
    noted = with_small(read.where(looks), money_note, "report_name", ["candidate_id"]).select(*columns, F.coalesce(named("note:", F.col("note_unit")), F.lit("written:")).alias("source"))
    read = read.where(~looks).select(*columns, F.coalesce("source", F.lit("written:")).alias("source")).unionByName(noted)
    links = read.where("number IS NOT NULL AND normalized_value IS NOT NULL").select(
        F.col("source").alias("a"), F.lit("stored").alias("b"), F.col("number").alias("va"), F.col("normalized_value").alias("vb")
    )
    scales = propagate(pairwise_scales(links, min_links), "stored")
    place, unit = F.split_part("source", F.lit(":"), F.lit(1)), F.split_part("source", F.lit(":"), F.lit(2))
    estimated, shift = F.lit(None).cast("double"), F.lit(0.0)
    found = {k: v for k, v in scales.items() if k != "stored"}
    if found:
        looked_up = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(found.items()) for x in (k, v[i])]), F.col("source"))
        estimated, shift = looked_up(0), F.coalesce(looked_up(1), shift) if any(v[1] for v in found.values()) else shift
    scale = F.coalesce(estimated, known_scale(unit), F.lit(1.0))
    return read.select(
        "candidate_id", "normalized_value", "number", place.alias("unit_place"), F.nullif(unit, F.lit("")).alias("unit"), (F.col("number") * scale + shift).alias("common_value")
    )


def misscaled(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Ids of rows whose stored value is null or off the common value by more than the tolerance."""
    v, s = F.col("common_value"), F.col("normalized_value")
    off = s.isNull() | F.isnan(s) | (F.abs(s - v) > tolerance * F.abs(v))
    return values.where(v.isNotNull() & off & F.col("candidate_id").isNotNull()).select("candidate_id").distinct()
