"""Entity-attribute-value rows as one typed row per entity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Spellings of a missing value.
MISSING = ("", "none", "null", "nan", "na", "n/a", "error", "-", "--", "—", "–")

#: Spellings of yes and no.
YES, NO = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")

DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy/MM/dd", "dd.MM.yyyy")


def attribute_name(column: Column) -> Column:
    """Attribute in lower snake_case; null when nothing is left."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"[^\p{L}\p{N}]+", "_")
    name = F.regexp_replace(name, r"^_+|_+$", "")
    return F.when(name != "", name)


#: Shapes of values by type; the first type whose shape nearly all values of an attribute have is its type.
SHAPES = (
    ("boolean", r"(?i)^(true|false|t|f|yes|no|y|n)$"),
    ("date", r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[/.]\d{2}[/.]\d{4}|\d{1,2} [A-Za-z]{3} \d{4}|[A-Za-z]{3} \d{1,2}, \d{4}|(19|20)\d{6})$"),
    ("bigint", r"^[-+(]?\d{1,3}([ ,]?\d{3})*(\.0+)?\)?$"),
    ("double", r"^[-−+(]?[$€£₹]?\s*\d[\d ,']*(\.\d+)?([eE][-+]?\d+)?\)?$|^\.\d+$"),
)


def infer_types(rows: DataFrame, attribute: Column, value: Column, agreement: float = 0.95) -> dict[str, str]:
    """Type of every attribute from the shapes of all its values; string when no shape fits."""
    bare = F.trim(value.cast("string"))
    present = ~F.lower(bare).isin(*MISSING)
    shaped = rows.select(attribute_name(attribute).alias("a"), F.when(present, bare).alias("v")).where("a IS NOT NULL AND v IS NOT NULL")
    counted = shaped.groupBy("a").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v").rlike(p)).alias(k) for k, p in SHAPES])
    return {r.a: next((k for k, _ in SHAPES if r[k] >= agreement * r.n), "string") for r in counted.collect()}


_BLANKS = " \t\n\r\u00a0"


def read_number(text: Column) -> Column:
    """Number of a text without group marks and currency signs, brackets and minus negative; null when missing or unreadable."""
    bare = F.btrim(text, F.lit(_BLANKS))
    body = F.translate(text, "−()$€£₹,'" + _BLANKS, "-")  # only the first has a counterpart, the others go
    number = F.when(~F.lower(bare).isin(*MISSING), body).try_cast("double")
    number = F.when(F.startswith(bare, F.lit("(")) & F.endswith(bare, F.lit(")")), -number).otherwise(number)
    return F.when(~F.isnan(number), number + F.lit(0.0))


def read_as(kind: str, text: Column) -> Column:
    """The value of a text read as a type, in one canonical spelling; null when missing or unreadable."""
    if kind == "double":
        return read_number(text).cast("string")
    if kind == "bigint":
        return F.round(read_number(text)).try_cast("bigint").cast("string")
    bare = F.btrim(text, F.lit(_BLANKS))
    present = F.when(~F.lower(bare).isin(*MISSING), bare)
    if kind == "boolean":
        word = F.lower(present)
        return F.when(word.isin(*YES), "true").when(word.isin(*NO), "false")
    if kind == "date":
        return F.coalesce(*[F.try_to_timestamp(present, F.lit(f)).cast("date") for f in DATE_FORMATS]).cast("string")
    return F.upper(present)


def attribute_spellings(rows: DataFrame, attribute: Column, most: int = 50_000) -> DataFrame | None:
    """``__s, __a``: every spelling of an attribute with its name, or null beyond ``most`` spellings."""
    spelled = durable(rows.select(attribute.alias("__s")).distinct().where("__s IS NOT NULL"))
    return spelled.select("__s", attribute_name(F.col("__s")).alias("__a")) if spelled.count() <= most else None


def cells(rows: DataFrame, entity: Mapping[str, Column], attribute: Column, value: Column, types: Mapping[str, str], recency: Sequence[Column] = (), spellings: DataFrame | None = None) -> DataFrame:
    """One row per entity and attribute: the chosen value and whether rows contradict it.

    The latest readable value wins, ties go to the larger value.  Everything
    is a partial aggregate, so that an entity or attribute with a third of all
    rows is combined before the shuffle.  Rows without a full entity key or
    without attribute are left out.  With ``spellings``, which are few, an
    attribute's name is looked up instead of worked out for each row.
    """
    whole = sorted(a for a, kind in types.items() if kind == "bigint")
    numeric = sorted(a for a, kind in types.items() if kind == "double") + whole
    among = lambda names: F.col("__a").isin(*names) if names else F.lit(False)
    flags = {"__number": among(numeric), "__whole": among(whole)}
    base = rows.select(*[c.alias(k) for k, c in entity.items()], attribute.alias("__s"), value.cast("string").alias("__v"), F.struct(*recency, F.lit(0)).alias("__r"))
    base = base.where(F.col("__s").isNotNull())
    if spellings is not None:
        base = base.join(F.broadcast(spellings.where("__a IS NOT NULL").withColumns(flags)), "__s")
    else:
        base = base.withColumn("__a", attribute_name(F.col("__s"))).where("__a IS NOT NULL").withColumns(flags)
    for k in entity:
        base = base.where(F.col(k).isNotNull())
    kinds: dict[str, list[str]] = {}
    for a, kind in types.items():
        if kind not in ("double", "bigint"):
            kinds.setdefault(kind, []).append(a)
    other = F.lit(None).cast("string")
    for kind, attributes in sorted(kinds.items()):
        other = F.when(F.col("__a").isin(*attributes), read_as(kind, F.col("__v"))).otherwise(other)

    def chosen(typed: DataFrame) -> DataFrame:
        return typed.groupBy(*entity, "__a", "__whole").agg(
            F.max(F.when(F.col("__t").isNotNull(), F.struct("__r", "__t")))["__t"].alias("__t"),
            (F.min("__t") != F.max("__t")).alias("__x"),
        )

    # numbers are compared as numbers and spelled once a cell
    named = [*entity, "__a", "__whole", "__r"]
    numbers = base.where("__number").select(*named, read_number(F.col("__v")).alias("__t"))
    numbers = chosen(numbers.withColumn("__t", F.when(F.col("__whole"), F.round("__t")).otherwise(F.col("__t"))))
    spelled = F.when(F.col("__whole"), F.col("__t").try_cast("bigint").cast("string")).otherwise(F.col("__t").cast("string"))
    out = numbers.select(*entity, "__a", spelled.alias("__t"), "__x")
    if kinds:
        rest = chosen(base.where("NOT __number").select(*named, other.alias("__t"))).select(*entity, "__a", "__t", "__x")
        out = out.union(rest) if numeric else rest
    return out


def wide_from_long(
    rows: DataFrame, entity: Mapping[str, Column], attribute: Column, value: Column, types: Mapping[str, str] | Callable[[str], str] | None = None, recency: Sequence[Column] = (), max_attributes: int = 5_000, tables: int = 16
) -> DataFrame:
    """One row per entity with a typed column for each attribute.

    Entities are grouped by their characteristic set, the exact set of
    attributes that they have: each becomes a dense row (``signature`` and the
    values in its order).  The most frequent sets, up to ``tables``, are dense
    tables of their own, whose columns stand at fixed places; the entities of
    all rarer sets, of which there may be as many as entities, are one more
    table, whose rows carry their own set.  The tables are united by name, a
    column that a table lacks being null.

    ``types`` is a mapping or a function of the attribute's name; without it
    types are inferred from the values.  Beside the typed columns come
    ``signature`` (attributes, sorted) and ``contradicted`` (attributes with
    two or more different values).  An attribute all of whose values are
    missing belongs to the signature and is null.  An entity name that clashes
    with an attribute keeps its column, and the attribute gets the suffix
    ``_value``.  The number of attributes is checked against
    ``max_attributes``.
    """
    spellings = attribute_spellings(rows, attribute)
    if types is None:
        types = infer_types(rows, attribute, value)
    if not isinstance(types, Mapping) or spellings is not None:
        source = spellings if spellings is not None else rows.select(attribute_name(attribute).alias("__a"))
        names = sorted(r[0] for r in source.select("__a").where("__a IS NOT NULL").distinct().limit(max_attributes + 1).collect())
        types = {a: (types.get(a, "string") if isinstance(types, Mapping) else types(a)) for a in names}
    if len(types) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes")
    dense = durable(
        cells(rows, entity, attribute, value, types, recency, spellings)
        .groupBy(*entity)
        .agg(F.sort_array(F.collect_list(F.struct("__a", "__t", "__x"))).alias("__c"))
        .select(
            *entity,
            F.transform("__c", lambda c: c["__a"]).alias("signature"),
            F.transform("__c", lambda c: c["__t"]).alias("__dense"),
            F.transform(F.filter("__c", lambda c: F.coalesce(c["__x"], F.lit(False))), lambda c: c["__a"]).alias("contradicted"),
        )
    )
    column = lambda a: f"{a}_value" if a in entity or a in ("signature", "contradicted") else a
    frequent = [r.signature for r in characteristic_sets(dense).where("entities > 1").orderBy(F.desc("entities"), "signature").limit(tables).collect()]
    own = {"signature": F.col("signature"), "contradicted": F.col("contradicted")}
    parts = []
    for names in frequent:
        fixed = [F.get("__dense", F.lit(i)).try_cast(types[a]).alias(column(a)) for i, a in enumerate(names)]
        parts.append(dense.where(F.col("signature") == F.array(*map(F.lit, names))).select(*entity, *fixed, *own.values()))
    rest = dense
    for names in frequent:
        rest = rest.where(F.col("signature") != F.array(*map(F.lit, names)))
    found = [F.try_element_at("__dense", F.nullif(F.array_position("signature", a), F.lit(0)).cast("int")).try_cast(kind).alias(column(a)) for a, kind in sorted(types.items())]
    out = rest.select(*entity, *found, *own.values())
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def characteristic_sets(wide: DataFrame) -> DataFrame:
    """The signatures that occur, with their number of entities and attributes."""
    return wide.groupBy("signature").agg(F.count(F.lit(1)).alias("entities")).withColumn("attributes", F.size("signature"))
