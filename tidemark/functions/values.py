"""Column expressions for casts, identifiers, units and number formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_ms(ts: Name) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone; microseconds are cut."""
    ts = col(ts)
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * 86_400_000 + seconds.cast("long") * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def iso_ms(text: Name) -> Column:
    """Milliseconds of ISO-8601 text, quotes allowed; null if it is no timestamp."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(F.trim(col(text)), '^"|"$', "")))


def finite(x: Name) -> Column:
    """NaN and infinities become null."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def has_fractions(kind: T.DataType) -> bool:
    """Whether a type holds doubles or floats at any depth."""
    if isinstance(kind, T.StructType):
        return any(has_fractions(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_fractions(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_fractions(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def finite_nested(x: Name, kind: T.DataType, infinities: bool = True) -> Column:
    """x with every NaN (and, unless infinities=False, every infinity) in it null: in fields of structs, elements of arrays, values of maps, at any depth.

    The rewrite is made from the type: parts that can't hold any are passed on as they are, and null containers stay null.
    """
    c = col(x)
    if not has_fractions(kind):
        return c
    if isinstance(kind, T.StructType):
        fields = [finite_nested(c.getField(f.name), f.dataType, infinities).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: finite_nested(e, kind.elementType, infinities))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: finite_nested(v, kind.valueType, infinities))
    bad = F.isnan(c) | (F.abs(c) == float("inf")) if infinities else F.isnan(c)
    return F.when(~bad, c)


def without_infinities(df: DataFrame, infinities: bool = True) -> DataFrame:
    """finite_nested() of every column: what can be written as JSON."""
    return df.select(*[finite_nested(F.col(f"`{f.name}`"), f.dataType, infinities).alias(f.name) for f in df.schema])


def safe_int(x: Name) -> Column:
    """Text or number to int by way of double, toward zero; null if it is neither."""
    return finite(col(x).cast("string").try_cast("double")).try_cast("int")


def event_id(token: Name) -> Column:
    """The integer before the first underscore; 0 for null, blank or anything else."""
    return F.coalesce(F.split_part(F.trim(col(token).cast("string")), F.lit("_"), F.lit(1)).try_cast("int"), F.lit(0))


def event_params(token: Name) -> Column:
    """Parameters of "<id>_k=v;k=v" as a map; an empty map without any."""
    body = F.regexp_extract(col(token), r"^[^_]*_(.*)$", 1)
    return F.when(body.contains("="), F.str_to_map(body, F.lit(";"), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))


def fault_id(x: Name) -> Column:
    return F.coalesce(F.trim(col(x).cast("string")).try_cast("int"), F.lit(0))


def mapped(x: Name, codes: Mapping[str, object], passthrough: bool) -> Column:
    """Value under a small code map; unknown keys pass through or become null."""
    key = col(x).cast("string")
    table = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    found = F.element_at(table, key)
    return F.coalesce(found, key.cast(T.StringType())) if passthrough else found


def bit_pack(flags: Sequence[Name]) -> Column:
    """Flag i, from 0, sets bit i; null if all are null."""
    bits = [F.when(F.coalesce(col(x), F.lit(0)) != 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(flags)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return F.when(F.coalesce(*[col(x).cast("double") for x in flags]).isNotNull(), total)


def statement_id(x: Name) -> Column:
    """mc_0019, l2_mc_19 -> mc_019."""
    return F.format_string("mc_%03d", F.regexp_extract(col(x), r"(\d+)\s*$", 1).cast("int"))


def legacy_statement_id(x: Name) -> Column:
    return F.concat(F.lit("l2_"), statement_id(x))


def dataset_stem(x: Name) -> Column:
    """Lower-cased name without the first of the prefixes that mark derived datasets."""
    return F.regexp_replace(F.lower(F.trim(col(x))), "^(cf_|inter_|test_|local_)", "")


def reply_stem(x: Name) -> Column:
    """level1_0000_0_answer -> level1_0000: the suffix and a numeric tail after it go."""
    bare = F.regexp_replace(col(x), "_answer$", "")
    return F.when(F.size(F.split(bare, "_")) > 2, F.regexp_replace(bare, r"_\d+$", "")).otherwise(bare)


def level_of(path: Name) -> Column:
    return F.regexp_extract(col(path), r"(?:^|/)level(\d+)", 1).try_cast("int")


def token_estimate(text: Name) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("int"))


def price(model: Name, prices: Sequence[tuple[str, float, float]], default: tuple[float, float] = (5.0, 15.0)) -> Column:
    """Struct (input, output) of dollars per million tokens: the first pattern that the name contains counts."""
    of = lambda a, b: F.struct(F.lit(float(a)).alias("input"), F.lit(float(b)).alias("output"))
    out = F
    for pattern, a, b in prices:
        out = out.when(F.lower(col(model)).contains(pattern), of(a, b))
    return out.otherwise(of(*default)) if prices else of(*default)


def plain_number(x: Name, digits: int = 2) -> Column:
    """Rounded half even to digits, without trailing zeros: 3.0 -> 3, 58.551 -> 58.55."""
    text = F.bround(col(x).cast("decimal(30,9)"), digits).cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def rounded(x: Name, digits: int) -> Column:
    """A double rounded as SQL engines do it: scaled first, then half away from zero. F.round takes the shortest printed form instead, which falls the other way for some halves (49.1374125)."""
    scaled = F.round(col(x) * 10.0**digits, 0) / 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(col(x))


def python_number(x: Name) -> Column:
    """A number of at most six decimals as Python prints a float: 2.0, -0.25, 5e-06, 1.2e-05."""
    millionths = F.round(F.abs(col(x)) * 1e6).cast("long")
    text = F.regexp_replace(F.format_string("%.6f", col(x).cast("double")), r"(\.\d+?)0+$", "$1")
    sign = F.when(col(x) < 0, "-").otherwise("")
    tens = F.concat((millionths / 10).cast("int").cast("string"), F.when(millionths % 10 != 0, F.concat(F.lit("."), (millionths % 10).cast("string"))).otherwise(""))
    small = F.when(millionths < 10, F.concat(millionths.cast("string"), F.lit("e-06"))).otherwise(F.concat(tens, F.lit("e-05")))
    return F.when((millionths > 0) & (millionths < 100), F.concat(sign, small)).otherwise(text)


def norm(parts: Sequence[Name]) -> Column:
    """Euclidean norm; null if any part is."""
    total = F.lit(0.0)
    for p in parts:
        total = total + col(p) * col(p)
    return F.sqrt(total)


def mean_of(parts: Sequence[Column]) -> Column:
    """Mean of those that are not null."""
    there = F.array_compact(F.array(*parts))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


#: Canonical categories by prefix of the column's name, in order.
CATEGORIES = {
    "setpoint_": "intent",
    "gripper_command": "intent",
    "feedback_": "outcome",
    "effort_": "outcome",
    "control_output_": "outcome",
    "true_force_": "outcome",
    "est_contact_force_": "outcome",
    "vibration_": "outcome",
    "acoustic_": "outcome",
    "joint_": "context",
    "main_voltage": "context",
    "robot_": "context",
    "speed_scaling": "context",
    "safety_mode": "context",
}


def category(name: Name, prefixes: Mapping[str, str] = CATEGORIES) -> Column:
    """Category of a feature name, null for uncategorised ones."""
    out = F
    for prefix, cat in prefixes.items():
        out = out.when(col(name).startswith(prefix), F.lit(cat))
    return out.otherwise(F.lit(None).cast("string"))


def semantic_tags(schema: T.StructType) -> dict[str, str]:
    """Schema export: a semantic type for each column."""

    def tag(t: T.DataType) -> str:
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "sc:Integer"
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "sc:Float"
        if isinstance(t, T.BooleanType):
            return "sc:Boolean"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "sc:DateTime"
        if isinstance(t, T.ArrayType):
            return "sc:ItemList"
        if isinstance(t, (T.StructType, T.MapType)):
            return "sc:StructuredValue"
        return "sc:Text"

    return {f.name: tag(f.dataType) for f in schema}


# maps of features, for rows whose columns vary


def without_nulls(features: Name) -> Column:
    return F.map_filter(col(features), lambda k, v: v.isNotNull())


def without(features: Name, *names: str) -> Column:
    return F.map_filter(col(features), lambda k, v: ~k.isin(*names))


def only(features: Name, names: Sequence[str], always: Sequence[str] = ("timestamp_ms",)) -> Column:
    """The listed features and those that always stay."""
    return F.map_filter(col(features), lambda k, v: k.isin(*names, *always))


def by_key(features: Name) -> Column:
    """Entries (key, value) in the order of their keys."""
    return F.array_sort(F.map_entries(col(features)))


def positional_params(token: Name, kinds: Mapping[str, str]) -> Column:
    """Parameters of "<id>_a_b_1.5_3" as a map: numbers are taken from the right by their kinds (numeric, integer), what is left belongs to the one text.

    Null where there are fewer parts than numbers. Integers lose their fraction.
    """
    parts = F.slice(F.split(col(token), "_"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(col(token), "_")) - 1))
    n, names = F.size(parts), list(kinds)
    numbers = [k for k in names if kinds[k] in ("numeric", "integer")]
    values = []
    for k in names:
        if kinds[k] in ("numeric", "integer"):
            part = F.try_element_at(parts, F.lit(numbers.index(k) - len(numbers)))
            values.append(F.coalesce(safe_int(part).cast("string"), part) if kinds[k] == "integer" else part)
        else:
            first = [x for x in names if kinds[x] not in ("numeric", "integer")][0] == k
            values.append(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), n - len(numbers))), "_") if first else F.lit(""))
    return F.when(n >= len(numbers), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)))


_LITERAL = r"""['"](\w+)['"]\s*:\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|[^,{}]+)"""


def literal_dict(text: Name) -> Column:
    """Text of a dictionary as programs print it ({'a': 1, 'b': None}) as a map of texts; None is null, quotes go. Null for other text."""
    body = F.trim(col(text))
    keys, found = (F.regexp_extract_all(body, F.lit(_LITERAL), F.lit(i)) for i in (1, 2))
    values = F.transform(found, lambda v: F.when(F.trim(v) != "None", F.regexp_replace(F.trim(v), r"""^(['"])(.*)\1$""", "$2")))
    # of a repeated key the last value counts
    last = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.get(values, F.size(keys) - F.array_position(F.reverse(keys), k)).alias("v")))
    return F.when(body.rlike(r"(?s)^\{.*\}$"), F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))))


def metadata_fault(metadata: Name, fallback: Name) -> Column:
    """Fault id of an episode's metadata map, else of its fault metadata; null in both stays null."""
    return F.coalesce(safe_int(F.try_element_at(col(metadata), F.lit("fault_id"))), safe_int(F.try_element_at(col(fallback), F.lit("fault_id"))))


def condition(metadata: Name, fault: Name) -> Column:
    """The condition given; unknown ones are fault or normal by whether there is a fault id."""
    given = F.coalesce(F.try_element_at(col(metadata), F.lit("condition")), F.lit("unknown"))
    return F.when(given != "unknown", given).when(col(fault).isNotNull(), "fault").otherwise("normal")


def is_nominal(fault: Name, first_label: Name) -> Column:
    """By metadata, else by the first row's label; unknown is nominal."""
    return F.coalesce(col(fault), col(first_label), F.lit(0)) == 0


def is_anomalous(fault: Name) -> Column:
    """By metadata; absent counts as anomalous."""
    return F.coalesce(col(fault) != 0, F.lit(True))


def article(noun: Name) -> Column:
    return F.when(F.lower(F.substring(col(noun), 1, 1)).isin(*"aeiou"), F.concat(F.lit("an "), col(noun))).otherwise(F.concat(F.lit("a "), col(noun)))


def anomaly_name(fault: Name, cause: Name, known: Mapping[int, str], capital: bool = False) -> Column:
    """A phrase for the middle of a sentence: the known one, else the cause's words after "a", unless they have an article."""
    words = F.replace(F.coalesce(col(cause), F.concat(F.lit("fault "), col(fault).cast("string"))), F.lit("_"), F.lit(" "))
    made = F.when(words.startswith("a ") | words.startswith("an "), words).otherwise(F.concat(F.lit("a "), words))
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), col(fault)), made) if known else made
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2))) if capital else out


def display_name(name: Name, known: Mapping[str, str]) -> Column:
    """The known display name, else the name with spaces."""
    spaced = F.replace(col(name), F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), col(name)), spaced) if known else spaced


def fits_prompt(text: Name, most: int = 900_000) -> Column:
    """Whether a prompt's estimated tokens are within bounds."""
    return F.floor(F.length(col(text)) / 4) <= most


def decimal_places(text: Name) -> Column:
    return F.length(F.split_part(col(text), F.lit("."), F.lit(2)))


def is_integer_text(text: Name) -> Column:
    return ~col(text).contains(".") & F.trim(col(text)).try_cast("long").isNotNull()


def ten_point_score(score: Name) -> Column:
    """A judge's 0 to 10 as 0 to 1; a failed verdict is 0."""
    return F.when(col(score).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(score) / 10))).otherwise(F.lit(0.0))


def joint_bases(columns: Sequence[str], joints: int = 6, excluded: Sequence[str] = ("joint_voltage", "joint_temp", "joint_mode")) -> list[str]:
    """Signals that have every joint's column, base_0 to base_5; read from the schema."""
    bases = {c.rsplit("_", 1)[0] for c in columns if c.rsplit("_", 1)[-1].isdigit()}
    return sorted(b for b in bases if b not in excluded and all(f"{b}_{i}" in columns for i in range(joints)))


def family(name: Name) -> Column:
    """Struct (family, index) of names such as temp_12: the letters and the number at the end; null without a number."""
    n = F.regexp_extract(col(name), r"^([a-z_]+?)(\d+)$", 2)
    return F.when(n != "", F.struct(F.regexp_extract(col(name), r"^([a-z_]+?)(\d+)$", 1).alias("family"), n.cast("int").alias("index")))
