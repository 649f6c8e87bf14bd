"""Validation of JSON requests with typed rules, as expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelway.functions.text import is_blank

DEFAULT_TOPK_CAT = 2
DEFAULT_TOPK_SUB = 5
#: Integers of requests: exact up to 38 digits.
EXACT = "decimal(38,0)"
#: Before what stands for a number that is none.
MARK = "\x01"

# Error messages of the service contract.
BAD_JSON = "Invalid or missing JSON"
NOT_OBJECT = "JSON body must be an object"
BAD_TEXT = "Field 'text' must be a non-empty string"
NO_MODEL = "Artifacts directory not found: "
NOT_INT = "int() argument must be a string, a bytes-like object or a real number, not '{}'"
WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
BAD_INT = "invalid literal for int() with base 10: '"
NAN_INT = "cannot convert float NaN to integer"
INF_INT = "cannot convert float infinity to integer"
TOO_LONG = "integer of more than 38 digits: "
#: From where the last match ended: strings and other signs, then the bare word.
NO_NUMBER = (
    r'\G((?:[^"NI-]|"(?:[^"\\]|\\.)*+"|-(?!Infinity)|N(?!aN)|I(?!nfinity))*+)(NaN|-?Infinity)'
)


FIELDS = ("text", "art_dir", "device", "topk_cat", "topk_sub")


def _with_fields(df: DataFrame, body: str) -> DataFrame:
    """Adds ``__<field>`` (text form) and ``__<field>_kind`` (type name: null
    when absent, VOID for a JSON null) for every known field.

    Columns of their own, so later rules refer to them instead of repeating
    the extraction.
    """
    b = F.col(body)
    columns = {"__root_kind": F.schema_of_variant(b)}
    for name in FIELDS:
        columns[f"__{name}"] = F.try_variant_get(b, f"$.{name}", "string")
        columns[f"__{name}_kind"] = F.schema_of_variant(F.try_variant_get(b, f"$.{name}", "variant"))
    return df.withColumns(columns)


def _plain(text: Column) -> Column:
    """Whole digits, with a minus before negative ones, as decimal(38,0); null beyond 38 digits."""
    return F.regexp_replace(text, r"[\s_+]", "").try_cast(EXACT)


def _whole_double(x: Column) -> Column:
    """The integer part of a double, exactly; null beyond 38 digits, for infinite and for no number.

    Up to 2^53 a long holds it. A greater one is an integer of 54 bits at most times a power of two.
    """
    power = F.greatest(F.floor(F.log2(F.abs(x))) - 53, F.lit(0)).cast("int")
    bits = (x / F.pow(F.lit(2.0), power)).try_cast("bigint").cast(EXACT)
    half = F.least(power, F.lit(62))
    two_to = lambda n: F.pow(F.lit(2.0), n).cast("bigint").cast(EXACT)
    scale, rest = two_to(half), two_to(F.least(power - half, F.lit(62)))
    exact = F.try_multiply(F.try_multiply(bits, scale), rest).try_cast(EXACT)
    return F.when(F.abs(x) < float(1 << 53), x.try_cast("bigint").cast(EXACT)).when(F.abs(x) < 1e38, exact)


def _int_value(name: str, default: int) -> Column:
    """Integer parameter: numbers truncate, booleans are 0 or 1, strings must
    be whole numbers; null for all else, and beyond 38 digits."""
    kind, text = F.col(f"__{name}_kind"), F.col(f"__{name}")
    # integers that a long holds are BIGINT; a decimal of that size was written with a point
    whole = kind.rlike("^DECIMAL") & ~F.contains(text, F.lit(".")) & text.try_cast("bigint").isNull()
    return (
        F.when(kind.isNull(), F.lit(default).cast(EXACT))
        .when((kind == "BIGINT") | whole, text.try_cast(EXACT))
        .when(kind == "BOOLEAN", (text == "true").cast("int").cast(EXACT))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), _whole_double(text.try_cast("double")))
        .when((kind == "STRING") & text.rlike(WHOLE), _plain(text))
    )


def _int_error(name: str) -> Column:
    kind, text = F.col(f"__{name}_kind"), F.col(f"__{name}")
    real = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double"))
    return (
        F.when(kind == "VOID", NOT_INT.format("NoneType"))
        .when(F.startswith(kind, F.lit("ARRAY")), NOT_INT.format("list"))
        .when(F.startswith(kind, F.lit("OBJECT")), NOT_INT.format("dict"))
        .when(_is_marked(text), F.when(text == MARK + "NaN", NAN_INT).otherwise(INF_INT))
        .when((kind == "STRING") & ~text.rlike(WHOLE), F.concat(F.lit(BAD_INT), text, F.lit("'")))
        .when(F.abs(real) == float("inf"), INF_INT)
        .when(_int_value(name, 0).isNull(), F.concat(F.lit(TOO_LONG), F.lit(name)))
    )


def _is_marked(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit(MARK)), F.lit(False))


def with_marked_numbers(value: Column) -> Column:
    """Bare ``NaN``, ``Infinity`` and ``-Infinity`` of a JSON text as marked strings; what stands
    inside strings stays. JSON as such has no such numbers, the service takes them."""
    marked = F.regexp_replace(value, NO_NUMBER, '$1"\\\\u0001$2"')
    return F.when(value.rlike("NaN|Infinity"), marked).otherwise(value)


def _model_name(default_model: str) -> Column:
    """The requested model, or the default for absent and empty values."""
    kind, text = F.col("__art_dir_kind"), F.col("__art_dir")
    empty = (
        kind.isNull()
        | kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>")
        | ((kind == "STRING") & (text == ""))
        | ((kind == "BOOLEAN") & (text == "false"))
        | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (text.try_cast("double") == 0))
    )
    # a number that is none has a name of its own
    number = F.lower(F.regexp_replace(F.substr(text, F.lit(2)), "inity", ""))
    named = F.when(_is_marked(text), number).otherwise(F.coalesce(text, F.lit("")))
    return F.when(empty, F.lit(default_model)).otherwise(named)


def validate_requests(
    df: DataFrame, model_ids: list[str], default_model: str, value: str = "value"
) -> DataFrame:
    """Replaces the payload by status, error and typed parameters.

    400 for bad bodies, 500 for bad integers, 404 for unknown models, in this
    order. ``topk_cat`` is raised to 1, ``topk_sub`` is kept as given; both are exact, and an
    integer of more than 38 digits is a bad one. Of repeated fields the last counts, for
    which this sets ``spark.sql.variant.allowDuplicateKeys`` where the session does not.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    keep = [c for c in df.columns if c != value]
    fields = _with_fields(df.select(*keep, F.try_parse_json(with_marked_numbers(F.col(value))).alias("__body")), "__body")
    is_text = F.coalesce(F.col("__text_kind") == "STRING", F.lit(False)) & ~_is_marked(F.col("__text"))
    checked = fields.select(
        *keep,
        F.when(F.col("__root_kind").isNull(), BAD_JSON)
        .when(~F.startswith("__root_kind", F.lit("OBJECT")), NOT_OBJECT)
        .when(~is_text | is_blank(F.col("__text")), BAD_TEXT)
        .alias("__bad"),
        F.coalesce(_int_error("topk_cat"), _int_error("topk_sub")).alias("__not_int"),
        F.col("__text").alias("text"),
        _model_name(default_model).alias("model_id"),
        F.when(F.col("__device_kind").isNull(), "auto")
        .otherwise(F.coalesce("__device", F.lit("None")))
        .alias("device"),
        F.greatest(_int_value("topk_cat", DEFAULT_TOPK_CAT), F.lit(1).cast(EXACT)).alias("topk_cat"),
        _int_value("topk_sub", DEFAULT_TOPK_SUB).alias("topk_sub"),
    )
    missing = F.when(~F.col("model_id").isin(model_ids), F.concat(F.lit(NO_MODEL), "model_id"))
    status = (
        F.when(F.col("__bad").isNotNull(), 400)
        .when(F.col("__not_int").isNotNull(), 500)
        .when(missing.isNotNull(), 404)
        .otherwise(200)
    )
    judged = checked.withColumns({"status": status, "error": F.coalesce("__bad", "__not_int", missing)})
    ok = F.col("status") == 200
    return judged.select(
        *keep,
        "status",
        "error",
        *[F.when(ok, F.col(c)).alias(c) for c in ("text", "model_id", "device", "topk_cat", "topk_sub")],
    )
