"""Model replies to rows: JSON location, comments, summaries, section extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.regex import java_regex
from corpusgauge.functions.rows import explode_items
from corpusgauge.functions.text import first_group, is_blank, let, strip

# Where JSON and summaries sit in a reply, and the field defaults.
JSON_BLOCK = java_regex(r"```json\s*([\s\S]*?)\s*```")
SUMMARY = java_regex(
    r"(?:^|\n)(?:##?\s*)?Summary:?\s*([\s\S]*?)(?:\n##|\n\n|$)", ignore_case=True
)
PURPOSE = java_regex(
    r"(?:###?\s*)?Purpose\s*\n(.*?)(?=\n###?\s|\n\n###?|\Z)", ignore_case=True, dot_all=True
)
KEY_ELEMENTS = java_regex(
    r"(?:###?\s*)?Key Elements\s*\n(.*?)(?=\n###?\s|\n\n###?|\Z)", ignore_case=True, dot_all=True
)
BULLET = java_regex(r"^\s*[-*]\s*(.+)$", multiline=True)
SEVERITIES = ("INFO", "WARNING", "ERROR")

COMMENT = (
    "struct<file:string,line:int,severity:string,category:string,message:string,suggestion:string>"
)


def located_json(response: Column) -> Column:
    """The first fenced JSON block, else a text that starts like JSON, else NULL."""
    bare = strip(response)
    starts = F.startswith(bare, F.lit("[")) | F.startswith(bare, F.lit("{"))
    fenced = F.when(response.rlike(JSON_BLOCK), strip(F.regexp_extract(response, JSON_BLOCK, 1)))
    return F.coalesce(fenced, F.when(starts, bare))


#: The greatest double stands for NaN, which no JSON number does; "1e999" reads as infinity.
NAN_MARK, NAN_TEXT = "1.7976931348623157e308", "1.7976931348623157E308"
# possessive, so that a long string is no deep recursion
_PIECES = java_regex(r'"(?:[^"\\]|\\[\s\S])*+"|[^"]+|"')
_ALONE = r"(?<![\w.+-]){}(?![\w.+-])"


def finite(json: Column) -> Column:
    """``json`` with ``NaN``, ``Infinity`` and ``-Infinity`` outside of strings as numbers.

    A text without these words is not touched.
    """

    def numbers(piece: Column) -> Column:
        for word, number in (("NaN", NAN_MARK), ("-Infinity", "-1e999"), ("Infinity", "1e999")):
            piece = F.regexp_replace(piece, _ALONE.format(word), number)
        return piece

    pieces = F.regexp_extract_all(json, F.lit(_PIECES), F.lit(0))
    mended = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(numbers(p)))
    return F.when(json.rlike("NaN|Infinity"), F.array_join(mended, "")).otherwise(json)


def strict_variant(json: Column) -> Column:
    """The parsed value, or NULL when the text is not exactly one JSON value.

    As in Python's reader, ``NaN`` and infinities are numbers (see ``finite``); of a repeated
    key the last counts, if the session allows such keys (see ``accept_repeated_keys``).
    The parser stops after the first value and ignores what follows.  A text with a
    tail cannot be valid both as an array element and as an object field, so both
    wrappings have to parse.
    """
    json = finite(json)
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("}")))
    as_element = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return F.when(as_element.isNotNull(), F.variant_get(as_field, "$.v", "variant"))


def accept_repeated_keys(spark: SparkSession) -> None:
    """Let the session's JSON reader take the last of a repeated key, instead of an error."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _text_at(value: Column, path: str) -> Column:
    """The value at ``path`` as text; NULL for none, an explicit null, a list or an object."""
    found = F.try_variant_get(value, path, "string")
    return F.when(found == NAN_TEXT, "NaN").otherwise(found)


def _python_type(value: Column) -> Column:
    """Python's name for the type of a JSON value, as its error texts use it."""
    return let(
        F.schema_of_variant(value),
        lambda kind: F.when(kind == "VOID", "NoneType")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(F.startswith(kind, F.lit("ARRAY")), "list")
        .when(F.startswith(kind, F.lit("OBJECT")), "dict")
        .when(kind.isNotNull(), "float"),
    )


def _no_attribute(type_name: Column, attribute: str) -> Column:
    return F.concat(F.lit("'"), type_name, F.lit(f"' object has no attribute '{attribute}'"))


def _item_error(item: Column) -> Column:
    """Why a comment item breaks the whole review; NULL when it does not."""

    def explain(types: Column) -> Column:
        return F.when(types["item"] != "dict", _no_attribute(types["item"], "get")).when(
            types["severity"] != "str", _no_attribute(types["severity"], "upper")
        )

    severity = F.variant_get(item, "$.severity", "variant")
    types = F.struct(
        _python_type(item).alias("item"), _python_type(severity).alias("severity")
    )
    return let(types, explain)


def _field(item: Column, name: str, default: str | None) -> Column:
    """String field: the default when missing, NULL when it is an explicit null."""
    value = _text_at(item, f"$.{name}")
    if default is None:
        return value
    missing = F.variant_get(item, f"$.{name}", "variant").isNull()
    return F.when(missing, F.lit(default)).otherwise(value)


def _whole_number(item: Column) -> Column:
    """``line`` where it is written as a whole number; text and fractions give NULL."""
    line = F.variant_get(item, "$.line", "variant")
    return F.when(_python_type(line) == "int", F.try_variant_get(item, "$.line", "int"))


def _comment(item: Column) -> Column:
    severity = F.upper(F.try_variant_get(item, "$.severity", "string"))
    return F.struct(
        _field(item, "file", "unknown").alias("file"),
        _whole_number(item).alias("line"),
        F.when(severity.isin(*SEVERITIES), F.lower(severity)).otherwise("info").alias("severity"),
        _field(item, "category", "general").alias("category"),
        _field(item, "message", "").alias("message"),
        _field(item, "suggestion", None).alias("suggestion"),
    )


def _text_comment(response: Column) -> Column:
    """The whole reply as one remark."""
    whole = F.array(
        F.struct(
            F.lit("general").alias("file"),
            F.lit(None).cast("int").alias("line"),
            F.lit("info").alias("severity"),
            F.lit("general").alias("category"),
            strip(response).alias("message"),
            F.lit(None).cast("string").alias("suggestion"),
        )
    )
    return F.when(is_blank(response), F.array().cast(f"array<{COMMENT}>")).otherwise(whole)


def parsed_replies(responses: DataFrame, *more: Column | str) -> DataFrame:
    """One row per reply with ``comments``, counts, own ``summary`` and ``failure``.

    ``more`` are further columns of ``responses`` to carry along.

    Everything happens in the row: no shuffle, and a reply never has to be put
    together again from exploded comments.  The session is set to accept repeated keys.
    """
    accept_repeated_keys(responses.sparkSession)
    data = F.col("data")
    # the text is known to be valid JSON here, so its first character tells the shape
    shape = (
        F.when(data.isNull(), "text")
        .when(F.startswith("json", F.lit("[")), "list")
        .when(F.startswith("json", F.lit("{")), "dict")
        .otherwise("scalar")
    )
    listed = F.variant_get(data, "$.comments", "variant")
    items = F.when(
        F.col("shape") == "list", F.try_variant_get(data, "$", "array<variant>")
    ).when(F.col("shape") == "dict", F.try_variant_get(data, "$.comments", "array<variant>"))

    def not_iterable(listed_type: Column) -> Column:
        """Error for a ``comments`` that is no list; a text or an object is iterated too."""
        return (
            F.when(
                listed_type.isin("NoneType", "int", "float", "bool"),
                F.concat(F.lit("'"), listed_type, F.lit("' object is not iterable")),
            )
            .when(
                (listed_type == "str") & (F.try_variant_get(data, "$.comments", "string") != ""),
                _no_attribute(F.lit("str"), "get"),
            )
            .when(
                (listed_type == "dict") & (F.to_json(listed) != "{}"),
                _no_attribute(F.lit("str"), "get"),
            )
        )

    bad_list = F.when(
        (F.col("shape") == "dict") & F.col("items").isNull() & listed.isNotNull(),
        let(_python_type(listed), not_iterable),
    )
    no_items = F.array().cast("array<variant>")
    first_bad = F.get(F.filter(F.transform("items", _item_error), lambda e: e.isNotNull()), 0)
    comments = F.when(F.col("failure").isNotNull(), F.array().cast(f"array<{COMMENT}>")).when(
        F.col("shape") == "text", _text_comment(F.col("response"))
    ).otherwise(F.transform(F.coalesce("items", no_items), _comment))

    def count(severity: str) -> Column:
        return F.size(F.filter("comments", lambda c: c["severity"] == severity)).cast("bigint")

    own_summary = F.when(
        (F.col("shape") == "dict") & F.variant_get(data, "$.summary", "variant").isNotNull(),
        F.coalesce(_text_at(data, "$.summary"), F.lit("")),
    ).otherwise(text_summary(F.col("response")))
    return (
        responses.withColumn("json", located_json(F.col("response")))
        .withColumn("data", strict_variant(F.col("json")))
        .withColumn("shape", shape)
        .withColumn("items", items)
        .withColumn("failure", F.coalesce(bad_list, first_bad))
        .withColumn("comments", comments)
        .select(
            "diff_id",
            "agent",
            "error",
            "failure",
            "comments",
            F.size("comments").cast("bigint").alias("n_comments"),
            count("error").alias("errors"),
            count("warning").alias("warnings"),
            count("info").alias("infos"),
            own_summary.alias("own_summary"),
            *more,
        )
    )


def text_summary(response: Column) -> Column:
    """Text after a ``Summary`` heading up to the next heading, blank line or end; else ''."""
    return F.coalesce(strip(first_group(response, SUMMARY)), F.lit(""))


def comments(responses: DataFrame) -> DataFrame:
    """One row per comment."""
    return explode_items(
        parsed_replies(responses), ["diff_id", "agent"], F.col("comments"), "comment_idx", "c"
    ).select("diff_id", "agent", "comment_idx", "c.*")


def purpose_of(response: Column) -> Column:
    """The ``Purpose`` section, else the first paragraph."""
    first_paragraph = strip(F.split_part(strip(response), F.lit("\n\n"), F.lit(1)))
    return F.coalesce(strip(first_group(response, PURPOSE)), first_paragraph)


def key_elements_of(response: Column) -> Column:
    """Bullets of the ``Key Elements`` section."""
    section = F.coalesce(first_group(response, KEY_ELEMENTS), F.lit(""))
    bullets = F.transform(F.regexp_extract_all(section, F.lit(BULLET), F.lit(1)), strip)
    return F.filter(bullets, lambda b: b != "")
