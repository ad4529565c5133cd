"""Replies of a reading provider: fences, JSON arrays, lenient validation of every frame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FRACTIONS, METADATA, METRIC_NAMES

FENCE, JSON_FENCE = "```", "```json"


def unfenced(reply: Column) -> Column:
    """What stands in the first json fence, else in the first fence, else all; trimmed."""
    inside = F.split_part(F.split_part(reply, F.lit(JSON_FENCE), F.lit(2)), F.lit(FENCE), F.lit(1))
    body = F.when(F.contains(reply, F.lit(JSON_FENCE)), inside).when(F.contains(reply, F.lit(FENCE)), F.split_part(reply, F.lit(FENCE), F.lit(2))).otherwise(reply)
    return F.btrim(body, F.lit(" \t\r\n"))


def field(text: Column, name: str, kind: str) -> Column:
    """One field of a JSON object, as a value of the given type."""
    return F.get_json_object(text, f"$.{name}").cast(kind)


#: What each field of a frame must become, by its path; fields of a kind are coerced by the same rule.
FIELDS = {
    "frame_index": "whole", "is_duplicate": "truth", "duplicate_of_frame": "whole", "actual_frame": "wording",
    **{f"metrics.{n}": "fraction" if n in FRACTIONS else "whole" for n in METRIC_NAMES},
    **{f"metadata.{n}": "wording" for n in METADATA.names},
}


def coerced(kind: Column, text: Column, target: Column) -> Column:
    """(whole, fraction, truth, wording, valid) of a JSON value of type `kind` with the given text.

    A whole number may be given as number, text or truth value, a fraction too, and null is null. A truth value may be a
    word or 0 or 1, and null is invalid. Wording is text only.
    """
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    truth, string, absent = kind == "BOOLEAN", kind == "STRING", kind == "VOID"
    written = F.when(text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*$"), F.replace(F.regexp_replace(F.btrim(text), r"\.0+$", ""), F.lit("_"), F.lit("")).try_cast("bigint"))
    exact = F.when(text.try_cast("double") == F.floor(text.try_cast("double")), text.try_cast("decimal(38,9)").try_cast("bigint"))
    whole = F.when(truth, (text == "true").cast("bigint")).when(string, written).when(number, exact)
    plain = F.regexp_replace(F.btrim(text), r"(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    fraction = F.when(truth, (text == "true").cast("double")).when(string, plain).when(number, text.try_cast("double"))
    word = F.lower(text)
    said = F.when(word.isin("true", "yes", "on", "t", "y", "1"), True).when(word.isin("false", "no", "off", "f", "n", "0"), False)
    counted = F.when(text.try_cast("double") == 1, True).when(text.try_cast("double") == 0, False)
    flag = F.when(truth, text == "true").when(string, said).when(number, counted)
    of = lambda name, value: F.when(target == name, value).alias(name)
    valid = F.when(target == "whole", absent | whole.isNotNull()).when(target == "fraction", absent | fraction.isNotNull()).when(target == "truth", flag.isNotNull()).otherwise(absent | string)
    return F.struct(of("whole", whole), of("fraction", fraction), of("truth", flag), of("wording", F.when(string, text)), valid.alias("valid"))


def parse(replies: DataFrame) -> DataFrame:
    """One row per frame of (job_id, batch_id, reply): pos, raw, the validated fields and is_valid.

    A reply that is no JSON array gives no rows. One invalid field makes the whole frame invalid; it keeps its raw text
    and null values, so it can be quarantined. Each frame is parsed once for its types and once for its texts, and its
    fields are coerced in one pass over an array.
    """
    rows = replies.select("job_id", "batch_id", F.posexplode(F.from_json(unfenced(F.col("reply")), "array<string>")).alias("pos", "raw"))
    # every level is parsed once for its texts and once for its types; only fields that a frame has are looked at
    targets = F.create_map(*(F.lit(x) for f in FIELDS.items() for x in f))
    both = lambda text, name: (F.from_json(text, "map<string,string>").alias(f"_{name}"), F.from_json(text, "map<string,variant>").alias(f"_{name}_types"))
    rows = rows.select("*", *both(F.col("raw"), "top"))
    rows = rows.select("*", *both(F.col("_top")["metrics"], "metrics"), *both(F.col("_top")["metadata"], "metadata"))

    def given(name: str, prefix: str) -> Column:
        kind = lambda e: F.schema_of_variant(F.col(f"_{name}_types")[e["key"]])
        found = F.transform(F.map_entries(f"_{name}"), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("path"), kind(e).alias("kind"), e["value"].alias("text")))
        return F.coalesce(F.filter(found, lambda x: F.map_contains_key(targets, x["path"])), F.expr("cast(array() as array<struct<path:string,kind:string,text:string>>)"))

    every = F.concat(given("top", ""), given("metrics", "metrics."), given("metadata", "metadata."))
    found = F.map_from_entries(F.transform(every, lambda x: F.struct(x["path"], coerced(x["kind"], x["text"], targets[x["path"]]))))
    type_of = lambda name: F.schema_of_variant(F.col("_top_types")[name]).alias(f"_{name}_type")
    rows = rows.select("job_id", "batch_id", "pos", "raw", found.alias("_fields"), type_of("metrics"), type_of("metadata"))
    absent = {"truth": F.lit(False)}
    value = lambda path: F.coalesce(F.col("_fields")[path][FIELDS[path]], absent.get(FIELDS[path], F.lit(None))).alias(path.split(".")[-1])
    of = lambda group: F.struct(*(value(path) for path in FIELDS if path.startswith(f"{group}.")))
    nested = lambda n: F.coalesce(F.col(f"_{n}_type").startswith("OBJECT") | (F.col(f"_{n}_type") == "VOID"), F.lit(True))
    valid = F.forall(F.map_values("_fields"), lambda x: F.coalesce(x["valid"], F.lit(False))) & nested("metrics") & nested("metadata") & F.coalesce(value("frame_index") >= 0, F.lit(False))
    rows = rows.select("*", valid.alias("is_valid"))
    told = F.when(F.col("_metadata_type").startswith("OBJECT"), of("metadata")).alias("metadata")
    fields = [value("frame_index"), value("is_duplicate"), value("duplicate_of_frame"), of("metrics").alias("metrics"), told, value("actual_frame")]
    name = ("frame_index", "is_duplicate", "duplicate_of_frame", "metrics", "metadata", "actual_frame")
    row = F.struct("is_valid", *(F.when(F.col("is_valid"), f).alias(n) for f, n in zip(fields, name)))
    return rows.select("job_id", "batch_id", "pos", "raw", F.inline(F.array(row)))  # a generator: no filter on the fields repeats the parsing below it
