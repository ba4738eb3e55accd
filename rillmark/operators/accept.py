"""Events that meet every rule, judged by columns alone.

An event is read once as VARIANT, its schema comes by a join with the catalog, and all rules are
expressions: names, identity, time, version, and the type, length, listed values and text of each
property.  ``fits`` is true only where the expressions give what the rules on one event (``normalize``)
give, and the event is accepted or sampled out.  It is false for whatever breaks a rule, and for a few
spellings that are left to those rules: repeated keys, escaped surrogates, exponents, numbers of more
than 15 digits, and texts whose length in bytes exceeds what is allowed in characters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.identity import bucket, key_of
from ..sources.registry import Settings, Snapshot

CATALOG = (
    "c_project string, c_event string, c_version int, c_number int, c_types map<string,string>, c_required array<string>, "
    "c_enums map<string,array<string>>, c_redact array<string>, c_threshold int"
)
LATEST = 0
#: The common ways to write an instant; others are left to the rules on one event.
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-](0\d|1[0-3]):[0-5]\d)$"
#: Longer texts, in bytes, are left to them as well: few are accepted, and reading them as columns costs more than judging them.
MAX_COLUMNS = 64 * 1_024
SURROGATE = r"\\u[dD][89a-fA-F]"
CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
#: Decimals of at most 15 digits whose shortest text is their own.
PLAIN = r"^-?([1-9]\d{0,13}(\.\d+)?|0\.0{0,3}[1-9]\d*)$"


def catalog(spark: SparkSession, snapshot: Snapshot) -> DataFrame:
    """One row for each version of a schema, and one more (version 0) for the newest of an event."""
    rows = []
    for project, events in snapshot.schemas.items():
        settings = snapshot.projects.get(project, Settings())
        for event in events:
            for asked in (None, *events[event]):
                if found := snapshot.find(project, event, asked):
                    number, spec = found
                    types = {n: p.type for n, p in spec.properties.items()}
                    enums = {n: list(p.enum) for n, p in spec.properties.items() if p.enum is not None}
                    required = [n for n, p in spec.properties.items() if p.required]
                    rows.append((project, event, asked or LATEST, number, types, required, enums, list(settings.redact), settings.threshold(event)))
    return spark.createDataFrame(rows, CATALOG)


def _text(value: Column) -> Column:
    """A variant as text; null for what is none of text, number and truth value."""
    return F.try_variant_get(value, "$", "string")


def _string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", _text(value))


def with_parsed(rows: DataFrame) -> DataFrame:
    """The rows with ``e``: the top level of the JSON object ``raw`` as a map; null for anything else, also for text behind the
    object and for texts of more than ``MAX_COLUMNS`` bytes.

    The parser stops behind the first value, so the text is read as the first element of an array whose second one must be
    a token that no sender knows.  The parsed array is a column of its own, so that it is made once for both of its readers."""
    token, raw = uuid.uuid4().hex, F.col("raw")
    brackets = F.octet_length(raw) - F.octet_length(F.replace(F.replace(raw, F.lit("["), F.lit("")), F.lit("{"), F.lit("")))  # as many levels at most
    halves = F.coalesce(raw.contains("\\u") & raw.rlike(SURROGATE), F.lit(True))
    array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{token}"]')))
    rows = rows.withColumn("both", F.when((F.octet_length(raw) <= MAX_COLUMNS) & ~halves & (brackets <= 64), array))
    whole = F.coalesce(F.try_variant_get("both", "$[1]", "string") == token, F.lit(False))
    return rows.withColumn("e", F.when(whole, F.try_variant_get("both", "$[0]", "map<string,variant>"))).drop("both")


def _stored(name: Column, value: Column) -> Column:
    """Text that is stored for a declared property, null where the rules on one event must decide."""
    kind, text, wanted = F.schema_of_variant(value), _text(value), F.try_element_at("c_types", name)
    listed = F.try_element_at("c_enums", name)
    hidden = F.array_contains("c_redact", name)
    fits = (
        F.when((wanted == "string") & (kind == "STRING"), (F.octet_length(text) <= 1_024) & F.coalesce(F.array_contains(listed, text), F.lit(True)))
        .when((wanted == "integer") & (kind == "BIGINT"), F.lit(True))
        .when((wanted == "number") & (kind == "BIGINT"), F.char_length(text) <= 15)
        .when((wanted == "number") & kind.startswith("DECIMAL"), (F.char_length(text) <= 16) & text.rlike(PLAIN))
        .when((wanted == "boolean") & (kind == "BOOLEAN"), F.lit(True))
        .otherwise(F.lit(False))
    )
    redacted = F.lit("[redacted]")
    return F.when(hidden & (fits | ((kind == "STRING") & (text == redacted))), redacted).when(~hidden & fits, text)


def judged(df: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``project_id, raw, received_at, pos`` (and more) with ``fits`` and the columns of a row that fits, but for the user's key."""
    from .normalize import is_event_name, is_message_id, timing

    field = lambda name: F.try_element_at("e", F.lit(name))
    rows = with_parsed(df.withColumn("received_at", F.timestamp_millis(F.unix_millis("received_at"))))
    given = field("properties")
    version, version_kind = field("version"), F.schema_of_variant(field("version"))
    given = F.when(given.isNull() | (F.schema_of_variant(given) == "VOID"), F.create_map().cast("map<string,variant>")).otherwise(F.try_variant_get(given, "$", "map<string,variant>"))
    # The filter stands in this step because Spark does not fuse higher-order functions: fused with the steps around it, the
    # fields make one method that is too large for the JVM to compile, and each event takes twice as long.
    rows = rows.withColumns({
        "message_id": _string(field("messageId")), "event_name": _string(field("event")), "ts_text": _string(field("timestamp")),
        "user_id": F.coalesce(_string(field("userId")), F.lit("")), "anonymous_id": F.coalesce(_string(field("anonymousId")), F.lit("")),
        "asked": F.when(version.isNull() | (version_kind == "VOID"), F.lit(LATEST)).when(version_kind == "BIGINT", F.nullif(F.try_variant_get(version, "$", "int"), F.lit(LATEST))),
        "given": given, "present": F.filter(F.map_entries(given), lambda x: F.schema_of_variant(x["value"]) != "VOID"),
    }).drop("e")
    rows = rows.withColumn("ts", F.when((F.octet_length("ts_text") <= 40) & F.col("ts_text").rlike(INSTANT), F.timestamp_millis(F.unix_millis(F.col("ts_text").try_cast("timestamp")))))
    rows = rows.join(F.broadcast(catalog(df.sparkSession, snapshot)), (F.col("project_id") == F.col("c_project")) & (F.col("event_name") == F.col("c_event")) & (F.col("asked") == F.col("c_version")), "left")
    rows = rows.withColumn("texts", F.transform("present", lambda x: F.struct(x["key"].alias("key"), _stored(x["key"], x["value"]).alias("value"))))
    clean = lambda c: (F.octet_length(c) <= 256) & ~F.col(c).rlike(CONTROLS)
    declared = F.forall(F.map_keys("given"), lambda n: F.array_contains(F.map_keys("c_types"), n))
    complete = F.forall("c_required", lambda n: F.exists("texts", lambda t: t["key"] == n))
    rules = (
        F.col("project_id").isNotNull() & F.col("received_at").isNotNull() & is_message_id(F.col("message_id")) & is_event_name(F.col("event_name"))
        & ((F.col("user_id") != "") | (F.col("anonymous_id") != "")) & clean("user_id") & clean("anonymous_id")
        & timing(F.col("ts"), F.col("received_at")).isin("late", "on_time") & F.col("ts").isNotNull()
        & F.col("c_number").isNotNull() & declared & F.forall("texts", lambda t: t["value"].isNotNull()) & complete
    )
    return rows.withColumn("fits", F.coalesce(rules, F.lit(False)))


def finished(judged_rows: DataFrame, snapshot: Snapshot, names: list[str]) -> DataFrame:
    """The columns ``names`` of all rows: those that fit are accepted or sampled out, the others are judged one by one.

    One function of whole batches serves both, so that events are read and judged once: it gives the key of the identity, by
    a hash that Spark does not have, and of rows that do not fit whatever the rules on one event say."""
    from .normalize import SCHEMA, Normalizer, timing

    shared = judged_rows.sparkSession.sparkContext.broadcast(snapshot)  # bounded by the catalog's limits
    schema = StructType.fromDDL(SCHEMA)
    target = to_arrow_schema(schema)

    @F.arrow_udf(schema)
    def told(fits, project, raw, received, pos, user, anonymous):
        import pyarrow as pa

        own = Normalizer(shared.value)
        flags = fits.to_pylist()
        keys = [key_of(u, a) if f else None for f, u, a in zip(flags, user.to_pylist(), anonymous.to_pylist(), strict=True)]
        chosen = [i for i, f in enumerate(flags) if not f]
        others = (column.take(pa.array(chosen, pa.int64())).to_pylist() for column in (project, raw, received, pos))
        rows = [own(*row) for row in zip(*others, strict=True)]
        for i, row in zip(chosen, rows, strict=True):
            keys[i] = row["user_key"]
        place = dict(zip(chosen, range(len(chosen)), strict=True))
        at = pa.array([place.get(i) for i in range(len(flags))], pa.int64())
        arrays = []
        for field in target:
            if field.name == "user_key":
                arrays.append(pa.array(keys, field.type))
                continue
            values = [row[field.name] for row in rows]
            if field.name == "properties":
                values = [None if p is None else list(p.items()) for p in values]
            arrays.append(pa.array(values, field.type).take(at))
        return pa.StructArray.from_arrays(arrays, fields=list(target))

    args = ["fits", "project_id", F.when(~F.col("fits"), F.col("raw")), "received_at", "pos", "user_id", "anonymous_id"]
    rows = judged_rows.withColumn("told", told(*args)).withColumn("sample_bucket", bucket(F.col("told.user_key")))
    nothing = F.lit(None).cast("string")
    own = {
        "status": F.when(F.col("sample_bucket") < F.col("c_threshold"), "accepted").otherwise("sampled_out"), "reason": nothing, "payload": nothing, "quarantine_id": nothing,
        "schema_version": F.col("c_number"), "sample_threshold": F.col("c_threshold"), "is_late": timing(F.col("ts"), F.col("received_at")) == "late",
        "properties": F.map_from_entries("texts"),
    }
    given = {"pos", "key"}  # the same either way
    pick = lambda n: F.col("told.user_key").alias(n) if n == "user_key" else F.when(F.col("fits"), own.get(n, F.col(n))).otherwise(F.col(f"told.{n}")).alias(n)
    return rows.select(*[F.col(n) if n in given else pick(n) for n in names])
