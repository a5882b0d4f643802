"""Raw JSON payloads to typed rows, strictly, with a reason for every row that fails.

``from_json`` alone would coerce ``"id": 7`` to ``'7'`` and ignores required
fields. String fields are therefore read as VARIANT, which keeps their JSON type.
A row that passes is done after that one read; any other row is parsed as a whole
document and checked field by field, which names the first field that is wrong.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import change

_DOC = "__doc"

# The fields each event kind declares, in checking order, as
# (path, JSON type, required). Other fields pass through unread.
CHANGE_FIELDS = (
    ("meta", "object", True),
    ("meta.id", "string", True),
    ("meta.dt", "string", True),
    ("meta.stream", "string", True),
    ("meta.topic", "string", False),
    ("meta.domain", "string", False),
    ("type", "string", True),
    ("wiki", "string", True),
    ("namespace", "number", False),
    ("title", "string", False),
    ("user", "string", False),
    ("bot", "boolean", False),
    ("minor", "boolean", False),
    ("comment", "string", False),
    ("timestamp", "number", False),
    ("length", "object", False),
    ("length.old", "number", False),
    ("length.new", "number", False),
    ("revision", "object", False),
    ("revision.old", "number", False),
    ("revision.new", "number", "revision"),
    ("log_type", "string or null", False),
    ("log_action", "string or null", False),
)
TAGS_FIELDS = (
    ("meta", "object", True),
    ("meta.id", "string", True),
    ("meta.dt", "string", True),
    ("meta.stream", "string", True),
    ("database", "string", True),
    ("rev_id", "number", True),
    ("rev_timestamp", "string", True),
    ("page_namespace", "number", True),
    ("tags", "strings", True),
    ("prior_state", "object", False),
    ("prior_state.tags", "strings", "prior_state"),
)
ENVELOPE_FIELDS = ("meta.id", "meta.stream", "meta.dt")


def _at(path: str) -> Column:
    return F.try_variant_get(_DOC, f"$.{path}", "variant")


def _kind(path: str) -> Column:
    """JSON type at a path: NULL when absent, VOID for null."""
    return F.schema_of_variant(_at(path))


def _type_name(kind: Column) -> Column:
    return (
        F.when(kind.isNull(), "absent")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(F.substring(kind, 1, 3).isin("BIG", "DEC", "DOU", "FLO"), "number")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "strings")
        .when(kind == "VOID", "null")
        .otherwise("other")
    )


def _first_bad(fields: tuple) -> Column:
    """Path of the first field whose JSON type is not allowed.

    The test itself is one lambda over (path, type, allowed), however many fields.
    """
    found = []
    for path, wanted, required in fields:
        allowed = ["string", "null"] if wanted == "string or null" else [wanted]
        if required is not True:
            allowed.append("absent")
        kind = _kind(path)
        if isinstance(required, str):
            # Required inside an optional object: only where that object is there.
            kind = F.when(_at(required).isNotNull() & kind.isNull(), "missing").otherwise(kind)
        found.append(F.struct(F.lit(path).alias("path"), kind.alias("kind"), F.lit(",".join(allowed)).alias("allowed")))
    wrong = lambda f: F.find_in_set(_type_name(f["kind"]), f["allowed"]) == 0
    return F.get(F.filter(F.array(*found), wrong), F.lit(0))["path"]


def _evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    A filter on a plain projection is pushed below it together with its whole
    expression, so JSON would be parsed for the filter and again for the values.
    Generator output is not duplicated that way.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _text(path: str) -> Column:
    return F.try_variant_get(_DOC, f"$.{path}", "string")


# Both event kinds in one read. Wrong numbers, booleans and objects end in __corrupt.
_READ_SCHEMA = (
    "meta STRUCT<id: VARIANT, dt: VARIANT, stream: VARIANT, topic: VARIANT, domain: VARIANT>, type VARIANT, wiki VARIANT, "
    "namespace BIGINT, title VARIANT, user VARIANT, bot BOOLEAN, minor BOOLEAN, comment VARIANT, timestamp BIGINT, "
    "length STRUCT<old: BIGINT, new: BIGINT>, revision STRUCT<old: BIGINT, new: BIGINT>, log_type VARIANT, log_action VARIANT, "
    "database VARIANT, rev_id BIGINT, rev_timestamp VARIANT, page_namespace BIGINT, tags ARRAY<VARIANT>, "
    "prior_state STRUCT<tags: ARRAY<VARIANT>>, __corrupt STRING"
)
_READ = "__read"


def _is_text(field: str) -> Column:
    return F.coalesce(F.schema_of_variant(f"{_READ}.{field}") == "STRING", F.lit(False))


def _is_text_or_absent(field: str) -> Column:
    return F.col(f"{_READ}.{field}").isNull() | _is_text(field)


def _are_texts(field: str) -> Column:
    return F.coalesce(F.forall(f"{_READ}.{field}", lambda t: F.schema_of_variant(t) == "STRING"), F.lit(False))


def _all(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def _passes() -> Column:
    """The quick check: true only for rows every declared field of which is right.

    A JSON null reads like an absent field, so rows with any null take the full check.
    """
    r = lambda f: F.col(f"{_READ}.{f}")
    stream = F.try_variant_get(f"{_READ}.meta.stream", "$", "string")
    common = [r("__corrupt").isNull(), ~F.col("value").rlike(r":\s*null"), *[_is_text(f) for f in ("meta.id", "meta.dt", "meta.stream")]]
    a_change = [
        stream == change.CHANGE_STREAM,
        *[_is_text(f) for f in ("type", "wiki")],
        *[_is_text_or_absent(f) for f in ("meta.topic", "meta.domain", "title", "user", "comment", "log_type", "log_action")],
        r("revision").isNull() | r("revision.new").isNotNull(),
    ]
    a_tag_change = [
        stream == change.TAGS_STREAM,
        *[_is_text(f) for f in ("database", "rev_timestamp")],
        r("rev_id").isNotNull(),
        r("page_namespace").isNotNull(),
        _are_texts("tags"),
        r("prior_state").isNull() | _are_texts("prior_state.tags"),
    ]
    return F.coalesce(_all(*common) & (_all(*a_change) | _all(*a_tag_change)), F.lit(False))


def _value(path: str, kind: str) -> Column:
    """A field from the quick read, or from the whole document where that was needed."""
    quick = F.col(f"{_READ}.{path}")
    if kind == "string":
        quick = F.try_variant_get(f"{_READ}.{path}", "$", "string")
    elif kind == "array<string>":
        quick = F.transform(f"{_READ}.{path}", lambda t: F.try_variant_get(t, "$", "string"))
    return F.when(F.col("__quick"), quick).otherwise(F.try_variant_get(_DOC, f"$.{path}", kind))


def with_envelope(raw: DataFrame) -> DataFrame:
    """Add ``valid``: the payload is JSON whose meta id, stream and dt are non-empty strings."""
    checks = [F.coalesce((_kind(p) == "STRING") & (F.length(_text(p)) > 0), F.lit(False)) for p in ENVELOPE_FIELDS]
    parsed = _evaluated(raw, **{_DOC: F.try_parse_json("value")})
    return parsed.withColumn("valid", checks[0] & checks[1] & checks[2]).drop(_DOC)


def parse(raw: DataFrame) -> DataFrame:
    """Typed view of a raw log: one output row per input row.

    ``reason`` is NULL for a readable event; otherwise it names why no stage can
    read it. ``change`` / ``tags`` hold the typed event of the matching stream.
    """
    options = {"columnNameOfCorruptRecord": "__corrupt"}
    read = _evaluated(raw, **{_READ: F.from_json("value", _READ_SCHEMA, options)})
    quick = _evaluated(read, __quick=_passes())
    doc = _evaluated(quick, **{_DOC: F.when(~F.col("__quick"), F.try_parse_json("value"))})
    full_stream = F.when(_kind("meta.stream") == "STRING", _text("meta.stream"))
    named = doc.withColumn("stream", F.when(F.col("__quick"), _value("meta.stream", "string")).otherwise(full_stream))
    checked = _evaluated(
        named,
        __bad=F.when(F.col("__quick"), F.lit(None).cast("string"))
        .when(F.col("stream") == change.CHANGE_STREAM, _first_bad(CHANGE_FIELDS))
        .when(F.col("stream") == change.TAGS_STREAM, _first_bad(TAGS_FIELDS)),
    )
    reason = (
        F.when(F.col("__quick"), F.lit(None).cast("string"))
        .when(F.col(_DOC).isNull(), "not JSON")
        .when(F.col("stream") == change.CHANGE_STREAM, F.concat(F.lit("recentchange schema: "), "__bad"))
        .when(F.col("stream") == change.TAGS_STREAM, F.concat(F.lit("tags-change schema: "), "__bad"))
        .otherwise(F.concat(F.lit("unknown stream: "), F.coalesce("stream", F.lit("undefined"))))
    )
    has_tags = F.when(F.col("__quick"), F.col(f"{_READ}.tags").isNotNull()).otherwise(_at("tags").isNotNull())
    change_event = F.struct(
        *[
            _value(path, kind).alias(name)
            for name, path, kind in (
                ("topic", "meta.topic", "string"),
                ("domain", "meta.domain", "string"),
                ("type", "type", "string"),
                ("wiki", "wiki", "string"),
                ("namespace", "namespace", "bigint"),
                ("title", "title", "string"),
                ("user", "user", "string"),
                ("bot", "bot", "boolean"),
                ("minor", "minor", "boolean"),
                ("comment", "comment", "string"),
                ("timestamp", "timestamp", "bigint"),
                ("length_old", "length.old", "bigint"),
                ("length_new", "length.new", "bigint"),
                ("rev_old", "revision.old", "bigint"),
                ("rev_id", "revision.new", "bigint"),
                ("log_type", "log_type", "string"),
                ("log_action", "log_action", "string"),
            )
        ],
        has_tags.alias("has_tags_field"),
    )
    tags_event = F.struct(
        _value("database", "string").alias("wiki"),
        _value("rev_id", "bigint").alias("rev_id"),
        F.try_to_timestamp(_value("rev_timestamp", "string")).alias("rev_timestamp"),
        _value("page_namespace", "bigint").alias("namespace"),
        _value("tags", "array<string>").alias("tags"),
        _value("prior_state.tags", "array<string>").alias("prior_tags"),
    )
    ok = F.col("reason").isNull()
    return (
        checked.withColumn("reason", reason)
        .withColumn("meta_id", _value("meta.id", "string"))
        .withColumn("dt", F.try_to_timestamp(_value("meta.dt", "string")))
        .withColumn("change", F.when(ok & (F.col("stream") == change.CHANGE_STREAM), change_event))
        .withColumn("tags", F.when(ok & (F.col("stream") == change.TAGS_STREAM), tags_event))
        .drop(_DOC, _READ, "__quick", "__bad")
    )


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull())


def dead_letters(parsed: DataFrame) -> DataFrame:
    """(key, reason, source_offset, raw) of every row no stage can read."""
    return parsed.where(F.col("reason").isNotNull()).select(
        F.coalesce("meta_id", F.concat(F.lit("offset-"), F.col("offset"))).alias("key"),
        "reason",
        F.col("offset").alias("source_offset"),
        F.col("value").alias("raw"),
    )


def edits(parsed: DataFrame, wiki: str = "enwiki") -> DataFrame:
    """Classifiable edits of one wiki as flat records; ``offset`` and ``dt`` stay beside them."""
    c = F.col("change")
    wanted = (
        (c["wiki"] == wiki)
        & change.is_classifiable(c["type"], c["namespace"])
        & c["rev_id"].isNotNull()
        & c["timestamp"].isNotNull()
    )
    return parsed.where(wanted).select(
        c["rev_id"].alias("rev_id"),
        c["wiki"].alias("wiki"),
        F.coalesce(c["title"], F.lit("")).alias("title"),
        c["timestamp"].alias("timestamp"),
        change.user_class(c["user"], c["bot"]).alias("user_class"),
        F.coalesce(c["user"], F.lit("")).alias("user"),
        F.coalesce(c["minor"], F.lit(False)).alias("minor"),
        (c["type"] == "new").alias("is_new"),
        c["length_old"].alias("length_old"),
        c["length_new"].alias("length_new"),
        F.coalesce(c["comment"], F.lit("")).alias("comment"),
        "meta_id",
        "offset",
        "dt",
    )


def tag_changes(parsed: DataFrame, wiki: str = "enwiki") -> DataFrame:
    """Tag-change events of one wiki, with the tags each one added."""
    rows = parsed.where(F.col("tags.wiki") == wiki).select("tags.*", "offset", "dt")
    return rows.withColumn("added", change.added_tags(F.col("tags"), F.col("prior_tags"))).drop("wiki", "prior_tags")


def page_deletions(parsed: DataFrame, wiki: str = "enwiki") -> DataFrame:
    c = F.col("change")
    wanted = (c["wiki"] == wiki) & change.is_page_deletion(c["type"], c["log_type"], c["log_action"], c["title"])
    return parsed.where(wanted).select(c["title"].alias("title"), "offset", "dt")


def mentions(raw: DataFrame, text: str) -> DataFrame:
    """Substring test on the payload before any JSON parsing."""
    return raw.where(F.col("value").contains(text))


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the earliest in ``order``; copies collapse before the shuffle."""
    return _one_by_key(df, key, F.min_by, order)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return _one_by_key(df, key, F.max_by, order)


def _one_by_key(df: DataFrame, key: str, pick, order: str) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(pick(row, F.col(order)).alias("__row")).select("__row.*")
