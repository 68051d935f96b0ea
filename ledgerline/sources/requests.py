"""Request sources: JSON bodies (S2) and request-log lines.

Bodies are parsed into Spark's VARIANT type and log lines with ``from_json``
against a declared schema (no inference). A body that is not JSON is flagged
so the validation step can reject it, as the API answers 400
``Invalid JSON format``. Bodies that arrive as a stream come in envelopes, one JSON line each
(:func:`posting_requests`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

TRANSACTION_BODY = T.StructType([
    T.StructField("accountNumber", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("description", T.StringType()),
])
TRANSFER_BODY = T.StructType([
    T.StructField("fromAccount", T.StringType()),
    T.StructField("toAccount", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("description", T.StringType()),
])
ACCOUNT_BODY = T.StructType([
    T.StructField("firstName", T.StringType()),
    T.StructField("lastName", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("initialDeposit", T.StringType()),
])


_NUMBER_KINDS = ("DECIMAL", "BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def read_requests(raw: DataFrame, body_col: str = "body", schema: T.StructType = TRANSACTION_BODY) -> DataFrame:
    """JSON request bodies to typed columns.

    The body is parsed once into a VARIANT (``try_parse_json``; malformed
    text gives NULL). Adds ``json_ok`` (the body is a JSON object) and one
    string column per schema field, except ``amount`` / ``initialDeposit``:
    those give ``<field>_present`` (the key exists, even as JSON null),
    ``<field>_is_number`` (the JSON value is a number, as the API's
    ``typeof x === 'number'`` test requires) and ``<field>_value``, the exact
    ``decimal(15,2)`` of that number (never a double)."""
    v = F.expr(f"try_parse_json({body_col})")
    out = raw.select(*[c for c in raw.columns if c != body_col], v.alias("_v"))
    ok = F.col("_v").isNotNull() & F.expr("schema_of_variant(_v)").startswith("OBJECT")
    cols = [F.col(c) for c in out.columns if c != "_v"] + [ok.alias("json_ok")]
    for f in schema.fields:
        path = f"$.{f.name}"
        if f.name in ("amount", "initialDeposit"):
            kind = F.expr(f"schema_of_variant(variant_get(_v, '{path}', 'variant'))")
            is_num = F.coalesce(F.regexp_extract(kind, r"^([A-Z]+)", 1).isin(*_NUMBER_KINDS), F.lit(False))
            present = F.expr(f"variant_get(_v, '{path}', 'variant')").isNotNull()
            cols.append(present.alias(f"{f.name}_present"))
            cols.append(is_num.alias(f"{f.name}_is_number"))
            cols.append(F.when(is_num, F.expr(f"try_variant_get(_v, '{path}', 'decimal(15,2)')"))
                        .alias(f"{f.name}_value"))
        else:
            cols.append(F.expr(f"try_variant_get(_v, '{path}', 'string')").alias(f.name))
    return out.select(*cols)


ENVELOPE = T.StructType([
    T.StructField("requestId", T.LongType()),
    T.StructField("requestedAt", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("body", T.StringType()),
])
TRANSACTIONS_PATH, TRANSFERS_PATH = "/api/transactions", "/api/transfers"
_POSTING_BODY = T.StructType([*TRANSACTION_BODY.fields, *[f for f in TRANSFER_BODY.fields if f.name.endswith("Account")]])


def posting_requests(lines: DataFrame) -> DataFrame:
    """S2 on request envelopes (column ``value``, one JSON object a line, batch or stream): the columns of
    ``schemas.REQUESTS``, ``line`` and ``reason``, one row per line.

    An envelope holds the request's id, its time, the path it was sent to and the body as it was sent (text, or the
    object itself). ``reason`` is NULL for a request that may be posted, else the first failure:
    ``invalid_envelope`` (not an object, or without id or time), ``unknown_path``, or what the API's checks of the
    path's body say (T14). An empty line is an ``invalid_envelope``."""
    from ..operators import validation

    envelope = F.from_json("value", ENVELOPE)
    rows = lines.select(F.col("value").alias("line"), envelope.alias("_e")).select("line", "_e.*")
    rows = rows.withColumn("requested_at", F.expr("try_cast(requestedAt AS timestamp)"))
    parsed = read_requests(rows, schema=_POSTING_BODY)
    is_transfer = F.col("path") == TRANSFERS_PATH
    reason = (
        F.when(F.col("requestId").isNull() | F.col("requested_at").isNull(), F.lit("invalid_envelope"))
        .when(is_transfer, validation.transfer_reason())
        .when(F.col("path") == TRANSACTIONS_PATH, validation.transaction_reason())
        .otherwise(F.lit("unknown_path"))
    )
    return schemas.conform(parsed.select(
        F.col("requestId").alias("request_id"), "requested_at",
        F.when(is_transfer, F.col("fromAccount")).otherwise(F.col("accountNumber")).alias("account_number"),
        F.when(is_transfer, F.lit("transfer")).otherwise(F.col("type")).alias("op"),
        F.when(is_transfer, F.col("toAccount")).alias("to_account"),
        F.col("amount_value").alias("amount"), "description", "line", reason.alias("reason"),
    ), [*schemas.REQUESTS, ("line", T.StringType(), "VARCHAR"), ("reason", T.StringType(), "VARCHAR")])


def envelopes(requests: DataFrame) -> DataFrame:
    """The envelope lines of posting requests (the writer side of :func:`posting_requests`). A request without an amount
    has a body without one."""
    is_transfer = F.col("op") == "transfer"
    body = F.when(is_transfer, F.to_json(F.struct(
        F.col("account_number").alias("fromAccount"), F.col("to_account").alias("toAccount"), "amount", "description",
    ))).otherwise(F.to_json(F.struct(
        F.col("account_number").alias("accountNumber"), F.col("op").alias("type"), "amount", "description",
    )))
    return requests.select(F.to_json(F.struct(
        F.col("request_id").alias("requestId"),
        F.date_format("requested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("requestedAt"),
        F.when(is_transfer, F.lit(TRANSFERS_PATH)).otherwise(F.lit(TRANSACTIONS_PATH)).alias("path"), body.alias("body"),
    )).alias("value"))


REQUEST_LOG_LINE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration", T.StringType()),
    T.StructField("ip", T.StringType()),
])


def read_request_log(spark: SparkSession | None = None, path: str | None = None,
                     lines: DataFrame | None = None) -> DataFrame:
    """Request-log JSON lines (one object per line) to typed rows:
    ``ts, method, route, status_code, duration_s, ip``. Durations are logged
    as text like ``"0.0123s"``; the unit is stripped and the number kept as
    ``decimal(10,4)``. Give either a ``path`` (read with the declared schema)
    or a DataFrame of ``lines`` (column ``value``)."""
    if path is not None:
        df = spark.read.schema(REQUEST_LOG_LINE).json(path)
    else:
        df = lines.select(F.from_json("value", REQUEST_LOG_LINE).alias("_r")).select("_r.*")
    return df.select(
        F.to_timestamp("timestamp").alias("ts"),
        "method",
        F.col("path").alias("route"),
        F.col("status").alias("status_code"),
        F.regexp_replace("duration", "s$", "").cast("decimal(10,4)").alias("duration_s"),
        "ip",
    )


def request_log_lines(log: DataFrame) -> DataFrame:
    """The log lines a request log produces (the writer side of S9)."""
    return log.select(
        F.to_json(F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.lit("info").alias("level"),
            "method",
            F.col("route").alias("path"),
            F.col("status_code").alias("status"),
            F.concat(F.col("duration_s").cast("string"), F.lit("s")).alias("duration"),
            "ip",
        )).alias("value")
    )
