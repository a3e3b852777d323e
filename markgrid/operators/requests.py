"""Rules for uploads, as columns: what is refused, with which status, code and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes of the accepted image formats (fixed values).
SIGNATURES = {"jpeg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n"}
MAX_BYTES = 25 * 1024 * 1024
#: Fixed values of the service: code and message by status.
STATUS = {
    400: ("BAD_REQUEST", "The request could not be understood or was missing required parameters."),
    401: ("UNAUTHORIZED", "Authentication is required. Provide a valid X-API-Key header."),
    403: ("FORBIDDEN", "You do not have permission to access this resource."),
    404: ("NOT_FOUND", "The requested resource was not found."),
    409: ("CONFLICT", "The request conflicts with the current state of the resource."),
    413: ("UPLOAD_TOO_LARGE", "The uploaded file exceeds the maximum allowed size."),
    415: ("UNSUPPORTED_MEDIA", "The uploaded file type is not supported. Use JPEG or PNG."),
    422: ("VALIDATION_ERROR", "Request validation failed."),
    429: ("RATE_LIMITED", "Too many requests. Please wait and try again."),
    503: ("SERVICE_BUSY", "The service is at capacity. Please retry shortly."),
}
UNKNOWN = ("INTERNAL_ERROR", "An unexpected error occurred. Please try again later.")


def kind_of(content: Column, signatures: dict[str, bytes] = SIGNATURES) -> Column:
    """The format whose signature the bytes begin with; null if none."""
    return F.coalesce(*[F.when(F.substring(content, 1, len(head)) == F.lit(head), F.lit(name)) for name, head in signatures.items()])


def checked(requests: DataFrame, known: DataFrame, signatures: dict[str, bytes] = SIGNATURES, most: int = MAX_BYTES) -> DataFrame:
    """requests (content, template_id) with size, kind and status: 413 over `most` bytes, 400 without
    content, 415 of no accepted format, 422 with a template that known (template_id) lacks, else 200."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    rows = requests.withColumns({"size": size, "kind": kind_of(F.col("content"), signatures)})
    rows = rows.join(F.broadcast(known.select("template_id").distinct().withColumn("known", F.lit(True))), "template_id", "left")  # the registry: forty templates
    status = F.when(F.col("size") > most, 413).when(F.col("size") == 0, 400).when(F.col("kind").isNull(), 415).when(F.col("known").isNull(), 422).otherwise(200)
    return rows.withColumn("status", status).drop("known", "content")


def explained(status: Column) -> tuple[Column, Column]:
    """Code and message of a status of 400 or more; null below."""
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v[i])])
    return tuple(F.when(status >= 400, F.coalesce(F.try_element_at(pick(i), status), F.lit(UNKNOWN[i]))) for i in (0, 1))
