"""Queries over nested documents: JSON against a schema, secrets in nested rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schemas as S
from .shapes import table

_ITEM = {
    "type": "object",
    "required": ["text", "source_segment_ids"],
    "properties": {"text": {"type": "string", "minLength": 1}, "source_segment_ids": {"type": "array", "items": {"type": "integer", "minimum": 0}, "minItems": 1, "uniqueItems": True}},
    "additionalProperties": False,
}
#: A merged note: texts, lists of items with the segments they rest on, a checksum.
NOTE_SCHEMA = {
    "type": "object",
    "required": ["schema_version", "recording_id", "input_hash", "topics", "source_chunk_count", "note_type"],
    "properties": {
        "schema_version": {"const": "note_v1"},
        "recording_id": {"type": "string", "minLength": 1},
        "input_hash": {"type": "string", "pattern": "^[0-9a-f]{64}$"},
        "topics": {"type": "array", "items": {"$ref": "#/$defs/item"}, "maxItems": 6},
        "source_chunk_count": {"type": "integer", "minimum": 0},
        "note_type": {"enum": ["meeting", "lecture", "other"]},
    },
    "additionalProperties": False,
    "$defs": {"item": _ITEM},
}
SECRETS = ["the", "ein"]


def nested_schema_findings(spark, d):
    """A note of each conversation, with faults by rule, against the schema."""
    c, t = F.col("conv_id"), F.col("turn")
    n = c + t
    ids = F.when(n % 7 == 1, F.array(t, t)).when(n % 7 == 2, F.array(-t - 1)).when(n % 7 == 3, F.array().cast("array<long>")).otherwise(F.array(t))
    item = F.struct("turn", F.struct(F.when(n % 5 != 4, F.concat(F.lit("t"), F.substring("text", 1, 12))).when(n % 10 == 4, "").alias("text"), ids.alias("source_segment_ids"), F.when(n % 11 == 4, "more").alias("extra")).alias("item"))
    notes = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("topics"))
    fields = F.struct(
        F.when(c % 13 == 0, "note_v0").otherwise("note_v1").alias("schema_version"),
        F.when(c % 17 == 0, "").otherwise(c.cast("string")).alias("recording_id"),
        F.when(c % 19 != 0, F.sha2(c.cast("string").cast("binary"), 256)).when(c % 2 == 0, "none").alias("input_hash"),
        "topics",
        F.when(c % 23 == 0, -1).otherwise(F.size("topics")).alias("source_chunk_count"),
        F.when(c % 4 == 0, "meeting").when(c % 4 == 1, "lecture").when(c % 8 == 2, "chat").otherwise("other").alias("note_type"),
    )
    whole = F.to_json(fields)
    return S.schema_findings(notes.select("conv_id", F.when(c % 29 == 0, F.substring(whole, 2, 50)).otherwise(whole).alias("note")), "conv_id", "note", NOTE_SCHEMA)


def nested_redaction(spark, d):
    """Conversations as nested rows without their secrets: a digest of all texts, and in how many a secret is left."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.create_map(F.lit("said"), F.array(t["text"])).alias("notes")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(nested.alias("turns"))
    out = S.without_secrets(rows, SECRETS)
    said = F.transform("turns", lambda t: F.concat_ws("|", t["text"], t["notes"]["said"]))
    left = F.size(F.filter(said, lambda x: F.contains(x, F.lit(SECRETS[0])) | F.contains(x, F.lit(SECRETS[1]))))
    return out.select("conv_id", F.sha2(F.array_join(said, "\n"), 256).alias("sha"), left.alias("n_left"))


QUERIES = {f.__name__: f for f in (nested_schema_findings, nested_redaction)}

_FREE = "replace(replace(text, 'the', '***REDACTED***'), 'ein', '***REDACTED***')"
SQL = {
    "nested_schema_findings": """WITH t AS (SELECT conv_id AS c, turn, conv_id + turn AS n, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR) AS i FROM conversations),
      c AS (SELECT c, count(*) AS turns FROM t GROUP BY 1),
      f AS (
        SELECT c, '$.schema_version: const' AS f FROM c WHERE c % 13 = 0
        UNION ALL SELECT c, '$.recording_id: minLength' FROM c WHERE c % 17 = 0
        UNION ALL SELECT c, CASE WHEN c % 2 = 0 THEN '$.input_hash: pattern' ELSE '$: required input_hash' END FROM c WHERE c % 19 = 0
        UNION ALL SELECT c, '$.topics: maxItems' FROM c WHERE turns > 6
        UNION ALL SELECT c, '$.source_chunk_count: minimum' FROM c WHERE c % 23 = 0
        UNION ALL SELECT c, '$.note_type: enum' FROM c WHERE c % 8 = 2
        UNION ALL SELECT c, CASE WHEN n % 10 = 4 THEN '$.topics[' || i || '].text: minLength' ELSE '$.topics[' || i || ']: required text' END FROM t WHERE n % 5 = 4
        UNION ALL SELECT c, '$.topics[' || i || '].source_segment_ids' || CASE n % 7 WHEN 1 THEN ': uniqueItems' WHEN 2 THEN '[0]: minimum' ELSE ': minItems' END FROM t WHERE n % 7 IN (1, 2, 3)
        UNION ALL SELECT c, '$.topics[' || i || ']: additionalProperties extra' FROM t WHERE n % 11 = 4)
      SELECT c.c AS conv_id, CASE WHEN c.c % 29 = 0 THEN ['$: json'] ELSE coalesce(list(f ORDER BY f) FILTER (f IS NOT NULL), []) END AS findings FROM c LEFT JOIN f USING (c) GROUP BY 1""",
    "nested_redaction": f"SELECT conv_id, sha256(string_agg({_FREE} || '|' || {_FREE}, chr(10) ORDER BY turn)) AS sha, 0 AS n_left FROM conversations GROUP BY 1",
}
