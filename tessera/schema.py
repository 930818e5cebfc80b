"""Schemas of the memory graph.  Schemas are never inferred.

ins_seq is insertion order; it is data here (stable ties, predecessors, first
rows of an entity), so every table carries it.
"""

ENTITY_TYPES = ("PERSON", "OBJECT", "CONCEPT")
PRECISIONS = ("second", "minute", "hour", "day", "week", "month", "year", "unknown")

ENTITY = "id STRING, canonical_name STRING, type STRING, aliases ARRAY<STRING>, created_at TIMESTAMP, modified_at TIMESTAMP, embedding ARRAY<FLOAT>, ins_seq LONG"
EVENT = (
    "id STRING, subject_ids ARRAY<STRING>, object_ids ARRAY<STRING>, predicate STRING, normalized_text STRING, details STRING, "
    "time_expr STRING, event_time TIMESTAMP, event_time_precision STRING, mention_time TIMESTAMP, source_session STRING, "
    "source_turn INT, speech_act BOOLEAN, superseded_by STRING, embedding ARRAY<FLOAT>, ins_seq LONG"
)
#: One record of the journal: both kinds of payload share a struct.
PAYLOAD = (
    "id STRING, canonical_name STRING, type STRING, aliases ARRAY<STRING>, created_at TIMESTAMP, modified_at TIMESTAMP, "
    "subject_ids ARRAY<STRING>, object_ids ARRAY<STRING>, predicate STRING, normalized_text STRING, details STRING, time_expr STRING, "
    "event_time TIMESTAMP, event_time_precision STRING, mention_time TIMESTAMP, source_session STRING, source_turn INT, "
    "speech_act BOOLEAN, superseded_by STRING, embedding ARRAY<FLOAT>"
)
JOURNAL = f"v INT, op STRING, data STRUCT<{PAYLOAD.replace(' ', ': ').replace(',: ', ', ')}>, _corrupt STRING"
JOURNAL_OPS = ("entity.upsert", "entity.delete", "event.add", "event.delete")
EXTRACTED_ROW = "entity_type STRING, canonical STRING, aliases ARRAY<STRING>, predicate STRING, object STRING, time_expr STRING, fact STRING, details STRING, speech_act BOOLEAN"
JOB_LOG = "seq LONG, kind STRING, session_id STRING, turn INT, job STRING, failures INT, error STRING, at TIMESTAMP"
