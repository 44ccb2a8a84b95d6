"""Schemas and constants of the data model."""

from __future__ import annotations

SCHEMA_VERSION = 1
#: An employment without an end lasts until here; never the wall clock, so that results don't change by the day.
TIME_HORIZON = "2026-10"

EVIDENCE = "STRUCT<source_file: STRING, snippet: STRING, location: STRING>"
FIELD = f"STRUCT<value: STRING, confidence: DOUBLE, evidence: ARRAY<{EVIDENCE}>>"
EXPERIENCE = f"STRUCT<company: STRING, title: STRING, start: STRING, end: STRING, confidence: DOUBLE, evidence: ARRAY<{EVIDENCE}>>"
CARD = (f"schema_version INT, source_file STRING, file_type STRING, file_sha256 STRING, parsed_at STRING, fields MAP<STRING, {FIELD}>, "
        f"experiences ARRAY<{EXPERIENCE}>, skills ARRAY<{FIELD}>, certificates ARRAY<{FIELD}>, warnings ARRAY<STRING>")

#: Scalar fields in the order in which conflicts are listed.
SCALAR_FIELDS = ["name", "phone", "email", "degree", "school", "major", "graduation_date", "desired_position"]
LIST_GROUPS = ["experiences", "skills", "certificates"]

#: Weights and thresholds of entity resolution.
WEIGHT_NAME, WEIGHT_EXPERIENCE, WEIGHT_OTHER = 0.4, 0.4, 0.2
WEIGHT_COMPANY, WEIGHT_TIME = 0.4, 0.6
NAME_EQUAL, NAME_KEY = 1.0, 0.7
AUTO, MANUAL = 0.85, 0.6

#: Weights of screening.
WEIGHT_SKILLS, WEIGHT_YEARS, WEIGHT_DEGREE = 0.6, 0.2, 0.2
DEGREE_ORDER = {"大专": 1, "本科": 2, "硕士": 3, "博士": 4}
STATE_TEXT = {"hit": "满足", "miss": "不满足", "insufficient": "待人工确认", "excluded": "硬排除"}
