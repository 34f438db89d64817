"""Schemas of the records."""

CASE = "id BIGINT, signature STRING, error_excerpt STRING, diagnosis STRING, times_seen BIGINT, last_seen STRING, confirmed_by STRING, merged_from BIGINT"
FLAKE = "signature STRING, times_passed BIGINT, last_pass STRING"
TASK = "id BIGINT, title STRING, status STRING, created STRING, done_at STRING"
HOLDOUT = "signature STRING, diagnosis STRING"
PROPOSED_RULE = "id BIGINT, type STRING, description STRING, confidence DOUBLE, supporting_cases ARRAY<BIGINT>, proposed_rule STRING, created STRING"
REJECTED_RULE = "type STRING, supporting_cases ARRAY<BIGINT>, rejected_by STRING, rejected_at STRING, reason STRING"
DIGEST = "id BIGINT, source STRING, heading STRING, content STRING, content_hash STRING, digested_at STRING"
EXPERIENCE = (
    "experience_id STRING, session_id STRING, goal STRING, outcome STRING, context STRING, actions ARRAY<STRING>, failure STRING, diagnosis STRING, resolution STRING, "
    "verification STRUCT<ok: BOOLEAN, attempts: ARRAY<STRUCT<ok: BOOLEAN, detail: STRING, at: STRING, after_step: INT>>>, confidence DOUBLE, times_seen BIGINT, "
    "tags ARRAY<STRING>, project_type STRING, languages ARRAY<STRING>, recorded_at STRING, last_reinforced_at STRING"
)
RULE_PACK = "name STRING, version STRING, rules ARRAY<STRUCT<id: STRING, pattern: STRING, classification: STRING, diagnosis_hint: STRING, exit_code: INT, action_hint: STRING>>"
SKILL = (
    "name STRING, goal STRING, description STRING, required_tools ARRAY<STRING>, preconditions ARRAY<STRING>, procedure ARRAY<STRING>, verification STRING, "
    "failure_modes ARRAY<STRING>, confidence DOUBLE, tags ARRAY<STRING>"
)
MANIFEST = "tool STRING, schema INT, created_utc STRING, source STRING, label STRING, stamp STRING, files ARRAY<STRUCT<path: STRING, size: BIGINT, sha256: STRING>>, dirs ARRAY<STRING>"
EVENT = "seq BIGINT, event_id STRING, session_id STRING, timestamp STRING, event_type STRING, payload STRING"
EVAL_METRICS = (
    "STRUCT<task: STRING, goal: STRING, model: STRING, success: BOOLEAN, termination_reason: STRING, iterations: INT, duration_seconds: DOUBLE, files_changed: ARRAY<STRING>, "
    "tool_calls: INT, commands_run: INT, tool_failures: INT, recovery_count: INT, intervention_count: INT>"
)
EVAL_RUN = f"run_id STRING, started_at STRING, models ARRAY<STRING>, results MAP<STRING, MAP<STRING, {EVAL_METRICS}>>"
#: What ``from_json`` makes of a bad line is kept here.
BROKEN = "_broken"
