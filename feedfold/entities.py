"""Schemas of the entities, as Spark DDL."""

EMAIL = "seq bigint, id string, date timestamp, `from` string, subject string, body string"

CALENDAR_EVENT = (
    "seq bigint, id string, title string, start timestamp, `end` timestamp, "
    "start_ts bigint, end_ts bigint, location string, notes string, calendar string"
)

REMINDER = (
    "seq bigint, id string, title string, due timestamp, due_ts bigint, "
    "notes string, list string, completed boolean"
)

MESSAGE = (
    "seq bigint, chat_id string, chat_name string, sender string, direction string, "
    "date string, timestamp bigint, text string"
)

SUMMARY = (
    "id bigint, email_id string, subject string, sender string, email_date string, "
    "body string, summary string, model_used string, created_at timestamp"
)

CHAT_TURN = "conv_id string, turn bigint, role string, content string"

# Field lists of the export files: every value is text there.
CALENDAR_EXPORT_FIELDS = (
    "id", "title", "start", "end", "start_ts", "end_ts", "location", "notes", "calendar",
)
REMINDER_EXPORT_FIELDS = ("id", "title", "due", "due_ts", "notes", "list")
MESSAGE_EXPORT_FIELDS = (
    "chat_id", "chat_name", "sender", "direction", "date", "timestamp", "text",
)
EMAIL_EXPORT_FIELDS = ("id", "date", "from", "subject", "body")
