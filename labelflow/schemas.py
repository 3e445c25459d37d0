"""Schemas and constants of the message-labelling data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
K_NEIGHBOURS = 5
HIGH, MEDIUM = 0.95, 0.80
MIN_EXAMPLES = 5
SKIP = "__skip__"
MATURITY_TARGET, SKIP_TARGET = 20, 50
SKIP_FRONTLOAD = 50
MAX_PER_LABEL = 200
MAX_HTML_CHARS = 200_000
MAX_WORDS = 400
LINE_WIDTH = 130
RECOVERY_WINDOW_MS = 3_600_000
HEARTBEAT_MS = RECOVERY_WINDOW_MS // 2
GAP_WARN = 500
BATCH_ROWS = 25
PROGRESS_EVERY = 100
BACKOFF_FIRST_S, BACKOFF_MOST_S = 5, 60
STATE_SCHEMA_VERSION = "1"
TEXT_VERSION = "textrepr-v1"

_s, _l = T.StringType(), T.LongType()

MESSAGES = T.StructType([T.StructField("message_id", _s, False), *[T.StructField(c, _s) for c in ("subject", "from_address", "from_name", "body_html")], T.StructField("labels", T.ArrayType(_s)), T.StructField("list_id", _s), T.StructField("date", _s)])
HISTORY = T.StructType([T.StructField("seq", _l), T.StructField("type", _s), T.StructField("message_id", _s), T.StructField("label_ids", T.ArrayType(_s))])
EMBEDDINGS = T.StructType([T.StructField("message_id", _s), T.StructField("vector", T.ArrayType(T.FloatType()))])
LABELS = T.StructType([T.StructField(c, _s) for c in ("message_id", "label_id", "label_name", "source")])
PENDING = T.StructType([T.StructField(c, _s) for c in ("message_id", "first_seen_history_id", "reason")])
META = T.StructType([T.StructField("key", _s), T.StructField("value", _s)])
REGISTRY = T.StructType([T.StructField("label_id", _s), T.StructField("label_name", _s), T.StructField("is_excluded", T.BooleanType())])
#: batch: which commit asked for the action; an action is known by message and batch.
OUTBOX = T.StructType([*[T.StructField(c, _s) for c in ("message_id", "add_label", "remove_label")], T.StructField("batch", _l)])
IDS = T.StructType([T.StructField("message_id", _s)])
#: The index view (operators.index_view): which messages vote, and for what; how many for each label.
INDEX_VIEW = T.StructType([T.StructField(c, _s) for c in ("message_id", "index_label")])
INDEX_COUNTS = T.StructType([T.StructField("label", _s), T.StructField("examples", _l)])
#: The list of a progressive build (operators.progressive).
WORK_LIST = T.StructType([T.StructField("pos", _l), *[T.StructField(c, _s) for c in ("message_id", "label_id", "label_name", "source")], T.StructField("cost", _l), T.StructField("batch", _l)])
#: echoes: messages whose next label changes are our own; applied: messages that we labelled and that are no news any more.
STATE_TABLES = {"embeddings": EMBEDDINGS, "labels": LABELS, "pending_new": PENDING, "meta": META, "outbox": OUTBOX, "echoes": IDS, "applied": IDS, "index_view": INDEX_VIEW, "index_counts": INDEX_COUNTS, "work_list": WORK_LIST}
STATE_KEYS = {name: {"meta": ["key"], "outbox": ["message_id", "batch"], "index_counts": ["label"], "work_list": ["pos"]}.get(name, ["message_id"]) for name in STATE_TABLES}
