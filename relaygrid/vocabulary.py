"""Names, reasons and defaults that results depend on."""

# --- fixed values: models ---------------------------------------------------
MODELS = (
    "binary", "status", "plugin", "insert", "delete", "download",
    "retrohunt", "report", "scrape",
)
CURRENT_MODEL_VERSION = 6

# --- fixed values: binary actions -------------------------------------------
ACTIONS = ("sourced", "extracted", "augmented", "mapped", "enriched")
ACTIONS_WITH_DATA = ("sourced", "extracted", "augmented")
ACTIONS_WITH_CONTENT = ("sourced", "extracted")
CONTENT_LABEL = "content"

# --- fixed values: status labels --------------------------------------------
STATUS_COMPLETED = ("completed",)
STATUS_IN_PROGRESS = ("heartbeat", "dequeued")
STATUS_LOST = "error-network"

# --- fixed values: drop reasons ---------------------------------------------
AGEOFF = "ageoff"
TOO_DEEP = "too_deep"
MAX_SECURITY = "max_security"
REJECT_SOURCE = "reject_source"
REJECT_EVENT_TYPE = "reject_event_type"
REJECT_SELF = "reject_self"
REJECT_TOO_LARGE = "reject_content_too_large"
REJECT_TOO_SMALL = "reject_content_too_small"
REJECT_FILE_FORMAT = "reject_file_format"
REJECT_STREAM = "reject_stream"
REJECT_NO_CONTENT = "reject_no_content"
DELETED = "deleted"
DUPLICATE = "skipped"
DUPLICATE_NO_KEY = "error"
CACHED = "cached"
NO_ID = "error_no_id"
SELF_IGNORED = "ignored"
FLAGGED = "filter_flagged"

# --- fixed values: stage names (prefix of a counted reason) ------------------
STAGE_AGEOFF = "PipelineAgeoff"
STAGE_DEPTH = "FilterTooDeep"
STAGE_SECURITY = "FilterSecurity"
STAGE_RULES = "FilterConsumerRules"
STAGE_DELETED = "FilterPreviouslyDeleted"
STAGE_DUPLICATES = "FilterDuplicates"
STAGE_REPLAY = "ReplayPluginCompletion"
STAGE_DEQUEUED = "RaiseDequeuedStatus"
STAGE_RESULTS = "ProduceStatusResults"
STAGE_INJECT = "InjectChildEvents"
STAGE_SETTINGS = "SourceSettingRemoval"
STAGE_KEY = "InjectId"

# --- fixed values: limits and durations --------------------------------------
DEPTH_ACTIVE = 10
DEPTH_PASSIVE = 11
LOST_AFTER_S = 30 * 60
REPLAY_TTL_S = 1800
REPLAY_MIN_RUNTIME_S = 10.0
FETCH_DEFAULT = 1
FETCH_LIMIT = 1000
DEADLINE_DEFAULT_S = 5
MAX_MESSAGE_BYTES = 3 * 1024 * 1024
PAUSE_S = 10 * 60
SKIP_TO_LATEST_S = 30 * 60
PAUSE_GAP_S = 60
IDLE_AFTER_S = 1440 * 60
REGISTRATION_TTL_S = 24 * 3600
SETTINGS_DEPTH_KEY = "remove_at_depth"

# --- fixed values: histogram bounds (seconds) --------------------------------
PROCESSING_BUCKETS = (.005, .01, .025, .05, .1, .25, .5, 1, 2.5, 5, 30, 60, 120, 300, 600, 1200, 1800, 2400)
REST_BUCKETS = (.005, .01, .025, .05, .1, .25, .5, 1, 2.5, 5, 10, 30, 60)

# --- fixed values: topic policies (suffix, cleanup, retention ms; -1 keeps) ---
SYSTEM_TOPIC_POLICIES = (
    ("system.insert", "compact", -1),
    ("system.delete", "compact", -1),
    ("system.expedite", "delete", 604_800_000),
    ("system.error", "delete", 604_800_000),
    ("system.plugin", "delete", 604_800_000),
    ("system.status", "delete", 86_400_000),
    ("system.download", "delete", 43_200_000),
    ("system.retrohunt", "compact", -1),
    ("system.report", "delete", 2_419_200_000),
    ("system.scrape", "delete", 2_419_200_000),
)
