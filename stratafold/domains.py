"""Fixed values that results depend on."""

# Legal event types and plans, in natural order.
EVENT_TYPES = (
    "login",
    "logout",
    "page_view",
    "purchase",
    "ticket_opened",
    "ticket_replied",
    "ticket_closed",
    "export_generated",
    "report_viewed",
    "api_call",
    "feature_used",
)
PLANS = ("free", "pro", "enterprise")

# Start of time for a first extract, end of time for an open version.
FIRST_RUN = "1970-01-01T00:00:00Z"
OPEN_END = "9999-12-31T23:59:59"

# Mart and quality thresholds.
TRAILING_DAYS = 30
TOP_CUSTOMERS = 10
VOLUME_HISTORY_BATCHES = 7
VOLUME_MAX_DEVIATION_PCT = 50.0
FRESHNESS_MAX_LAG_DAYS = 2

OPENED = "ticket_opened"
REPLIED = "ticket_replied"
